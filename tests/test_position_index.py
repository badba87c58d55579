"""Rows by a stored position index: equal to reading every line, and only the needed files opened."""

import gzip
import json
import os

import pytest

from shardwright.session import scratch_path
from shardwright.sources import position_index


@pytest.fixture
def corpus(tmp_path):
    """Files with long, blank and unended lines, an empty one, a compressed one of two members."""
    rows = {}

    def lines(name, n, width):
        rows[name] = [{"k": f"{name}-{i}", "body": "é" * (i * width % 97)} for i in range(n)]
        return [json.dumps(r, ensure_ascii=False) for r in rows[name]]

    (tmp_path / "a.jsonl").write_text("\n".join(lines("a.jsonl", 40, 3)))
    b = lines("b.jsonl", 25, 31)
    (tmp_path / "b.jsonl").write_text("\n \n" + "\n\n".join(b) + "\n\n")
    (tmp_path / "c.jsonl").write_text("")
    d = lines("d.jsonl.gz", 30, 11)
    (tmp_path / "d.jsonl.gz").write_bytes(gzip.compress(("\n".join(d[:9]) + "\n").encode()) + gzip.compress("\n".join(d[9:]).encode()))
    (tmp_path / "e.jsonl").write_text("\n".join(lines("e.jsonl", 1, 5) * 1) + "\n")
    rows["c.jsonl"] = []
    return tmp_path, rows


@pytest.mark.parametrize("split_bytes", [1, 64, 1000, 1 << 20])
def test_positions(spark, corpus, split_bytes):
    root, rows = corpus
    index = position_index.build_index(spark, str(root), scratch_path(spark, "t-index"), split_bytes=split_bytes)
    got = {(os.path.basename(r.file_path), r.id_in_file, r.position): (r.k, r.body)
           for r in position_index.read_rows(index, "k string, body string").collect()}
    want, place = {}, 0
    for name in sorted(rows):
        for i, r in enumerate(rows[name]):
            want[name, i, place] = (r["k"], r["body"])
            place += 1
    assert got == want
    everything = [want[k] for k in sorted(want, key=lambda k: k[2])]
    for skip, limit in [(0, 0), (0, 7), (39, 2), (60, 20), (90, -1), (500, 5)]:
        some = sorted(position_index.read_rows(index, "k string, body string", skip, limit).collect(), key=lambda r: r.position)
        assert [(r.k, r.body) for r in some] == everything[skip:][:limit if limit >= 0 else None]


def test_only_needed_files_are_opened(spark, corpus):
    """Files without wanted rows may be gone; the rows are not shuffled."""
    root, _ = corpus
    index = position_index.build_index(spark, str(root), scratch_path(spark, "t-index"))
    (root / "a.jsonl").unlink()
    (root / "d.jsonl.gz").unlink()
    part = position_index.read_rows(index, "k string", skip=42, limit=10)
    assert sorted(r.k for r in part.collect()) == sorted(f"b.jsonl-{i}" for i in range(2, 12))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange") == 1  # of the splits, before they are opened
    with pytest.raises(Exception):
        position_index.read_rows(index, "k string", skip=38, limit=10).collect()


def test_options(spark, corpus):
    root, rows = corpus
    n = sum(map(len, rows.values()))
    build = lambda seed: position_index.build_index(spark, str(root), scratch_path(spark, "t-index"), shuffle_seed=seed)
    orders = set()
    for seed in (1, 1, 2, 3):
        got = position_index.read_documents(build(seed), "k string, body string", "x", text_key="body", id_key="none", default_metadata={"k": "?", "z": "1"}).collect()
        assert sorted(r.position for r in got) == list(range(n))
        assert all(r.metadata["z"] == "1" and r.id.endswith(r.metadata["k"].replace("-", "/")) and r.dataset_name == "x" for r in got)
        orders.add(tuple(os.path.basename(os.path.dirname(r.id)) for r in sorted(got, key=lambda r: r.position)))
    assert len(orders) in (2, 3)


def test_broken_line_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "1"}\n{"k": \n')
    index = position_index.build_index(spark, str(tmp_path), scratch_path(spark, "t-index"))
    with pytest.raises(Exception):
        position_index.read_rows(index, "k string").collect()


def test_no_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("")
    index = position_index.build_index(spark, str(tmp_path), scratch_path(spark, "t-index"))
    assert position_index.read_rows(index, "k string").count() == 0
