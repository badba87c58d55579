"""Checked readers: bad records go to the side table, each with its reason."""

import json

import pytest

from shardwright.sources import quarantine as q
from shardwright.sources import readers

SCHEMA = "a int, s string"


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "s": "é"}\n\n{"a": "many", "s": "y"}\n{"a": 2\n  \n5\nnull\n[{"a": 3}]\n{"s": "no a", "extra": [1]}\n{"a": null}\n')
    (tmp_path / "y.jsonl").write_text('{"a": 7, "s": "only good"}\n')
    got = q.quarantine(q.read_checked(spark, str(tmp_path), SCHEMA, pattern="*.jsonl"))
    assert sorted((r.a or 0, r.s or "") for r in got.good.collect()) == [(0, ""), (0, "no a"), (1, "é"), (7, "only good")]
    bad = {r.record: (r.reason, r.file_path.rsplit("/", 1)[1]) for r in got.bad.collect()}
    assert bad == {'{"a": "many", "s": "y"}': (q.MISFIT, "x.jsonl"), '{"a": 2': (q.NOT_JSON, "x.jsonl"), "5": (q.MISFIT, "x.jsonl"),
                   "null": (q.MISFIT, "x.jsonl"), '[{"a": 3}]': (q.MISFIT, "x.jsonl")}
    assert (got.n_good, got.n_bad) == (4, 5)
    with pytest.raises(Exception):   # the strict reader fails on the same folder
        readers.read_jsonl(spark, str(tmp_path), SCHEMA, pattern="*.jsonl").collect()


def test_arrays(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"a": 1, "s": "x"}, {"a": "no"}, None, {"a": 3}]))
    (tmp_path / "broken.json").write_text('[{"a": 1}, {"a"')
    (tmp_path / "object.json").write_text('{"a": 1}')
    (tmp_path / "empty.json").write_text("[]")
    got = q.quarantine(q.read_checked(spark, str(tmp_path), SCHEMA, "json", "*.json"))
    assert sorted((r.place, r.a) for r in got.good.collect()) == [(0, 1), (3, 3)]
    assert sorted((r.file_path.rsplit("/", 1)[1], r.place, r.reason) for r in got.bad.collect()) == [
        ("broken.json", None, q.NOT_AN_ARRAY), ("good.json", 1, q.MISFIT), ("good.json", 2, q.MISFIT), ("object.json", None, q.NOT_AN_ARRAY)]
    assert (got.n_good, got.n_bad) == (2, 4)


def test_one_side_only(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n')
    got = q.quarantine(q.read_checked(spark, str(tmp_path), SCHEMA))
    assert got.bad.count() == 0 and got.good.first().a == 1 and got.bad.columns == ["file_path", "place", "reason", "record"]
    with pytest.raises(ValueError):
        q.read_checked(spark, str(tmp_path), SCHEMA, "xml")
