import random

import numpy as np

from shardwright.llm import sentence_dedup


def test_passage_of_short_lines(spark):
    """A passage of 20 lines of up to three words goes from all texts but one."""
    rng = random.Random(4)
    line = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    passage = "\n".join(line(n) for n in [3] * 8 + [1] * 8 + [2, 3, 1, 1])
    rows = [(k, f"{line(12)}\n{passage}\n{line(12)}") for k in range(6)]
    got = {r.doc_id: r for r in sentence_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), bitmap_bits=20).collect()}
    assert got[0].n_removed == 0 and got[0].text == rows[0][1]
    for k in range(1, 6):
        head, tail = rows[k][1].split("\n")[0], rows[k][1].split("\n")[-1]
        assert got[k].n_removed == 20 and got[k].text.split() == f"{head} {tail}".split()


def test_short_runs(spark):
    """Three lines of a word each are a run; a floor is a parameter."""
    rows = [(k, f"first {k} " + "x" * 5 + "\nyes\nno\nyes\nlast " + f"word{k}") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in sentence_dedup.remove_repeats(df, bitmap_bits=20).collect()}
    assert got == {0: 0, 1: 3, 2: 3, 3: 3}
    got = sentence_dedup.remove_repeats(df, bitmap_bits=20, min_words=10).collect()
    assert {r.n_removed for r in got} == {0}


def test_every_run_of_three():
    """Against all runs by hand; none twice."""
    rng = np.random.default_rng(8)
    for _ in range(50):
        doc, size = np.sort(rng.integers(0, 3, 25)), rng.integers(1, 6, 25)
        d, first, k, _ = sentence_dedup.runs(doc, size, rng.integers(0, 2**63, 25).astype(np.uint64), 3)
        got = [int(x + np.searchsorted(doc, y)) for y, x, n in zip(d, first, k) if n == 3]
        assert got == [a for a in range(23) if doc[a] == doc[a + 2]]


def test_hot_run(spark, monkeypatch):
    """A run of a third of all texts beside rare ones; the same with and without the broadcast."""
    rng = random.Random(5)
    line = lambda: " ".join(f"z{rng.randrange(10**6)}" for _ in range(6)) + "."
    hot, rare = [[line() for _ in range(3)] for _ in range(2)]
    rows = []
    for k in range(300):
        own = [line() for _ in range(2)]
        rows.append((k, " ".join(own[:1] + (hot if k % 3 == 0 else rare if k in (50, 70) else []) + own[1:])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    want = {k: 3 if (k % 3 == 0 and k) or k == 70 else 0 for k in range(300)}
    for least in (10, 10**6):
        monkeypatch.setattr(sentence_dedup, "HOT_ROWS", least)
        got = {r.doc_id: r.n_removed for r in sentence_dedup.remove_repeats(df, bitmap_bits=20).collect()}
        assert got == want
