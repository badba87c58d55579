"""Operator 11: spelling variants by a relational trie frontier."""

import random
import re
import zlib
from collections import Counter

import pytest

from shardwright.llm import spelling_trie as st


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, min_length=7, min_count=2, factor=10):
    n = {w: k for w, k in Counter(w for w in words if w is not None and len(w) >= min_length).items() if k >= min_count}
    out, form = {}, {}
    for w in n:
        ns = [v for v in n if v != w and near(w, v)]
        top = min(ns, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= factor * n[w] else None
        out[w] = len(ns)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def table(spark, words):
    return spark.createDataFrame([(w, 1, "z") for w in words], "word string, node int, label string")


def rows(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_on_dense_words(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "aé", "abcÿ"][seed]
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 7, 8, 9]))) for _ in range(150)]
    words = [w for w in words for _ in range(rng.choice([1, 2, 3, 25, 300]))] + [None, ""]
    assert rows(st.group_variants(table(spark, words))) == brute(words)


def test_every_kind_of_edit_at_every_place(spark):
    base = "internationalisation"
    words = [base] * 40
    for i in range(len(base)):
        words += [base[:i] + base[i + 1:]] * 2 + [base[:i] + "x" + base[i + 1:]] * 2 + [base[:i] + base[i] + base[i:]] * 2 + [base[:i] + "q" + base[i:]] * 2
    words += [base + "s"] * 3
    got = rows(st.group_variants(table(spark, words)))
    assert got == brute(words)
    assert {r[4] for r in got if r[0] == base} == {len(set(words)) - 1}


def test_long_words_and_chains_of_forms(spark):
    long = "".join(random.Random(4).choice("abcdefgh") for _ in range(5000))
    words = [long] * 30 + [long[:2500] + "z" + long[2501:]] * 3 + [long[1:]] * 2 + [long + "q"] * 2 + ["x" * 4000] * 2
    words += ["aaaaaaa"] * 2 + ["aaaaaab"] * 20 + ["aaaaabb"] * 200 + ["aaaabbb"] * 2000
    got = {r[0]: r for r in rows(st.group_variants(table(spark, words)))}
    assert got["aaaaaaa"][1:3] == ("aaaaaab", "aaaabbb") and got["aaaabbb"][1] is None
    assert got[long][4] == 3 and got[long + "q"][1] == long and got["x" * 4000][4] == 0


def slipped(docs, every=31):
    out = []
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out.append(run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run)
    return out


def test_slips_and_runs_on_awkward_rows(spark, docs, texts):
    got = sorted(r.word for r in st.with_slips(st.runs(docs, "doc_id", "text", 1), 31).collect())
    assert got == sorted(slipped(texts))
    odd = [(1, "ÀÉÏÕÜßàéïõüÿ×÷ Straße-Straße naïveté NAÏVETÉ"), (2, "A" * 50), (None, "Straße"), (3, None), (3, "")] * 3
    df = spark.createDataFrame(odd, "doc_id int, text string")
    assert sorted(r.word for r in st.with_slips(st.runs(df, "doc_id", "text", 1), 2).collect()) == sorted(slipped(odd, 2))


def test_whole_operator_and_empty_table(spark, docs, texts, empty):
    assert rows(st.spelling_variants(docs)) == brute(slipped(texts))
    assert st.spelling_variants(empty).count() == 0
