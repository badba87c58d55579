import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shardwright.llm import exact_dedup, jaccard_join, suffix_dedup


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- counting quotient filter -------------------------------------------
@pytest.mark.parametrize("bits", [6, 20, 64])
def test_filter_keeps_and_merges(bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 1 << min(bits, 40), 300, dtype=np.uint64)
    b = np.concatenate((a[:50], rng.integers(0, 1 << min(bits, 40), 200, dtype=np.uint64)))
    f, g = (exact_dedup.CountingQuotientFilter.build(*exact_dedup.add_counts(x, np.ones(len(x), np.int64)), bits) for x in (a, b))
    f = exact_dedup.CountingQuotientFilter.from_bytes(f.to_bytes())
    fps, counts = f.merge(g).items()
    assert dict(zip(fps.tolist(), counts.tolist())) == dict(Counter(a.tolist() + b.tolist()))


def exact_by_hand(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    out = []
    for i, t in texts:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_copies(docs, texts, bits):
    assert rows_of(exact_dedup.find_copies(docs, fp_bits=bits, range_slots=16, bitmap_bits=17)) == exact_by_hand(texts)


def test_exact_drop_and_empty(docs, texts, empty):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter(r.text or "" for r in left.filter("doc_id IS NOT NULL").collect()).most_common(1)[0][1] <= 2
    assert {r.text or "" for r in left.collect()} == {t or "" for _, t in texts}
    assert exact_dedup.find_copies(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


# ---- n-gram Jaccard join ------------------------------------------------
def near_by_hand(texts, n, num, den):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(texts):
        if k is not None:
            low[root(i)] = min(k, low.get(root(i), k))
    return sorted(((k, len(s), low.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(texts, sets))), key=repr)


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80), (1, 60)])
def test_near(docs, texts, n, num):
    assert rows_of(jaccard_join.find_near(docs, n_words=n, num=num)) == near_by_hand(texts, n, num, 100)


def test_near_drop_and_empty(docs, empty):
    left = jaccard_join.drop_near(docs)
    assert left.columns == docs.columns and 0 < left.count() < docs.count()
    assert jaccard_join.find_near(empty).count() == 0


# ---- suffix arrays ------------------------------------------------------
@pytest.mark.parametrize("text", [b"", b"a", b"banana", b"\0\0\0\0", b"ab" * 40 + b"\0", b"mississippi" * 9, bytes(range(256))])
def test_suffix_array_and_prefixes(text):
    t = np.frombuffer(text, np.uint8)
    sa = suffix_dedup.suffix_array(t)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = suffix_dedup.kasai(t, sa, 30, stride=4)
    for j in range(1, len(text)):
        a, b = text[sa[j - 1]:], text[sa[j]:]
        want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert lcp[j] == min(want, 30)


def repeats_by_hand(texts, length):
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (k, _), r in zip(texts, raw):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((k, len(r), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length,shard,bits", [(400, 1 << 21, 25), (100, 3000, 16), (40, 5000, 25)])
def test_repeats(docs, texts, length, shard, bits):
    got = suffix_dedup.find_repeats(docs, length=length, shard_bytes=shard, bitmap_bits=bits)
    assert rows_of(got) == repeats_by_hand(texts, length)


def test_planted_passages_around_the_length(spark):
    """Passages of over 50 words go by their bytes: 399 stay, 400 and more go, wherever they lie."""
    def words(tag, n):
        return (" ".join(f"{tag}{i:03d}" for i in range(200)) + " ")[:n]

    planted = {399: words("kor", 399), 400: words("lim", 400), 900: words("nav", 900)}
    texts = [(0, words("own", 700)), (1, planted[400]), (2, None)]
    for k, (n, passage) in enumerate(planted.items()):
        assert len(passage.split()) > 50 and len(passage) == n
        texts += [(10 * k + 11, f"a{k} " + words(f"f{k}", 500) + "\n" + passage), (10 * k + 12, f"{passage}\tb{k} " + words(f"g{k}", 450))]
    got = rows_of(suffix_dedup.find_repeats(spark.createDataFrame(texts, "doc_id bigint, text string"), length=400))
    assert got == repeats_by_hand(texts, 400)
    assert {r[0]: r[2] for r in got} == {0: 0, 1: 400, 2: 0, 11: 0, 12: 0, 21: 400, 22: 400, 31: 900, 32: 900}


def test_repeats_text_and_empty(docs, texts, empty):
    got = suffix_dedup.find_repeats(docs, length=100, with_text=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got) and len(got) == len(texts)
    assert suffix_dedup.find_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.find_repeats(empty, length=7)
