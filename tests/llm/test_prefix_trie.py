"""Operator 12: conversation prefix trie."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from shardwright.llm import prefix_trie as pt

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x, key=lambda t: (t[0], t[1] or 0, *t[2:]))] for c, x in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def brute(convs):
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    low = {p: min(m) for p, m in nodes.items()}
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[:len(p)] == p]
        child = lambda q: [x for x in nodes if len(x) == len(q) + 1 and x[:len(q)] == q]
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.append((low[p], len(p), low[p[:-1]] if p else None, len(members), len(child(p)), sum(not child(q) for q in under),
                    sum((len(nodes[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in under), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def key(rows):
    return sorted((tuple(r[c] for c in COLUMNS) if not isinstance(r, tuple) or hasattr(r, "asDict") else r for r in rows), key=str)


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 90, 1), 1003, 1004, 2500]:
        for t in range(rng.choice([1, 2, 4, 9, 12])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])))
    rows += [(200, None, None, None), (200, None, "user", "x"), (200, 3, "user", "x"), (200, 3, "user", "x"), (None, 0, "user", "lost")]
    rows += [(300, t, "user", f"step {t}") for t in range(60)] + [(301, t, "user", f"step {t}") for t in range(60)]
    rows += [(c, 0, "system", "hot") for c in range(400, 520)]
    return rows


@pytest.mark.parametrize("shard_convs, shard_nodes", [(4096, 1 << 17), (3, 10), (10, 4)])
def test_equals_brute_force(spark, awkward, shard_convs, shard_nodes):
    df = spark.createDataFrame([(*r, 1, "z") for r in awkward], "conv_id bigint, turn int, role string, text string, depth int, a string")
    got = pt.prefix_trie(df, shard_convs=shard_convs, shard_nodes=shard_nodes).collect()
    assert key(got) == key(brute(sequences(awkward)))


def test_empty_table_and_turnless(spark, awkward):
    df = spark.createDataFrame(awkward, "conv_id bigint, turn int, role string, text string")
    assert pt.prefix_trie(df.limit(0)).count() == 0
    assert pt.prefix_trie(df.filter("conv_id IS NULL")).count() == 0
    rows = [(4, 0, "user", "x")]  # its first turns belong to conversation 0, which is absent
    got = pt.prefix_trie(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()
    assert key(got) == key(brute(sequences(rows)))


def test_slots_are_minimal_perfect_and_know_their_keys():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 30000):
        a, b = rng.integers(-2**62, 2**62, n), rng.integers(0, 3, n)
        table = pt.Slots(a, b)
        assert sorted(table.find(a, b).tolist()) == list(range(n))
        assert (table.find(a + 1, b) == -1).all() and (table.find(a, b + 5) == -1).all()
    with pytest.raises(ValueError):
        pt.Slots(np.array([1, 1]), np.array([2, 2]))


def test_a_digest_of_two_prefixes_raises(spark):
    names = "conv_id bigint, depth bigint, a bigint, b bigint, up_a bigint, up_b bigint, turn_a bigint, turn_b bigint, bytes bigint, ends boolean"
    rows = spark.createDataFrame([(1, 1, 7, 7, 0, 0, 5, 5, 3, True), (2, 1, 7, 7, 0, 0, 5, 6, 3, True)], names)
    with pytest.raises(ValueError, match="share"):
        pt.enumerate_nodes(rows)
