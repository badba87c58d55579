"""Operator 13: shortest-pack-first over the length histogram."""

import random
import zlib

import numpy as np
import pytest

from shardwright.llm import pack_histogram as ph
from shardwright.llm.queries import tokenizer_files


def one_by_one(lengths, capacity):
    """Shortest pack first, a piece at a time: pieces of each pack."""
    packs = []
    for length in sorted(lengths, reverse=True):
        open_ = [p for p in packs if capacity - sum(p) >= length]
        if open_:
            max(open_, key=lambda p: capacity - sum(p)).append(length)
        else:
            packs.append([length])
    return packs


@pytest.mark.parametrize("seed", range(6))
def test_patterns_equal_placing_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 100])
    lengths = [rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 200))] + [rng.randint(1, capacity - 1)] * rng.randint(0, 150)
    patterns = ph.shortest_pack_first({x: lengths.count(x) for x in set(lengths)}, capacity)
    got = sorted(capacity - room for _, room, count in patterns for _ in range(count))
    assert got == sorted(sum(p) for p in one_by_one(lengths, capacity))
    used = sorted(x for pattern, _, count in patterns for x, k in pattern for _ in range(k * count))
    assert used == sorted(lengths)
    assert all(room == capacity - sum(x * k for x, k in pattern) >= 0 for pattern, room, _ in patterns)


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_every_sequence_without_padding(seed):
    rng = random.Random(seed)
    capacity = 128
    histogram = {rng.randint(1, capacity - 1): rng.choice([1, 3, 50, 4000]) for _ in range(rng.randint(1, 40))}
    plan = ph.Plan(histogram, capacity)
    seats: dict[int, list] = {}
    for length, n in histogram.items():
        found = plan.find(np.full(n, length), np.arange(n))
        for sequence, offset, position in zip(*(x.tolist() for x in found)):
            for part in [(sequence, offset, length)] if position < 0 else plan.parts(position, length):
                seats.setdefault(part[0], []).append(part[1:])
    total = sum(k * n for k, n in histogram.items())
    assert sum(n for own in seats.values() for _, n in own) == total
    assert len([1 for own in seats.values() if sum(n for _, n in own) == capacity]) == total // capacity
    for own in seats.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end and n > 0
            end += n
        assert end <= capacity and end & (end - 1) == 0


def test_a_hot_length_stays_a_few_patterns():
    plan = ph.Plan({300: 10**12, 7: 10**11, 1999: 5}, 2048)  # counts of a large corpus
    assert len(plan.key) < 100 and plan.n_sequences * 2048 >= 300 * 10**12
    sequence, offset, position = plan.find(np.array([300]), np.array([10**12 - 1]))
    assert (sequence[0] >= 0) != (position[0] >= 0)


def check(rows, texts, capacity):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end == capacity or end & (end - 1) == 0
    return ids


def test_pack_on_awkward_rows(spark, docs, texts):
    rows = ph.pack(docs, **tokenizer_files()).collect()
    ids = check(rows, [t for _, t in texts], 2048)
    pieces = sorted((r.doc_id is None, r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id is not None)
    unique = {i: x for (i, _), x in zip(texts, ids) if [j for j, _ in texts].count(i) == 1}
    for i, own in unique.items():
        at = 0
        for _, j, total, start, length, crc in pieces:
            if j == i:
                assert start == at and total == len(own) and crc == zlib.crc32(own[start:start + length].tobytes())
                at += length
        assert at == len(own)


def test_small_capacity_cuts_and_string_ids(spark, docs, texts):
    from pyspark.sql import functions as F

    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    check(ph.pack(named, capacity=64, **tokenizer_files()).collect(), [t for _, t in texts], 64)


def test_repeated_rows_empty_texts_and_empty_table(spark, docs, empty):
    same = spark.createDataFrame([(1, "the same row")] * 300 + [(2, None)] * 300 + [(None, "")] * 9, "doc_id bigint, text string")
    rows = ph.pack(same, capacity=32, **tokenizer_files()).collect()
    check(rows, ["the same row"] * 300 + [""] * 309, 32)
    assert ph.pack(empty, **tokenizer_files()).count() == 0
