"""Operator 13: packing by shortest-pack-first over the length histogram.

A text becomes its token ids plus an end id. Full runs of ``capacity`` ids
are sequences of their own; what is left of a text is a piece shorter than
that. Of these only the histogram of lengths is looked at as a whole: at
most ``capacity - 1`` numbers, whatever the corpus holds.

* Lengths are placed longest first. A length goes to the shortest packs, the
  ones with most room, many equal packs at a step: a *pattern* (how many
  pieces of which length) has a count, and placing n pieces moves that many
  packs to a longer pattern. A new pattern is opened when no pack has room.
* The patterns are joined back by rank: every piece has a rank among those
  of its length, every pattern owns an interval of ranks of each length it
  uses, so a piece finds its sequence and place with one search.
* Packs that stay open would be padded. Texts may be cut, so the emptiest
  packs are taken apart until as many sequences are left as the tokens fill,
  and their pieces are laid one behind the other over the open room of the
  rest and cut there. What is left (less than one sequence) ends in
  sequences whose sizes are powers of two, which need no padding. So no
  sequence is padded.

Ranks are two-level: a running count inside a task, and running sums of the
tasks' counts by length. Token ids never leave the task that makes them; the
few texts whose pieces are cut are tokenized a second time for the checksums
of the parts.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import sketches, textops
from .packing_ga import encode

END_ID = 1
_RANK_BITS = 44


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple, int, int]]:
    """``[(pattern, room, count)]``: a pattern is ``((length, pieces), ...)``,
    room is what its packs have left.

    Equal to placing the pieces one by one, longest first, each into a pack
    with most room (a new pack if it fits in none). The number of patterns
    depends on the number of lengths, not of pieces.
    """
    closed, serial = [], 0
    heap: list[tuple] = []

    def put(pattern, room, count):
        nonlocal serial
        if not room:
            closed.append((pattern, 0, count))
            return
        serial += 1
        heapq.heappush(heap, (-room, serial, pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and -heap[0][0] >= length:
            room, _, pattern, count = heapq.heappop(heap)
            room = -room
            times = 1
            if left < count:  # some packs of the pattern get one, the others stay
                put(pattern, room, count - left)
                count = left
            else:
                below = -heap[0][0] if heap else 0
                times = min(left // count, room // length, max(1, -(-(room - below) // length)))
            same = pattern[-1][0] == length
            grown = (*pattern[:-1], (length, pattern[-1][1] + times)) if same else (*pattern, (length, times))
            put(grown, room - times * length, count)
            left -= times * count
        each = capacity // length
        for pieces, count in ((each, left // each), (left % each, 1)):
            if pieces and count:
                put(((length, pieces),), capacity - pieces * length, count)
    return closed + [(pattern, -room, count) for room, _, pattern, count in sorted(heap, key=lambda h: (-h[0], h[1]))]


class Plan:
    """Rank intervals of the patterns as flat arrays, a few numbers each.

    ``key`` is ``length << 44 | first rank``; ``per`` pieces of the length a
    sequence, the sequences from ``sequence`` on, at ``place`` inside one.
    ``per`` 0 marks pieces to be cut: ``place`` is their position on the
    line of cut tokens. ``open_*`` describe the room on that line.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        total = sum(length * n for length, n in histogram.items())
        patterns = shortest_pack_first(histogram, capacity)
        drop = sum(count for *_, count in patterns) - total // capacity
        rank = dict.fromkeys(histogram, 0)
        rows, rooms, line, sequence = [], [], 0, 0
        for pattern, room, count in sorted(patterns, key=lambda p: -p[1]):  # the emptiest first
            cut = min(drop, count)
            drop -= cut
            place = 0
            for length, pieces in pattern:
                if cut:
                    rows.append((length, rank[length], 0, 0, line))
                    rank[length] += cut * pieces
                    line += cut * pieces * length
                if count > cut:
                    rows.append((length, rank[length], pieces, sequence, place))
                    rank[length] += (count - cut) * pieces
                    place += pieces * length
            if count > cut:
                if room:
                    rooms.append((room, count - cut, sequence, place))
                sequence += count - cut
        left = line - sum(room * count for room, count, *_ in rooms)
        for bit in reversed(range(left.bit_length())):  # less than one sequence: sizes that need no padding
            if left >> bit & 1:
                rooms.append((1 << bit, 1, sequence, 0))
                sequence += 1
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 5).T
        self.key = (cols[0] << _RANK_BITS) | cols[1]
        self.first, self.per, self.sequence, self.place = cols[1], cols[2], cols[3], cols[4]
        self.room, self.count, self.open_sequence, self.open_place = np.array(rooms, np.int64).reshape(-1, 4).T
        self.open_end = np.cumsum(self.room * self.count)
        self.n_sequences, self.cut_tokens = sequence, line

    def find(self, length: np.ndarray, rank: np.ndarray):
        """``(sequence, offset, position)``: position on the cut line, or -1."""
        at = np.searchsorted(self.key, (length << _RANK_BITS) | rank, "right") - 1
        n, per = rank - self.first[at], self.per[at]
        whole = per > 0
        d = np.maximum(per, 1)
        return (np.where(whole, self.sequence[at] + n // d, -1), np.where(whole, self.place[at] + n % d * length, -1),
                np.where(whole, -1, self.place[at] + n * length))

    def parts(self, position: int, length: int):
        """``(sequence, offset, length)`` of the cuts of a piece on the line."""
        end = position + length
        while position < end:
            g = int(np.searchsorted(self.open_end, position, "right"))
            room = int(self.room[g])
            inside = position - (int(self.open_end[g]) - room * int(self.count[g]))
            take = min(end - position, room - inside % room)
            yield int(self.open_sequence[g]) + inside // room, int(self.open_place[g]) + inside % room, take
            position += take


def _ids(text: str | None, ranks_path: str, pattern: str) -> np.ndarray:
    return np.append(encode(text or "", ranks_path, pattern), END_ID).astype("<u4")


def cut_full(base: DataFrame, ranks_path: str, pattern: str, capacity: int) -> DataFrame:
    """``(task, seat, id, t, start, length, ids_crc32, doc_tokens)`` per
    piece: the full ones, and the rest of each text. ``seat`` numbers a full
    piece inside its task, and a rest among those of its task and length."""
    kind = dict(base.dtypes)["id"]
    names = ["task", "seat", "id", "t", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, start, length, crc, total, seat = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                ids = _ids(text, ranks_path, pattern)
                for a in range(0, len(ids), capacity):
                    part = ids[a:a + capacity]
                    row.append(i)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    seat.append(int(seen[len(part)]))
                    seen[len(part)] += 1
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(row), pa.int32()), pa.array(seat, pa.int64()), batch.column(0).take(at), batch.column(1).take(at),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=names)

    return base.select("id", "t", "text").mapInArrow(
        run, f"task int, seat bigint, id {kind}, t bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def _placed(rest: DataFrame, plan) -> DataFrame:
    """The rests with ``sequence``, ``offset`` and ``position``."""
    keep = ["id", "t", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        for b in batches:
            find = plan.value.find(b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(x) for x in find)], names=[*keep, "sequence", "offset", "position"])

    kinds = dict(rest.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keep)
    return rest.select(*keep, "rank").mapInArrow(run, f"{schema}, sequence bigint, offset bigint, position bigint")


def _cut(found: DataFrame, plan, ranks_path: str, pattern: str) -> DataFrame:
    """The parts of the rests that are cut, from their texts."""
    kind = dict(found.dtypes)["id"]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"]

    def run(batches):
        for b in batches:
            out: list[list[int]] = [[] for _ in range(7)]
            for i, (start, length, total, position, text) in enumerate(zip(*(b.column(k).to_pylist() for k in ("start", "length", "doc_tokens", "position", "text")))):
                ids = _ids(text, ranks_path, pattern)
                if len(ids) != total:
                    raise ValueError("two texts share a 64-bit hash")
                for sequence, offset, n in plan.value.parts(position, length):
                    for col, x in zip(out, (i, start, n, zlib.crc32(ids[start:start + n].tobytes()), total, sequence, offset)):
                        col.append(x)
                    start += n
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:])], names=names)

    return found.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence bigint, offset bigint")


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.

    Null text is empty text: its one piece holds the end id. Repeated rows
    and null ids are packed like any other row. Only rests of texts are cut,
    and only as many as fill the open room. Other columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    textops.bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))
    pieces = materialize(spark, cut_full(base, ranks_path, pattern, capacity), "pieces")
    full = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity)
    counts = materialize(spark, rest.groupBy("length", "task").agg(F.count("*").alias("n")), "task-lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # under capacity rows
    plan = spark.sparkContext.broadcast(Plan(histogram, capacity))  # a few thousand numbers
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("first"))
    ranked = rest.join(first, ["length", "task"]).withColumn("rank", F.col("first") + F.col("seat"))
    placed = materialize(spark, _placed(ranked, plan), "placed")
    whole = placed.filter("position < 0").select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") * 2).alias("sequence_id"), "offset")
    cut = placed.filter("position >= 0")
    bitmap = sketches.share(spark, sketches.key_bitmap(cut.select(F.xxhash64("id", "t").alias("h")), "h", 20))
    texts = base.filter(sketches.maybe_in(bitmap)(F.xxhash64("id", "t"))).groupBy("id", "t").agg(F.first("text").alias("text"))  # rows that repeat fold here
    found = cut.alias("c").join(texts.alias("x"), F.col("c.id").eqNullSafe(F.col("x.id")) & (F.col("c.t") == F.col("x.t"))).select("c.*", "x.text")
    parts = _cut(found, plan, ranks_path, pattern).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") * 2).alias("sequence_id"), "offset")
    alone = full.select("id", "start", "length", "ids_crc32", "doc_tokens", ((F.col("task").cast("bigint") * (1 << 36) + F.col("seat")) * 2 + 1).alias("sequence_id"),
                        F.lit(0).cast("bigint").alias("offset"))
    return alone.unionByName(whole).unionByName(parts).withColumnRenamed("id", id_col)
