"""Operator 7: best-fit packing with a grouping genetic algorithm.

A text becomes its token ids plus an end id; a longer one than a sequence is
cut from its end into full pieces, so at most its first piece is shorter and
needs packing. Full pieces are sequences of their own. The others are dealt
to chunks of about ``chunk_items`` pieces by a hash of a per-piece number (a
source or text however hot is dealt evenly). Each chunk is evolved on
several islands at once, every island a Spark row of its own:

* an individual is a partition of the chunk's pieces into bins;
* crossover takes whole well-filled bins of one parent into the other,
  drops the receiver's bins that hold a piece twice, and puts the displaced
  pieces back by best fit, longest first;
* mutation empties the open bins and some full ones and packs their pieces
  anew, by best fit or by exact complements, whichever takes fewer bins;
* after each epoch the elite of every island moves on to the next island of
  its chunk (a shuffle), where it competes with the locals.

The best individual of all islands of a chunk is taken. Token ids never
leave the task that makes them: pieces carry their length and checksum only.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import textops

END_ID = 2
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def encode(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    """Token ids ``uint32``. The rank file and the JSON file of a vocabulary
    give the same ids; the special string is its own id, as the JSON file's
    default has it."""
    enc = _encoder(ranks_path, pattern)
    return enc.encode_to_numpy(text, allowed_special={SPECIAL} if SPECIAL in text else set(), disallowed_special=())


def pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int) -> DataFrame:
    """``(uid, doc_id, piece, start, length, ids_crc32)``; uid numbers the
    pieces uniquely."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or "", ranks_path, pattern), END_ID).astype("<u4")
                cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            n = len(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + n)), batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=names)
            number += n

    return docs.select("doc_id", "text").mapInArrow(run, f"uid bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# ---- the genetic algorithm on one chunk ---------------------------------
class Bins:
    """Open bins by free space; the tightest bin that fits is the lowest set
    bit of the free-space mask."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free = capacity, [], []
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def _put(self, b: int):
        f = self.free[b]
        if f:
            if not self.at[f]:
                self.mask |= 1 << f
            self.at[f].append(b)

    def add(self, items: list[int], used: int):
        self.items.append(items)
        self.free.append(self.capacity - used)
        self._put(len(self.items) - 1)

    def fit(self, item: int, size: int):
        m = self.mask >> size
        if m:
            f = size + (m & -m).bit_length() - 1
            b = self.at[f].pop()
            if not self.at[f]:
                self.mask ^= 1 << f
            self.items[b].append(item)
            self.free[b] = f - size
            self._put(b)
        else:
            self.add([item], size)


def best_fit(order, sizes, capacity: int, start: Bins | None = None) -> Bins:
    bins = start or Bins(capacity)
    for i in order:
        bins.fit(i, sizes[i])
    return bins


def complement_fit(sizes, capacity: int, rng) -> Bins:
    """Bins opened by the longest piece left and closed exactly where one or
    two pieces of the missing length exist, else by the longest that fits."""
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, s in enumerate(sizes):
        at[s].append(i)
    have = np.array([len(x) for x in at])
    out, top = Bins(capacity), capacity

    def take(s):
        have[s] -= 1
        return at[s].pop()

    while True:
        while top and not have[top]:
            top -= 1
        if not top:
            return out
        items, left = [take(top)], capacity - top
        while left > 0:
            if have[left]:
                items.append(take(left))
                left = 0
                break
            half = (left + 1) // 2
            a = np.arange(half, left)
            pair = np.flatnonzero((have[half:left] > 0) & (have[left - a] > 0) & ((2 * a != left) | (have[half:left] > 1)))
            if len(pair):
                x = half + int(pair[max(0, len(pair) - 1 - int(rng.integers(3)))])
                items += [take(x), take(left - x)]
                left = 0
                break
            one = np.flatnonzero(have[1:left + 1])
            if not len(one):
                break
            x = int(one[max(0, len(one) - 1 - int(rng.integers(3)))]) + 1
            items.append(take(x))
            left -= x
        out.add(items, capacity - left)


def _cost(bins: Bins) -> tuple:
    """Fewer bins first, then fuller ones (sum of squared fills)."""
    return len(bins.items), -sum((bins.capacity - f) ** 2 for f in bins.free)


def crossover(giver: Bins, taker: Bins, sizes, rng, capacity: int) -> Bins:
    full = [b for b, f in enumerate(giver.free) if f <= capacity // 100]
    if not full:
        full = [int(np.argmin(giver.free))]
    n = max(1, int(len(full) * rng.uniform(0.2, 0.6)))
    begin = int(rng.integers(len(full)))
    chosen = [full[(begin + k) % len(full)] for k in range(min(n, len(full)))]
    out, inside = Bins(capacity), set()
    for b in chosen:
        out.add(list(giver.items[b]), capacity - giver.free[b])
        inside.update(giver.items[b])
    loose = []
    for b, items in enumerate(taker.items):
        if inside.isdisjoint(items):
            out.add(list(items), capacity - taker.free[b])
        else:
            loose += [i for i in items if i not in inside]
    loose.sort(key=lambda i: -sizes[i])
    return best_fit(loose, sizes, capacity, out)


def mutate(bins: Bins, sizes, rng, capacity: int) -> Bins:
    """Open bins and up to as many full ones are emptied; their pieces are
    packed anew and the better result is taken."""
    free = np.array(bins.free)
    loose, full = np.flatnonzero(free > 0), np.flatnonzero(free == 0)
    some = rng.choice(full, min(len(full), int(rng.integers(20, 200 + len(loose)))), replace=False) if len(full) else full
    gone = {*loose.tolist(), *some.tolist()}
    items = [i for b in gone for i in bins.items[b]]
    part = [sizes[i] for i in items]
    noisy = np.argsort(-np.array(part, float) * rng.uniform(0.9, 1.1, len(part)))
    best = min((best_fit(noisy.tolist(), part, capacity), complement_fit(part, capacity, rng)), key=_cost)
    out = Bins(capacity)
    for b, own in enumerate(bins.items):
        if b not in gone:
            out.add(list(own), capacity - bins.free[b])
    for own, f in zip(best.items, best.free):
        out.add([items[j] for j in own], capacity - f)
    return out


def to_labels(bins: Bins, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for b, items in enumerate(bins.items):
        out[items] = b
    return out


def from_labels(labels: np.ndarray, sizes, capacity: int) -> Bins:
    out = Bins(capacity)
    order = np.argsort(labels, kind="stable")
    for items in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(order) else []:
        items = items.tolist()
        out.add(items, sum(sizes[i] for i in items))
    return out


def evolve(sizes: list[int], capacity: int, seed: int, guests: list[np.ndarray], population: int, generations: int) -> list[np.ndarray]:
    """One epoch of one island; its individuals, best first."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [from_labels(g, sizes, capacity) for g in guests]
    if not people:
        people += [best_fit(down, sizes, capacity), complement_fit(sizes, capacity, rng)]
    arr = np.array(sizes, float)
    while len(people) < population:
        noisy = np.argsort(-arr * rng.uniform(0.8, 1.2, len(arr)))
        people.append(best_fit(noisy.tolist(), sizes, capacity))
    people.sort(key=_cost)
    for _ in range(generations):
        if len(people[0].items) <= least:  # nothing left to win
            break
        a, b = rng.permutation(min(len(people), 4))[:2] if len(people) > 1 else (0, 0)
        child = crossover(people[a], people[b], sizes, rng, capacity)
        people[-1] = min(child, mutate(child, sizes, rng, capacity), key=_cost)
        people.sort(key=_cost)
    return [to_labels(p, len(sizes)) for p in people]


def _epoch(state: DataFrame, capacity: int, population: int, generations: int, keep: int, seed: int) -> DataFrame:
    schema = "chunk bigint, island int, uids array<bigint>, sizes array<int>, elite array<array<int>>, bins int"

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                guests = [np.array(g, np.int32) for g in r["elite"] or []]
                out = evolve(r["sizes"], capacity, hash((seed, r["chunk"], r["island"])) & 0xFFFFFFFF, guests, population, generations)[:keep]
                yield pa.RecordBatch.from_pylist(
                    [{**{k: r[k] for k in ("chunk", "island", "uids", "sizes")}, "elite": [o.tolist() for o in out], "bins": int(out[0].max()) + 1 if len(out[0]) else 0}],
                    pa.schema([("chunk", pa.int64()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
                               ("elite", pa.list_(pa.list_(pa.int32()))), ("bins", pa.int32())]))

    return state.select("chunk", "island", "uids", "sizes", "elite").mapInArrow(run, schema)


def pack_pieces(items: DataFrame, capacity: int, chunk_items: int = 1 << 15, islands: int = 2, epochs: int = 2,
                population: int = 4, generations: int = 10, elite: int = 2, seed: int = 11) -> DataFrame:
    """``(uid, sequence_id, offset)`` for items ``(uid, length)`` of at most
    ``capacity``. One row holds a chunk, whose size does not grow with the
    table."""
    spark = items.sparkSession
    n = items.count()
    chunks = max(1, -(-n // chunk_items))
    state = (items.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks))).groupBy("chunk")
             .agg(F.sort_array(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("length")))).alias("x"))
             .select("chunk", F.col("x.uid").alias("uids"), F.col("x.length").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                     F.lit(None).cast("array<array<int>>").alias("elite")))
    tasks = min(chunks * islands, max(spark.sparkContext.defaultParallelism, chunks * islands // 4))
    for k in range(epochs):
        state = materialize(spark, _epoch(state.repartition(tasks, "chunk", "island"), capacity, population, generations, elite, seed + k), "islands")
        if k < epochs - 1:  # elites move to the next island and join its own best
            moved = state.select("chunk", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("guests"))
            state = state.join(moved, ["chunk", "island"]).withColumn("elite", F.concat("elite", "guests"))
    w = Window.partitionBy("chunk").orderBy("bins", "island")  # one row per island
    best = state.withColumn("rank", F.row_number().over(w)).filter("rank = 1")
    one = best.select("chunk", F.posexplode(F.arrays_zip("uids", "sizes", F.col("elite")[0].alias("bin"))).alias("k", "x"))
    one = one.select("chunk", F.col("x.uids").alias("uid"), F.col("x.sizes").alias("size"), F.col("x.bin").alias("bin"))
    inside = Window.partitionBy("chunk", "bin").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)  # one sequence
    return one.select("uid", ((F.col("chunk") * (1 << 32) + F.col("bin")) * 2 + 1).alias("sequence_id"),
                      F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("bigint").alias("offset"))


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, **how) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.

    Null text is empty text: its one piece holds the end id. Repeated rows
    and null ids are packed like any other row. Other columns are ignored.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    textops.bounded_batches(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = materialize(spark, pieces(base, ranks_path, pattern, capacity), "pieces")
    full = cut.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("uid") * 2).withColumn("offset", F.lit(0).cast("bigint"))
    part = cut.filter(F.col("length") < capacity)
    packed = materialize(spark, pack_pieces(part.select("uid", "length"), capacity, **how), "packed")
    out = full.unionByName(part.join(packed, "uid"))
    return out.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
