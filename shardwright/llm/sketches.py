"""Bounded bitmaps of 64-bit keys.

A bitmap holds the top ``bits`` bits of every key of a table (whose keys are
uniform hashes). Its size is ``2**bits / 8`` bytes whatever the table holds,
so it can be sent to every task. A key that is not in it is certainly not in
the table; a key that is may not be (the exact join that follows decides).
With far more keys than bits it lets everything pass: the result stays
right, only the saving is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CHUNK_BITS = 16


def pack_counts(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype("<i8").tobytes(), 1)


def unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), "<i8")


def add_counts(packed: bytes, held: np.ndarray | None) -> np.ndarray:
    """``read`` of ``merge_tasks`` for vectors of counts."""
    x = unpack_counts(packed)
    return x if held is None else held + x


def hash_bound(n: int, wanted: int) -> float:
    """Upper bound of uniform signed 64-bit hashes that some more than
    ``wanted`` of ``n`` pass: a filter in the tasks before the smallest
    ``wanted`` are sorted out, so that no task sends as many itself."""
    return min(2.0 ** 63, -(2.0 ** 63) + 2.0 ** 64 * (wanted + 6 * wanted ** 0.5 + 20) / max(n, 1))


FAN = 64  # tasks whose vectors one task merges at a time


def merge_tasks(parts: DataFrame, keys: list[str], read, write) -> DataFrame:
    """``(*keys, packed)``: the vectors of ``parts(*keys, task, packed)``
    merged over all tasks. ``read(packed, held)`` adds a vector to what is
    held (None at first), ``write(held)`` packs it.

    ``FAN`` tasks' vectors are merged at a time, level by level, so a task
    reads at most ``FAN`` vectors of a key whatever the number of tasks and
    holds one of them.
    """
    spark = parts.sparkSession
    kinds = dict(parts.dtypes)
    cols = [*keys, "task", "packed"]

    def merge(batches):
        at, held = None, None

        def out():
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(at, types[:-1])), pa.array([write(held)], pa.binary())], names=cols)

        types: list = []
        for b in batches:
            types = types or [b.schema.field(i).type for i in range(len(cols))]
            for row in zip(*(b.column(i).to_pylist() for i in range(len(cols)))):
                if row[:-1] != at:
                    if at is not None:
                        yield out()
                    at, held = row[:-1], None
                held = read(row[-1], held)
        if at is not None:
            yield out()

    schema = ", ".join(f"{c} {kinds[c]}" for c in cols)
    while True:
        level = parts.select(*keys, F.floor(F.col("task") / FAN).cast(kinds["task"]).alias("task"), "packed")
        parts = materialize(spark, level.repartition(F.xxhash64(*keys, "task")).sortWithinPartitions(*keys, "task").mapInArrow(merge, schema), "merged")
        if not (parts.agg(F.max("task")).first()[0] or 0):
            return parts.drop("task")


def key_bitmap(keys: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """``uint8[2**bits / 8]``, built per task, OR-ed per chunk (see
    ``merge_tasks``)."""
    n_chunks = 1 << max(bits - CHUNK_BITS, 0)
    each = (1 << bits) // n_chunks

    def build(batches):
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            k = b.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            top = (k >> np.uint64(64 - bits)).astype(np.int64)
            for c in np.unique(top // each):
                m = seen.setdefault(int(c), np.zeros(each, bool))
                m[top[top // each == c] % each] = True
        task = TaskContext.get().partitionId()
        for c, m in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([task], pa.int32()), pa.array([np.packbits(m).tobytes()], pa.binary())],
                                             names=["chunk", "task", "packed"])

    def read(packed, held):
        x = np.frombuffer(packed, np.uint8)
        return x if held is None else held | x

    parts = keys.select(F.col(column).cast("bigint")).mapInArrow(build, "chunk int, task int, packed binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    step = each // 8
    for c, packed in merge_tasks(parts, ["chunk"], read, bytes).collect():  # at most n_chunks rows, 2**bits / 8 bytes in all
        out[c * step:(c + 1) * step] = np.frombuffer(packed, np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = len(bitmap) * 8
    top = (keys.view(np.uint64) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return (bitmap[top >> 3] >> (7 - (top & 7)).astype(np.uint8) & 1).astype(bool)


def share(spark, bitmap: np.ndarray):
    """Broadcast variable of a bitmap (fixed size)."""
    return spark.sparkContext.broadcast(bitmap)


def maybe_in(bitmap):
    """Column function: may this bigint key be in the shared bitmap?"""
    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bitmap.value, h.to_numpy(zero_copy_only=False)))

    return maybe


def without(docs: DataFrame, gone: DataFrame, keys: list, bits: int = 24) -> DataFrame:
    """``docs`` less the rows whose keys are in ``gone``; same columns.

    ``keys`` pairs a column expression over ``docs`` with a column name of
    ``gone``; null equals null. Rows that the bitmap of ``gone`` clears stay
    where they are; only the others are shuffled for the exact anti join.
    """
    spark = docs.sparkSession
    gone = gone.select(*[F.col(g).alias(f"__g{i}") for i, (_, g) in enumerate(keys)])
    named = [f"__g{i}" for i in range(len(keys))]
    bitmap = share(spark, key_bitmap(gone.select(F.xxhash64(*named).alias("h")), "h", bits))

    tagged = docs.withColumn("__maybe", maybe_in(bitmap)(F.xxhash64(*[k for k, _ in keys])))
    exact = None
    for (k, _), g in zip(keys, named):
        exact = k.eqNullSafe(F.col(g)) if exact is None else exact & k.eqNullSafe(F.col(g))
    stay = tagged.filter(~F.col("__maybe"))
    return stay.unionByName(tagged.filter("__maybe").join(gone, exact, "left_anti")).select(*[F.col(f"`{c}`") for c in docs.columns])
