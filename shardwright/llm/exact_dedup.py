"""Operator 5: exact dedup with counting quotient filters.

Each task fingerprints its rows (``fp_bits`` bits of a 64-bit hash of the
text), sorts the fingerprints and packs them, per range of quotients, into a
counting quotient filter: the quotient says where a run of remainders
belongs, three marker bits per slot (occupied, continuation, shifted) make
the table readable, repeated fingerprints become a count. Filters of one
range merge without loss: both are read out as sorted fingerprints, sorted
together and their counts added. Fingerprints counted more than once send
their rows to byte verification, a grouping on the text itself; all other
rows are unique and never move.

Skew: copies inside one Arrow batch are folded to one row before the texts
are shuffled, and a hot fingerprint is one counted slot in every filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import sketches, textops

RANGE_SLOTS = 1 << 18  # fingerprints a merged filter should hold


# ---- the filter ---------------------------------------------------------
class CountingQuotientFilter:
    """Sorted fingerprints with counts in a quotient filter layout.

    Slot ``p`` holds one remainder; ``occupied[q]`` says that quotient ``q``
    has a run, ``continuation[p]`` that the slot continues the run of the
    slot before, ``shifted[p]`` that its remainder is not at its own
    quotient. Counts above one are kept beside the slots, in slot order.
    """

    def __init__(self, q_bits: int, r_bits: int, occupied, used, continuation, shifted, remainders, counts):
        self.q_bits, self.r_bits = q_bits, r_bits
        self.occupied, self.used, self.continuation, self.shifted = occupied, used, continuation, shifted
        self.remainders, self.counts = remainders, counts

    @classmethod
    def build(cls, fps: np.ndarray, counts: np.ndarray, bits: int) -> "CountingQuotientFilter":
        """From distinct sorted fingerprints of ``bits`` bits and their counts."""
        q_bits = min(max(int(len(fps) * 1.34).bit_length(), 1), bits)
        r_bits = bits - q_bits
        q = (fps >> np.uint64(r_bits)).astype(np.int64) if r_bits < 64 else np.zeros(len(fps), np.int64)
        r = fps & np.uint64((1 << r_bits) - 1)
        i = np.arange(len(fps))
        slot = np.maximum.accumulate(q - i) + i if len(fps) else i  # first free slot at or after the quotient
        size = max(1 << q_bits, int(slot[-1]) + 1 if len(fps) else 1)
        occupied, used, cont, shifted = (np.zeros(size, bool) for _ in range(4))
        occupied[q] = True
        used[slot] = True
        cont[slot[1:][q[1:] == q[:-1]]] = True
        shifted[slot[slot != q]] = True
        rem = np.zeros(size, np.uint64)
        rem[slot] = r
        c = np.zeros(size, np.int64)
        c[slot] = counts
        return cls(q_bits, r_bits, occupied, used, cont, shifted, rem, c)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts, read back from the slots:
        the i-th run belongs to the i-th occupied quotient."""
        slot = np.flatnonzero(self.used)
        run = np.cumsum(~self.continuation[slot]) - 1
        q = np.flatnonzero(self.occupied)[run] if len(slot) else np.zeros(0, np.int64)
        fp = (q.astype(np.uint64) << np.uint64(self.r_bits) if self.r_bits < 64 else np.zeros(len(q), np.uint64)) | self.remainders[slot]
        return fp, self.counts[slot]

    def merge(self, other: "CountingQuotientFilter") -> "CountingQuotientFilter":
        """Both filters' fingerprints in one, counts added; nothing is lost."""
        (a, ca), (b, cb) = self.items(), other.items()
        return type(self).build(*add_counts(np.concatenate((a, b)), np.concatenate((ca, cb))), self.q_bits + self.r_bits)

    def to_bytes(self) -> bytes:
        width = 4 if self.r_bits <= 32 else 8
        slot = np.flatnonzero(self.used)
        c = self.counts[slot]
        many = np.flatnonzero(c > 1)
        head = np.array([self.q_bits, self.r_bits, len(self.used), len(slot), len(many)], np.int64).tobytes()
        marks = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.used, self.continuation, self.shifted))
        return head + marks + self.remainders[slot].astype(f"<u{width}").tobytes() + many.astype("<i8").tobytes() + c[many].astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "CountingQuotientFilter":
        q_bits, r_bits, size, n, m = np.frombuffer(raw, np.int64, 5).tolist()
        at, step = 40, (size + 7) // 8
        marks = []
        for _ in range(4):
            marks.append(np.unpackbits(np.frombuffer(raw, np.uint8, step, at))[:size].astype(bool))
            at += step
        width = 4 if r_bits <= 32 else 8
        slot = np.flatnonzero(marks[1])
        rem = np.zeros(size, np.uint64)
        rem[slot] = np.frombuffer(raw, f"<u{width}", n, at)
        at += width * n
        counts = np.zeros(size, np.int64)
        counts[slot] = 1
        counts[slot[np.frombuffer(raw, "<i8", m, at)]] = np.frombuffer(raw, "<i8", m, at + 8 * m)
        return cls(q_bits, r_bits, *marks, rem, counts)


def add_counts(fps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(fps, kind="stable")
    fps, counts = fps[o], counts[o]
    first = np.flatnonzero(np.append(True, fps[1:] != fps[:-1])) if len(fps) else np.zeros(0, np.int64)
    return fps[first], np.add.reduceat(counts, first) if len(fps) else counts


# ---- the Spark jobs -----------------------------------------------------
def count_filters(hashed: DataFrame, n_ranges: int, fp_bits: int = 64) -> DataFrame:
    """Merged filters ``(range, filter)`` of the ``fp`` column: one filter per
    task and quotient range, merged per range after one shuffle."""
    width = fp_bits
    range_bits = min(max(n_ranges - 1, 0).bit_length(), fp_bits - 1)
    low = width - range_bits

    def build(batches):
        fps, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            new = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - width)
            fps, counts = add_counts(np.concatenate((fps, new)), np.concatenate((counts, np.ones(len(new), np.int64))))
            if len(fps) > (1 << 20):
                yield from packed(fps, counts)
                fps, counts = fps[:0], counts[:0]
        yield from packed(fps, counts)

    def packed(fps, counts):
        rng = (fps >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(len(fps), np.int64)
        cut = np.flatnonzero(np.append(True, rng[1:] != rng[:-1])) if len(fps) else []
        for a, z in zip(cut, np.append(cut[1:], len(fps)).astype(int)):
            f = CountingQuotientFilter.build(fps[a:z] & np.uint64((1 << low) - 1), counts[a:z], low)
            yield pa.RecordBatch.from_arrays([pa.array([int(rng[a])], pa.int64()), pa.array([f.to_bytes()], pa.large_binary()).cast(pa.binary())], names=["range", "filter"])

    def merge(batches):
        # rows arrive sorted by range: one merged filter is held at a time
        held, at = None, None
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = CountingQuotientFilter.from_bytes(raw)
                if k != at:
                    if held:
                        yield out(at, held)
                    held, at = [], k
                held.append(f)
                if len(held) > 8:
                    held = [joined(held)]
        if held:
            yield out(at, held)

    def joined(held):
        parts = [f.items() for f in held]
        return CountingQuotientFilter.build(*add_counts(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])), low)

    def out(k, held):
        f = held[0] if len(held) == 1 else joined(held)
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([f.to_bytes()], pa.large_binary()).cast(pa.binary())], names=["range", "filter"])

    schema = "range bigint, filter binary"
    return (hashed.select("fp").mapInArrow(build, schema)
            .repartition(1 << range_bits, "range").sortWithinPartitions("range").mapInArrow(merge, schema))


def repeated_fingerprints(filters: DataFrame, n_ranges: int, fp_bits: int = 64) -> DataFrame:
    """``(fp, n)`` of every fingerprint that the filters count above one."""
    low = fp_bits - min(max(n_ranges - 1, 0).bit_length(), fp_bits - 1)

    def read(batches):
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fp, n = CountingQuotientFilter.from_bytes(raw).items()
                fp, n = fp[n > 1], n[n > 1]
                whole = fp | (np.uint64(k) << np.uint64(low)) if low < 64 else fp
                yield pa.RecordBatch.from_arrays([pa.array((whole << np.uint64(64 - fp_bits)).view(np.int64)), pa.array(n)], names=["fp", "n"])

    return filters.mapInArrow(read, "fp bigint, n bigint")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize=None,
                fp_bits: int = 64, range_slots: int = RANGE_SLOTS, bitmap_bits: int = 24) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept,
    text_sha256``. ``normalize`` maps the text column to the compared one
    (default: no change).

    Null text equals empty text. Of equal texts the row with the largest id
    stays (null ids are smaller than any other). Rows that repeat an id with
    the same text are each reported; all rows that carry the kept id are
    kept. Other columns are ignored, so their names cannot clash. An empty
    table gives an empty result. ``fp_bits`` below 64 makes fingerprints
    collide (tests): byte verification keeps different texts apart. Two
    different texts with one SHA-256 would raise an error.
    """
    spark = docs.sparkSession
    textops.bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalize(text) if normalize else text
    mask = -1 << (64 - fp_bits)
    fp = F.xxhash64(text).bitwiseAND(F.lit(mask)) if fp_bits < 64 else F.xxhash64(text)
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("fp", fp if not normalize else _fp("text", fp_bits))
    rows = materialize(spark, base.select("id", "fp", F.sha2("text", 256).alias("sha")), "exact-rows")
    n_ranges = max(1, -(-rows.count() // range_slots))
    filters = count_filters(rows, n_ranges, fp_bits)
    twice = materialize(spark, repeated_fingerprints(filters, n_ranges, fp_bits), "exact-twice")
    routed = _fold_copies(base, sketches.share(spark, sketches.key_bitmap(twice, "fp", bitmap_bits)))
    # byte verification: the grouping key is the text itself
    same = (routed.join(twice.select("fp"), "fp", "left_semi")
            .groupBy("fp", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")))
    groups = (same.select("fp", F.sha2("text", 256).alias("sha"), "keep_id", "group_size")
              .groupBy("fp", "sha").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    groups = groups.select("fp", "sha", "keep_id", F.when(F.col("texts") == 1, F.col("group_size"))
                           .otherwise(F.raise_error(F.lit("two texts with one SHA-256")).cast("bigint")).alias("group_size"))
    res = rows.join(groups, ["fp", "sha"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return res.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
                      F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def _fp(col: str, fp_bits: int) -> Column:
    h = F.xxhash64(F.col(col))
    return h.bitwiseAND(F.lit(-1 << (64 - fp_bits))) if fp_bits < 64 else h


def _fold_copies(base: DataFrame, bitmap) -> DataFrame:
    """Rows whose fingerprint may repeat, equal texts of one batch folded to
    ``(fp, text, id = largest, n)``."""
    id_type = dict(base.dtypes)["id"]

    def fold(batches):
        for b in batches:
            fp = b.column(1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(sketches.in_bitmap(bitmap.value, fp))
            if not len(hit):
                continue
            t = pa.Table.from_batches([b.take(pa.array(hit))])
            g = t.group_by(["fp", "text"]).aggregate([("id", "max"), ("id", "count", pc.CountOptions(mode="all"))])
            yield from g.select(["fp", "text", "id_max", "id_count"]).rename_columns(["fp", "text", "id", "n"]).combine_chunks().to_batches()

    return base.select("id", "fp", "text").mapInArrow(fold, f"fp bigint, text string, id {id_type}, n bigint")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that ``find_copies`` drops, same columns.
    Rows with a null id share one decision per text, as all rows do that
    carry the same id and text."""
    gone = find_copies(docs, id_col, text_col, **how).filter("not kept").select(F.col(id_col).alias("id"), "text_sha256").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = how["normalize"](text) if how.get("normalize") else text
    return sketches.without(docs, gone, [(F.col(id_col), "id"), (F.sha2(text, 256), "text_sha256")])
