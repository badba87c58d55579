"""Operator 9: n-gram Jaccard join by vertical partitioning.

All word n-grams get one global order, rare before frequent: (frequency
class, hash), the class read off a counting sketch of fixed size. The order
is cut into fragments and with it every text's n-gram set. For each
candidate pair the overlap is counted in every fragment separately (a join
on text and fragment) and the partial counts are summed per pair; a pair
links when ``den * intersection >= num * union``, exactly.

Candidates share an n-gram among the first ``n - ceil(num/den * n) + 1`` of
their sets in the global order, which every linked pair must; sizes and
positions of the shared n-gram prune further, without loss.

Copies and large groups: texts with equal sets are one node. Each shared
n-gram first pairs its texts with ``CENTERS`` of them drawn by hash (stars,
linear in the group), and only n-grams that still see several components
produce further pairs, between texts of different components. A pair inside one component needs no
test: it cannot change the components. So a group of near copies costs its
size, not its square, and no link between components is lost.

Before sets are compared, each candidate pair passes an exact bound: a
set's parity vector says which buckets hold an odd number of its elements,
and two vectors differ in at most as many bits as the sets differ in
elements. Pairs that differ in too many bits cannot link: a vector of 512
bits is part of the join condition between components, so the pairs of a
group of texts below the threshold are never emitted, and one of about a bit
per element is checked after it.

What travels: prefix entries (about 15 % of the n-grams as numbers), parity
vectors, then the sets of the pairs that are left. The sketch (2**22
classes, 4 MB) and the candidates' bitmap (2 MB) have fixed sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import sketches, textops
from .components import components

SKETCH_BITS = 22
_CHUNK = 1 << 16
FRAGMENTS = 4
CENTERS = 16  # stars per shared n-gram
QUICK = 512  # bits of the parity vector in the join condition
_U = np.uint64


class Shingler:
    """Distinct word n-gram sets of a batch's texts, block by block."""

    def __init__(self, n_words: int, word_bytes: str = "nonspace"):
        self.n, self.word_bytes = n_words, word_bytes

    def sets(self, column: pa.Array):
        """Yields ``(a, b, offsets, values)`` for rows ``a..b``."""
        in_word, fold = textops.byte_class(self.word_bytes), textops.ascii_fold()
        offs, data = textops.utf8(column)
        for a, b in textops.blocks(offs):
            o = offs[a:b + 1] - offs[a]
            doc, _, _, h = textops.words(data[offs[a]:offs[b]], o, in_word, fold)
            d, _, g = textops.ngrams(doc, h, self.n, b - a)
            yield a, b, *textops.sorted_sets(d, g, b - a)


def _node(offs: np.ndarray, values: np.ndarray, salt: int) -> np.ndarray:
    """64-bit key of each set (order-free); 0 sum for an empty one."""
    total = np.append(np.uint64(0), np.cumsum(textops.mix(values ^ _U(salt)), dtype=np.uint64))
    return textops.mix(total[offs[1:]] - total[offs[:-1]] + np.diff(offs).astype(np.uint64))


def parities(offs: np.ndarray, values: np.ndarray) -> list[bytes]:
    """Parity vector of each set: bit ``v mod B`` says whether an odd number
    of elements fall there, B the power of two at or above the set's size."""
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        size = 1 << max(6, (b - a - 1).bit_length())
        out.append(np.packbits(np.bincount((values[a:b] & _U(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes())
    return out


def quick_parities(offs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``int64[sets, QUICK / 64]``: parity vectors of one fixed size."""
    m = len(offs) - 1
    cell = np.repeat(np.arange(m), np.diff(offs)) * QUICK + (values & _U(QUICK - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=m * QUICK) & 1).astype(np.uint8).reshape(m, QUICK)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two parity vectors differ, the longer folded."""
    x, y = (a, b) if len(a) >= len(b) else (b, a)
    v = int.from_bytes(x, "little")
    size = len(x) * 8
    while size > len(y) * 8:
        size //= 2
        v = (v >> size) ^ (v & ((1 << size) - 1))
    return (v ^ int.from_bytes(y, "little")).bit_count()


_SALT, _SALT2 = 0x5851F42D4C957F2D, 0x14057B7EF767814F


def profile(docs: DataFrame, shingler: Shingler) -> DataFrame:
    """One pass: per row ``(id, n, node, check, parity)``, and per task the chunks
    ``(chunk, counts)`` of its n-gram counting sketch."""
    kind = dict(docs.dtypes)["id"]
    names = ["id", "n", "node", "check", "parity", "quick", "chunk", "task", "counts"]
    schema = f"id {kind}, n bigint, node bigint, check bigint, parity binary, quick array<bigint>, chunk int, task int, counts binary"

    def run(batches):
        counts, arrow_id, task = np.zeros(1 << SKETCH_BITS, np.uint32), None, TaskContext.get().partitionId()
        for batch in batches:
            ids, arrow_id = batch.column(0), batch.column(0).type
            for a, b, o, v in shingler.sets(batch.column(1)):
                np.add.at(counts, (v >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
                m = b - a
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, m), pa.array(np.diff(o), pa.int64()), pa.array(textops.signed(_node(o, v, _SALT))),
                     pa.array(textops.signed(_node(o, v, _SALT2))), pa.array(parities(o, v), pa.binary()),
                     textops.lists(np.arange(m + 1) * (QUICK // 64), quick_parities(o, v).ravel(), pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                    names=names)
        for c in np.flatnonzero(counts.reshape(-1, _CHUNK).any(axis=1)):
            part = sketches.pack_counts(counts[c * _CHUNK:(c + 1) * _CHUNK])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, arrow_id), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                 pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())), pa.array([c], pa.int32()),
                 pa.array([task], pa.int32()), pa.array([part], pa.binary())], names=names)

    return docs.select("id", "text").mapInArrow(run, schema)


def frequency_classes(profiled: DataFrame) -> np.ndarray:
    """``uint8[2**22]``: class of each sketch cell, 0 up to twice the mean
    count, then one step per factor of sqrt(2). The collected table has 64
    rows whatever the input."""
    parts = profiled.filter("chunk IS NOT NULL").select("chunk", "task", F.col("counts").alias("packed"))
    rows = sketches.merge_tasks(parts, ["chunk"], sketches.add_counts, sketches.pack_counts).collect()
    chunks = {c: sketches.unpack_counts(raw) for c, raw in rows}
    mean = max(sum(int(x.sum()) for x in chunks.values()) / (1 << SKETCH_BITS), 0.5)
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for c, x in chunks.items():  # a chunk at a time: the driver holds the counts once
        out[c * _CHUNK:(c + 1) * _CHUNK] = np.clip(np.floor(2 * np.log2(np.maximum(x, 1) / mean)) - 1, 0, 31)
    return out


def _order_key(classes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of an n-gram in the global order."""
    return (classes[(values >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << _U(59)) | (values >> _U(5))


def _ordered(classes, offs, values):
    key = _order_key(classes, values)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        key[a:b].sort()
    return key


def prefixes(docs: DataFrame, shingler: Shingler, classes, num: int, den: int) -> DataFrame:
    """``(key, node, n, pos)`` of each set's prefix; equal sets met by one
    task are emitted once."""
    def run(batches):
        seen: set = set()
        for batch in batches:
            for a, b, o, v in shingler.sets(batch.column(0)):
                node, n = _node(o, v, _SALT), np.diff(o)
                new = np.zeros(b - a, bool)
                for i, x in enumerate(node.tolist()):
                    if n[i] and x not in seen:
                        new[i] = True
                        seen.add(x)
                if len(seen) > 1_000_000:  # bounded; a copy emitted again is folded later
                    seen.clear()
                key = _ordered(classes.value, o, v)
                doc = np.repeat(np.arange(b - a), n)
                pos = np.arange(len(key)) - o[doc]
                take = new[doc] & (pos < (n - (num * n + den - 1) // den + 1)[doc])
                doc = doc[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(textops.signed(key[take])), pa.array(textops.signed(node[doc])), pa.array(n[doc].astype(np.int32)),
                     pa.array(pos[take].astype(np.int32))], names=["key", "node", "n", "pos"])

    return docs.select("text").mapInArrow(run, "key bigint, node bigint, n int, pos int")


def segments(docs: DataFrame, shingler: Shingler, classes, bitmap) -> DataFrame:
    """``(node, frag, seg)``: the sets of the nodes in the bitmap, cut at the
    fragment borders of the global order; one row per node and fragment."""
    def run(batches):
        seen: set = set()
        for batch in batches:
            for a, b, o, v in shingler.sets(batch.column(0)):
                node = _node(o, v, _SALT)
                hit = [i for i in np.flatnonzero(sketches.in_bitmap(bitmap.value, node) & (np.diff(o) > 0)).tolist()]
                rows = []
                for i in hit:
                    if int(node[i]) in seen:
                        continue
                    seen.add(int(node[i]))
                    key = np.sort(_order_key(classes.value, v[o[i]:o[i + 1]]))
                    cut = np.searchsorted(key, _borders())
                    rows += [(i, f, key[s:e]) for f, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s]
                if len(seen) > 1_000_000:
                    seen.clear()
                if rows:
                    sizes = np.cumsum([0] + [len(r[2]) for r in rows])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(textops.signed(node[[r[0] for r in rows]])), pa.array([r[1] for r in rows], pa.int32()),
                         textops.lists(sizes, textops.signed(np.concatenate([r[2] for r in rows])), pa.int64())],
                        names=["node", "frag", "seg"])

    rows = docs.select("text").mapInArrow(run, "node bigint, frag int, seg array<bigint>")
    return rows.repartition("node").dropDuplicates(["node", "frag"])


def _borders() -> np.ndarray:
    """Fragment borders: the rarest class in FRAGMENTS - 1 equal hash ranges,
    all more frequent n-grams in the last fragment."""
    first = [(i << 59) // (FRAGMENTS - 1) for i in range(FRAGMENTS)]
    return np.array(first + [(1 << 64) - 1], np.uint64)


def verify(pairs: DataFrame, segs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b, na, nb)`` that link: overlaps counted per fragment,
    summed per pair."""
    left = segs.select(F.col("node").alias("a"), "frag", F.col("seg").alias("sa"))
    right = segs.select(F.col("node").alias("b"), "frag", F.col("seg").alias("sb"))
    part = (pairs.join(right, "b").join(left, ["a", "frag"])
            .select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("part")))
    both = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return both.filter(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num)


def plausible(pairs: DataFrame, parity: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose parity vectors do not rule the link out."""
    def run(batches):
        for b in batches:
            na, nb = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().astype(np.int64)
            most = na + nb - 2 * (-(-(na + nb) * num // (num + den)))
            x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
            ok = [i for i in range(len(x)) if differing_bits(x[i], y[i]) <= most[i]]
            yield b.take(pa.array(ok, pa.int64())).select(["a", "b", "na", "nb"])

    both = (pairs.join(parity.select(F.col("node").alias("a"), F.col("parity").alias("pa")), "a")
            .join(parity.select(F.col("node").alias("b"), F.col("parity").alias("pb")), "b"))
    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a bigint, b bigint, na int, nb int")


def _possible(na, nb, pa_, pb, num, den):
    """Size and position bounds of a pair whose first shared n-gram of the
    global order stands at ``pa_`` and ``pb``."""
    need = F.ceil((na + nb) * num / F.lit(num + den))
    return ((F.least(na, nb) * den >= F.greatest(na, nb) * num)
            & (1 + F.least(na - pa_ - 1, nb - pb - 1) >= need))


def _near_parity(num, den):
    """The fixed parity vectors differ in no more bits than linked sets of
    these sizes may differ in elements."""
    total = F.col("x.n") + F.col("y.n")
    bits = sum((F.bit_count(F.get(F.col("x.quick"), k).bitwiseXOR(F.get(F.col("y.quick"), k))) for k in range(1, QUICK // 64)),
               F.bit_count(F.get(F.col("x.quick"), 0).bitwiseXOR(F.get(F.col("y.quick"), 0))))
    return bits <= total - 2 * F.ceil(total * num / F.lit(num + den))


def find_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5,
              num: int = 80, den: int = 100, word_bytes: str = "nonspace") -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id``.

    A text's set: its distinct ``n_words``-word n-grams (A-Z lower-cased),
    its whole word sequence if it has fewer words, nothing if it has none.
    Two texts link when ``den * both >= num * either``; ``component_id`` is
    the smallest id reachable over links, itself included (null ids are
    passed over; a component of null ids only has a null component). Null
    and empty texts have no n-grams, link with nothing, and keep their own
    id. Repeated rows are linked copies. Other columns are ignored. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    textops.bounded_batches(spark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sh = Shingler(n_words, word_bytes)
    prof = materialize(spark, profile(base, sh), "jaccard-profile")
    rows = prof.filter("n IS NOT NULL")
    classes = spark.sparkContext.broadcast(frequency_classes(prof))
    # prefix entries: texts of equal sets folded, keys of one text dropped
    e = prefixes(base, sh, classes, num, den).repartition("key").dropDuplicates(["key", "node"])
    w = Window.partitionBy("key")
    multi = materialize(spark, e.withColumn("low", F.min("node").over(w)).withColumn("high", F.max("node").over(w))
                        .filter("low != high").drop("low", "high"), "jaccard-shared")
    drawn = F.array(*[F.min_by(F.struct("node", "n", "pos"), F.xxhash64("node", F.lit(i))).over(w) for i in range(CENTERS)])
    stars = multi.withColumn("drawn", drawn).withColumn("c", F.explode(F.array_distinct("drawn"))).filter(F.col("node") != F.col("c.node")).filter(
        _possible(F.col("c.n"), F.col("n"), F.col("c.pos"), F.col("pos"), num, den))
    first = F.col("node") < F.col("c.node")
    parity = rows.filter("n > 0").select("node", "parity").dropDuplicates(["node"])
    stars = materialize(spark, stars.select(
        F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"), F.when(first, F.col("n")).otherwise(F.col("c.n")).alias("na"),
        F.when(first, F.col("c.n")).otherwise(F.col("n")).alias("nb")).distinct(), "jaccard-stars")
    linked = materialize(spark, _checked(spark, base, sh, classes, stars, parity, num, den), "jaccard-links")
    label = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # n-grams that still see several components
    tagged = (multi.join(label.withColumnRenamed("label", "comp"), "node", "left")
              .select("key", "node", "n", "pos", F.coalesce("comp", "node").alias("comp")))
    apart = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    quick = rows.filter("n > 0").select("node", "quick").dropDuplicates(["node"])
    open_ = materialize(spark, tagged.join(apart, "key", "left_semi").join(quick, "node"), "jaccard-open")
    x, y = open_.alias("x"), open_.alias("y")
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
                  & _possible(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos"), num, den) & _near_parity(num, den))
    more = more.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
    more = materialize(spark, more.join(stars.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-more")
    if more.limit(1).count():
        extra = materialize(spark, _checked(spark, base, sh, classes, more, parity, num, den), "jaccard-links")
        if extra.limit(1).count():
            label = components(linked.union(extra).select(F.col("a").alias("u"), F.col("b").alias("v")))
    sets = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("low"), F.min("check").alias("c0"), F.max("check").alias("c1"))
    sets = sets.select("node", F.when(F.col("c0") == F.col("c1"), F.col("low")).otherwise(
        F.raise_error(F.lit("two n-gram sets with one 64-bit key")).cast(dict(base.dtypes)["id"])).alias("low"))
    named = sets.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    comp = named.join(named.groupBy("label").agg(F.min("low").alias("component_id")), "label").select("node", "component_id")
    return (rows.join(comp, "node", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))


def _checked(spark, base, sh, classes, pairs, parity, num, den) -> DataFrame:
    pairs = materialize(spark, plausible(pairs, parity, num, den), "jaccard-plausible")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    bitmap = sketches.share(spark, sketches.key_bitmap(nodes, "node"))
    segs = materialize(spark, segments(base, sh, classes, bitmap), "jaccard-segments")
    return verify(pairs, segs, num, den)


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component: the one with the
    smallest id stays. Rows with a null id stay unless their component has
    an id. Same columns."""
    found = materialize(docs.sparkSession, find_near(docs, id_col, text_col, **how), "jaccard-found")
    gone = found.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("id")).distinct()
    return sketches.without(docs, gone, [(F.col(id_col), "id")])
