"""Operator 10: substring dedup with suffix arrays.

Every byte covered by a ``length``-byte string that also starts elsewhere is
removed; strings are judged on the input.

1. Equal texts are folded to one (their texts of at least ``length`` bytes
   are repeated from end to end).
2. A first pass keeps one anchor per window: the ``3/4 length``-byte grams
   whose hash is smallest in some run of ``length / 4 + 1`` starts. Every
   ``length``-byte string holds such an anchor, chosen by its content alone,
   so both ends of a repeat hold the same one. Anchors counted once cannot
   be in a repeat.
3. A second pass gathers the starts around repeated anchors into shards of
   bounded bytes. Each shard sorts its suffixes by Larsson-Sadakane
   refinement (prefix doubling over the groups that are still unsorted),
   takes common prefixes by Kasai's rule, and so knows which strings repeat
   inside the shard.
4. Each shard's distinct strings go out as sorted fingerprints, cut by
   range. Shards of one range are merged two by two: a binary search of one
   sorted run in the other finds the strings both hold and the places where
   the rest belong.
5. The starts found repeated become byte spans per text; only texts with
   spans are read again.

Nothing but anchors, fingerprints of candidate starts and affected texts is
shuffled. The bitmap of repeated anchors has a fixed size; when it is full
more starts are candidates, and the result is the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import sketches, textops
from .exact_dedup import _fold_copies

SHARD_BYTES = 1 << 19  # small enough for ranks to stay in cache
_U = np.uint64


# ---- one shard ----------------------------------------------------------
def _words8(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one big-endian number."""
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << _U(8)) | padded[k:k + len(text)]
    return out


def suffix_array(text: np.ndarray, words8: np.ndarray | None = None) -> np.ndarray:
    """Sorted suffix starts by Larsson-Sadakane refinement: sort by the first
    8 bytes, then by (own group, group of the suffix h further on) with h
    doubling, touching only groups of more than one suffix."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    words8 = _words8(text) if words8 is None else words8
    sa = np.argsort(words8).astype(np.int32)
    # a suffix shorter than its 8 padded bytes comes before a longer equal one
    k = words8[sa]
    tail = words8[max(0, n - 8):]
    left = np.minimum(n - sa, 8) if (np.searchsorted(k, tail, "right") - np.searchsorted(k, tail) > 1).any() else None
    if left is not None:
        o = np.lexsort((left, k))
        sa, k, left = sa[o], k[o], left[o]
    new = np.append(True, k[1:] != k[:-1])
    if left is not None:
        new[1:] |= left[1:] != left[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[sa] = head
    last = np.append(new[1:], True)
    active = np.flatnonzero(~(new & last)).astype(np.int32)
    h = 8
    while len(active):
        pos = sa[active]
        key = rank[pos].astype(np.int64) * (n + 1) + rank[np.minimum(pos + h, n)] + 1
        o = np.argsort(key)
        key, pos = key[o], pos[o]
        sa[active] = pos
        first = np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(key), dtype=np.int32), 0))
        rank[pos] = active[start]
        last = np.append(first[1:], True)
        active = active[~(first & last)]
        h *= 2
    return sa


def kasai(text: np.ndarray, sa: np.ndarray, cap: int, words8: np.ndarray | None = None, stride: int = 16) -> np.ndarray:
    """``lcp[j]``: common prefix of suffixes ``sa[j-1]`` and ``sa[j]``, up to
    ``cap``. By Kasai's rule a suffix keeps all but one byte of its left
    neighbour's common prefix; every ``stride``-th text position advances
    together, eight bytes a step."""
    n = len(text)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    words8 = _words8(text) if words8 is None else words8
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    for t in range(min(stride, n)):
        i = np.arange(t, n, stride)
        l = np.maximum(plcp[i - 1] - 1, 0) if t else np.zeros(len(i), np.int64)
        j = before[i]
        l[j < 0] = 0
        most = np.minimum(n - np.maximum(i, j), cap)
        todo = np.flatnonzero((j >= 0) & (l < most))
        while len(todo):
            x = words8[i[todo] + l[todo]] ^ words8[j[todo] + l[todo]]
            same = _equal_bytes(x)
            l[todo] = np.minimum(l[todo] + same, most[todo])
            todo = todo[(same == 8) & (l[todo] < most[todo])]
        plcp[i] = l
    lcp[:] = plcp[sa]
    lcp[0] = 0
    return lcp


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading equal bytes of two words from their xor."""
    out = np.full(len(x), 8, np.int64)
    differ = np.flatnonzero(x)
    y = x[differ]
    out[differ] = sum((y >> _U(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
    return out


def repeat_classes(text: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, class)`` of the valid starts, in suffix order: equal class
    means equal ``length`` bytes."""
    w = _words8(text)
    sa = suffix_array(text, w)
    group = np.cumsum(kasai(text, sa, length, w) < length)
    keep = valid[sa]
    return sa[keep], group[keep]


# ---- anchors ------------------------------------------------------------
def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each run of ``w`` values: ``len(x) - w + 1`` results."""
    n = len(x)
    y = np.concatenate((x, np.full((-n) % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


_PLACE = _U((1 << 31) - 1)


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(position, fingerprint)`` of the anchors of a block's texts: the
    gram with the smallest hash in each run, the first of equal ones. The
    hash's top 33 bits and the position are one number, so the smallest
    number names its position."""
    k = 3 * length // 4
    w = length - k + 1
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = textops.prefix_hash(data)
    _, inverse = textops._powers(n)
    gram = (prefix[k:] - prefix[:-k]) * inverse[:n - k + 1]
    order = (gram ^ (gram >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    low = _slide_min((order & ~_PLACE) | np.arange(n - k + 1, dtype=np.uint64), w)
    inside = np.zeros(n + 1, np.int8)  # starts of whole strings
    first, last = offs[:-1], offs[1:] - length + 1
    some = last > first
    inside[first[some]] = 1
    inside[last[some]] -= 1
    at = (low[np.cumsum(inside, dtype=np.int8)[:len(low)].astype(bool)] & _PLACE).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, textops.mix(gram[at] ^ _U(0xA0761D6478BD642F))


def _anchor_counts(texts: DataFrame, dup, length: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for a, z, o, data in _blocks(b, dup):
                _, fp = anchors(data, o, length)
                u, c = np.unique(fp, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(textops.signed(u)), pa.array(c)], names=["fp", "n"])

    return texts.select("h", "folded", "text").mapInArrow(run, "fp bigint, n bigint").groupBy("fp").agg(F.sum("n").alias("n"))


def _blocks(batch, dup):
    """Blocks of a batch without the rows whose text may be repeated (they
    come again, folded)."""
    h = batch.column(0).to_numpy(zero_copy_only=False)
    take = batch.column(1).to_numpy(zero_copy_only=False).astype(bool) | ~sketches.in_bitmap(dup.value, h)
    rows = np.flatnonzero(take)
    if not len(rows):
        return
    offs, data = textops.utf8(batch.column(2).take(pa.array(rows)))
    for a, z in textops.blocks(offs):
        yield rows[a:z], None, offs[a:z + 1] - offs[a], data[offs[a]:offs[z]]


# ---- shards -------------------------------------------------------------
_OUT = "kind string, shard bigint, bin int, fps binary, at binary, keys array<binary>, doc_at binary"


def _shards(texts: DataFrame, dup, repeated, length: int, bins: int, shard_bytes: int) -> DataFrame:
    """Rows of every shard: ``map`` (where its pieces come from), ``own``
    (starts repeated inside it) and per range ``run`` (sorted fingerprints
    of its distinct strings and a start of each)."""
    def run(batches):
        held, size = [], 0
        for b in batches:
            keys = b.column(3)
            for rows, _, o, data in _blocks(b, dup):
                at, fp = anchors(data, o, length)
                at = at[sketches.in_bitmap(repeated.value, fp)] if len(at) else at
                if not len(at):
                    continue
                for row, s, e, base in _runs(at, o, length, shard_bytes):
                    if size and size + e - s + length - 1 > shard_bytes:
                        yield from _one_shard(held, length, bins)
                        held, size = [], 0
                    held.append((keys[int(rows[row])].as_py(), s - base, data[s:e + length - 1].copy()))
                    size += len(held[-1][2])
        if held:
            yield from _one_shard(held, length, bins)

    return texts.select("h", "folded", "text", "key").mapInArrow(run, _OUT)


def _runs(at, o, length, shard_bytes):
    """Maximal runs of candidate starts ``(row, first, end, text start)``;
    runs are cut at ``shard_bytes``."""
    k = 3 * length // 4
    doc = np.searchsorted(o, at, "right") - 1
    lo = np.maximum(at - (length - k), o[doc])
    hi = np.minimum(at, o[doc + 1] - length) + 1
    ok = hi > lo
    lo, hi, doc = lo[ok], hi[ok], doc[ok]
    if not len(lo):
        return
    new = np.append(True, (lo[1:] > np.maximum.accumulate(hi)[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    ends = np.maximum.reduceat(hi, first)
    for row, s, e in zip(doc[first].tolist(), lo[first].tolist(), ends.tolist()):
        for c in range(s, e, shard_bytes):
            yield row, c, min(e, c + shard_bytes), int(o[row])


def _one_shard(held, length, bins):
    text = np.concatenate([h[2] for h in held])
    sizes = np.array([len(h[2]) for h in held])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    valid = np.zeros(len(text), bool)
    for s, m in zip(starts.tolist(), sizes.tolist()):
        valid[s:s + m - length + 1] = True
    digest = hashlib.blake2b(text.tobytes(), digest_size=8)
    digest.update(held[0][0] + held[0][1].to_bytes(8, "little"))
    shard = int.from_bytes(digest.digest(), "little") >> 1
    pos, cls = repeat_classes(text, valid, length)
    new = np.append(True, cls[1:] != cls[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(cls)))
    own = np.sort(pos[np.repeat(count > 1, count)])
    rep, many = pos[first], count > 1
    prefix = textops.prefix_hash(text)
    fp = textops.span_hash(prefix, rep, rep + length)
    o = np.argsort(fp)
    fp, rep = fp[o], np.where(many[o], 0xFFFFFFFF, rep[o]).astype("<u4")  # no answer wanted for own repeats
    keys = [h[0] for h in held]
    doc_at = np.array([(s, h[1]) for s, h in zip(starts.tolist(), held)], "<i8").tobytes()
    rows = [("map", shard, shard % bins, None, None, keys, doc_at), ("own", shard, shard % bins, None, _runs_of(own).tobytes(), None, None)]
    cut = np.searchsorted(fp, [(i << 64) // bins for i in range(1, bins)]) if bins > 1 else []
    edges = [0, *np.asarray(cut).tolist(), len(fp)]
    rows += [("run", shard, i, fp[a:z].astype("<u8").tobytes(), rep[a:z].tobytes(), None, None)
             for i, (a, z) in enumerate(zip(edges[:-1], edges[1:])) if z > a]
    yield pa.RecordBatch.from_pylist([dict(zip(("kind", "shard", "bin", "fps", "at", "keys", "doc_at"), r)) for r in rows], _schema())


def _runs_of(at: np.ndarray) -> np.ndarray:
    """Sorted positions as ``<u4`` (first, count) pairs of their runs."""
    if not len(at):
        return np.zeros(0, "<u4")
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    return np.stack((at[first], np.diff(np.append(first, len(at)))), axis=1).astype("<u4")


def _schema():
    return pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("bin", pa.int32()), ("fps", pa.binary()), ("at", pa.binary()),
                      ("keys", pa.list_(pa.binary())), ("doc_at", pa.binary())])


def merge_runs(a, b):
    """Merges two sorted runs ``(fp, shard, at, twice)`` by binary search;
    returns the merged run and the ``(shard, at)`` of ``b`` that repeat."""
    place = np.searchsorted(a[0], b[0])
    inside = np.minimum(place, len(a[0]) - 1)
    hit = a[0][inside] == b[0]
    a[3][inside[hit]] = True
    rest = ~hit
    merged = tuple(np.insert(x, place[rest], y[rest]) for x, y in zip(a, b))
    return merged, (b[1][hit], b[2][hit])


def _across(rows: DataFrame, bins: int) -> DataFrame:
    """``map`` and ``own`` rows as they are, and ``across`` rows: the starts
    of each shard whose strings other shards hold too."""
    def run(batches):
        at, runs = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] != "run":
                    yield pa.RecordBatch.from_pylist([r], _schema())
                    continue
                if r["bin"] != at:
                    yield from merged(runs)
                    at, runs = r["bin"], []
                fp, st = np.frombuffer(r["fps"], "<u8"), np.frombuffer(r["at"], "<u4")
                runs.append((fp, np.full(len(fp), r["shard"], np.int64), st, np.zeros(len(fp), bool)))
        yield from merged(runs)

    def merged(runs):
        found = []
        while len(runs) > 1:
            runs.sort(key=lambda r: len(r[0]))
            pairs = []
            for i in range(0, len(runs) - 1, 2):
                big, small = runs[i + 1], runs[i]
                big = (big[0], big[1], big[2], big[3].copy())
                twice = small[3].copy()
                m, hit = merge_runs(big, small)
                found.append(hit)
                pairs.append(m)
                del twice
            runs = pairs + runs[len(runs) - len(runs) % 2:]
        if not runs:
            return
        last = runs[0]
        found.append((last[1][last[3]], last[2][last[3]]))
        shard = np.concatenate([f[0] for f in found])
        at = np.concatenate([f[1] for f in found])
        keep = at != 0xFFFFFFFF
        shard, at = shard[keep], at[keep]
        o = np.argsort(shard, kind="stable")
        shard, at = shard[o], at[o]
        first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
        for a, z in zip(first, np.append(first[1:], len(shard)).astype(int) if len(shard) else []):
            yield pa.RecordBatch.from_pylist([{"kind": "across", "shard": int(shard[a]), "at": at[a:z].astype("<u4").tobytes()}], _schema())

    return (rows.repartition(bins, "bin").sortWithinPartitions("bin").mapInArrow(run, _OUT))


def _spans(found: DataFrame, length: int) -> DataFrame:
    """``(key, start, end)`` byte spans per text from the shards' starts."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        maps = [r for r in rows if r["kind"] == "map"]
        at = [np.frombuffer(r["at"], "<u4") for r in rows if r["kind"] == "across"]
        for r in rows:
            if r["kind"] == "own" and r["at"]:
                first, n = np.frombuffer(r["at"], "<u4").reshape(-1, 2).astype(np.int64).T
                at.append((np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())).astype("<u4"))
        schema = pa.schema([("key", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])
        at = np.unique(np.concatenate(at)).astype(np.int64) if at else np.zeros(0, np.int64)
        if not len(at) or not maps:
            return schema.empty_table()
        where = np.frombuffer(maps[0]["doc_at"], "<i8").reshape(-1, 2)
        piece = np.searchsorted(where[:, 0], at, "right") - 1
        pos = at - where[piece, 0] + where[piece, 1]
        new = np.append(True, (piece[1:] != piece[:-1]) | (pos[1:] > pos[:-1] + length))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        keys = maps[0]["keys"]
        return pa.table([pa.array([keys[p] for p in piece[first].tolist()], pa.binary()), pa.array(pos[first]), pa.array(pos[last] + length)], schema=schema)

    return found.select("kind", "shard", "at", "keys", "doc_at").groupBy("shard").applyInArrow(run, "key binary, start bigint, end bigint")


# ---- the operator -------------------------------------------------------
def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                 shard_bytes: int = SHARD_BYTES, bitmap_bits: int = 26, with_text: bool = False) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans,
    kept_sha256`` (and ``kept`` binary, the bytes left, with ``with_text``).

    ``length`` is even, 16 at least. Null text is empty text; a text shorter
    than ``length`` keeps all bytes. Matches never cross texts, may overlap
    and may lie in one text. Rows that repeat a text (null and repeated ids
    included) are each reported. Cutting may leave bytes that are not UTF-8:
    ``kept`` is binary. Other columns are ignored. An empty table gives an
    empty result. One text is held in memory by one task, with about 60
    bytes for each of its bytes.
    """
    if length < 16 or length % 2:
        raise ValueError("length: an even number of bytes, 16 at least")
    spark = docs.sparkSession
    textops.bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = materialize(spark, base.select("id", F.unhex(F.sha2("text", 256)).alias("key"), F.octet_length("text").cast("bigint").alias("n_bytes"),
                                          F.xxhash64("text").alias("h")), "suffix-rows")
    twice = materialize(spark, rows.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("n"), F.first("h").alias("h")).filter("n > 1"), "suffix-twice")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    dup = sketches.share(spark, sketches.key_bitmap(twice, "h"))
    long_ = base.filter(F.octet_length("text") >= length)
    folded = _fold_copies(long_.select("id", F.xxhash64("text").alias("fp"), "text"), dup).groupBy("fp", "text").agg(F.count("*").alias("n"))
    folded = materialize(spark, folded.select(F.col("fp").alias("h"), F.lit(True).alias("folded"), "text"), "suffix-folded")
    texts = long_.select(F.xxhash64("text").alias("h"), F.lit(False).alias("folded"), "text").union(folded)
    texts = texts.withColumn("key", F.unhex(F.sha2("text", 256)))
    again = _anchor_counts(texts, dup, length).filter("n > 1").select("fp")
    repeated = sketches.share(spark, sketches.key_bitmap(again, "fp", bitmap_bits))
    bins = 1 << max(0, (int(total) // (8 << 20)).bit_length())
    found = _across(_shards(texts, dup, repeated, length, bins, shard_bytes), bins)
    found = materialize(spark, found, "suffix-found")
    spans = materialize(spark, _spans(found, length), "suffix-spans").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = materialize(spark, spans.join(twice.select("key"), "key", "left_anti"), "suffix-cuts")
    cut = sketches.share(spark, sketches.key_bitmap(spans.select(F.xxhash64("key").alias("k")), "k"))
    kept = _cut(texts.filter("not folded").select("key", F.xxhash64("key").alias("k"), "text"), spans, cut, with_text)
    res = rows.join(kept, "key", "left").join(twice.select("key", F.lit(True).alias("copy")), "key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    copy = F.col("copy").isNotNull()
    out = [F.col("id").alias(id_col), "n_bytes",
           F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
           F.when(copy, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", F.lit(0).cast("bigint"))).alias("n_spans"),
           F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256")]
    if with_text:
        plain = base.select(F.unhex(F.sha2("text", 256)).alias("key"), F.col("text").cast("binary").alias("whole")).dropDuplicates(["key"])
        res = res.join(plain, "key", "left")
        out.append(F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept", "whole")).alias("kept"))
    return res.select(*out)


def _cut(texts: DataFrame, spans: DataFrame, affected, with_text: bool) -> DataFrame:
    """Affected texts without their spans."""
    def pick(batches):
        for b in batches:
            hit = np.flatnonzero(sketches.in_bitmap(affected.value, b.column(1).to_numpy(zero_copy_only=False)))
            if len(hit):
                yield b.take(pa.array(hit)).select(["key", "text"])

    def cut(batches):
        for b in batches:
            out = []
            for key, text, where in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, parts, at, gone, n = text.encode(), [], 0, 0, 0
                s0, e0 = None, None
                merged = []
                for s in where:
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                for s0, e0 in merged:
                    parts.append(raw[at:s0])
                    at, gone, n = e0, gone + e0 - s0, n + 1
                parts.append(raw[at:])
                kept = b"".join(parts)
                out.append({"key": key, "n_removed": gone, "n_spans": n, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_text else None})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                                                                 ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    picked = texts.mapInArrow(pick, "key binary, text string")
    res = picked.join(spans, "key").select("key", "text", "spans").mapInArrow(cut, "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return res if with_text else res.drop("kept")
