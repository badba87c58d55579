"""Operator 12: conversation prefix trie over minimal-perfect-hash node tables.

Every distinct sequence of first turns is a node, named by a 128-bit digest
chained turn by turn. The distinct digests are enumerated by one grouped
aggregate, which also verifies that rows with one digest agree in parent,
turn and depth.

Sums over subtrees are taken in numpy, a shard of the trie at a time:

* a shard's digests get slots 0..n-1 from a minimal perfect hash (levels of
  bits; a digest that meets another goes to the next level; the slot is the
  rank of its bit). The slot holds the digest itself, so a digest that is
  not in the shard is never taken for one that is;
* counts are scattered into flat arrays by slot, parents become parent
  slots, and children are added to their parents level by level from the
  deepest on.

A shard must hold whole branches, and no task the whole trie. So nodes are
told apart by *bands*: band k holds the nodes with at most
``shard_convs**(k+1)`` conversations and not in a band below. Along any path
bands only fall, and a top node of band k with what lies under it down to the
next band has at most ``shard_convs`` nodes to a depth. Such branches are
dealt to shards by hash, band 0 first; a branch leaves one row per top node,
which the next band takes up. There is one band for every factor of
``shard_convs`` in the number of conversations.

A first turn or a whole conversation that a third of all share is one hot
digest: it is folded before the shuffle, its nodes are of a high band, and
its branches are spread over all shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import textops

_U = np.uint64
ROOT = np.frombuffer(hashlib.blake2b(b"", digest_size=16).digest(), "<i8")


# ---- minimal perfect hash ------------------------------------------------
def _probe(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (textops.mix(a.view(_U) ^ textops.mix(b.view(_U) + _U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) % _U(size)).astype(np.int64)


class Slots:
    """Minimal perfect hash of distinct 128-bit keys ``(a, b)``: every key
    has its own slot 0..n-1; ``find`` gives -1 for any other key."""

    def __init__(self, a: np.ndarray, b: np.ndarray, room: float = 1.5):
        self.levels, self.base, n, left = [], [], 0, np.arange(len(a))
        while len(left):
            level, size = len(self.levels), max(int(len(left) * room), 1)
            at = _probe(a[left], b[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            if level > 100:
                raise ValueError("keys repeat")
            self.levels.append(np.cumsum(alone) * alone)  # rank of the bit, 0 where none is set
            self.base.append(n)
            n += int(alone.sum())
            left = left[~alone[at]]
        self.a, self.b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        slot = self._slot(a, b)
        self.a[slot], self.b[slot] = a, b

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (rank, base) in enumerate(zip(self.levels, self.base)):
            if not len(left):
                break
            r = rank[_probe(a[left], b[left], level, len(rank))]
            out[left[r > 0]] = base + r[r > 0] - 1
            left = left[r == 0]
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = self._slot(a, b)
        known = slot >= 0
        known[known] = (self.a[slot[known]] == a[known]) & (self.b[slot[known]] == b[known])
        return np.where(known, slot, -1)


def subtree_sums(a, b, parent_a, parent_b, depth, children, leaves, saved):
    """Adds every node's numbers to its parent, deepest first.

    ``children``, ``leaves`` and ``saved`` hold what comes from outside the
    shard (``saved``: and the node's own). Returns the three sums and which
    nodes' parents are not in the shard.
    """
    table = Slots(a, b)
    slot, up = table.find(a, b), table.find(parent_a, parent_b)
    n = len(slot)
    flat = np.empty((4, n), np.int64)  # by slot: depth, children, leaves, saved
    flat[:, slot] = depth, children, leaves, saved
    parent = np.empty(n, np.int64)
    parent[slot] = up
    order = np.argsort(-flat[0], kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(flat[0][order])) + 1):
        flat[2, level] += flat[1, level] == 0  # childless: a leaf itself
        level = level[parent[level] >= 0]
        np.add.at(flat[1], parent[level], 1)
        np.add.at(flat[2], parent[level], flat[2, level])
        np.add.at(flat[3], parent[level], flat[3, level])
    return flat[1, slot], flat[2, slot], flat[3, slot], up < 0


# ---- turns to paths --------------------------------------------------------
def rebuild(turns: DataFrame) -> DataFrame:
    """``(conv_id, place, role, text)``: conversation c is the first
    ``crc32(c) % 9`` turns of conversation ``c - c % 5``, then its own turns
    after its first so many; place 0 is a row without a turn for every
    conversation. Turns are ordered by turn (null first), then role and
    text; null role or text is empty; rows without ``conv_id`` belong to no
    conversation.
    """
    from pyspark.sql.window import Window

    own = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")  # one conversation, read in order
    own = own.withColumn("place", F.row_number().over(w))
    taken = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(9))
    base = F.pmod(F.col("conv_id"), F.lit(5)) == 0
    kept = own.filter(base | (F.col("place") > taken("conv_id"))).select("conv_id", "place", "role", "text")
    ids = own.select("conv_id").distinct()
    lent = (own.filter(base & (F.col("place") <= 8)).withColumn("to", F.explode(F.sequence(F.col("conv_id") + 1, F.col("conv_id") + 4)))
            .filter(F.col("place") <= taken("to")).join(ids.withColumnRenamed("conv_id", "to"), "to", "left_semi")
            .select(F.col("to").alias("conv_id"), "place", "role", "text"))
    mark = ids.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return kept.unionByName(lent).unionByName(mark)


def paths(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, a, b, up_a, up_b, turn_a, turn_b, bytes, ends)``:
    a row per conversation and prefix, the empty one included. ``turns`` has
    ``(conv_id, place, role, text)`` with a row of place 0 for every
    conversation. Only hashes of turns are shuffled."""
    md5 = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    half = lambda k: F.conv(F.substring(md5, 1 + 16 * k, 16), 16, -10).cast("bigint")
    slim = turns.select("conv_id", "place", F.coalesce(half(0), F.lit(0)).alias("turn_a"), F.coalesce(half(1), F.lit(0)).alias("turn_b"),
                        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"))
    names = ["conv_id", "depth", "a", "b", "up_a", "up_b", "turn_a", "turn_b", "bytes", "ends"]

    def chain(batches):
        conv, depth, digest, held = None, 0, b"", None  # the last row waits to learn whether it ends its conversation
        root = ROOT.tobytes()
        for batch in batches:
            ids, place, ta, tb, size = (batch.column(k).to_pylist() for k in range(5))
            turn = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1).astype("<i8").tobytes()
            out, now, up = [], bytearray(), bytearray()
            first = held
            for i, c in enumerate(ids):
                if c != conv:
                    conv, depth, parent, digest = c, 0, root, root
                else:
                    depth += 1
                    parent = digest
                    digest = hashlib.blake2b(parent + turn[16 * i:16 * i + 16], digest_size=16).digest()
                now += digest
                up += parent
                out.append(depth)
            if not out:
                continue
            n = len(out)
            now, up = np.frombuffer(bytes(now), "<i8").reshape(n, 2), np.frombuffer(bytes(up), "<i8").reshape(n, 2)
            d = np.array(out, np.int64)
            cols = [np.array(ids, np.int64), d, now[:, 0], now[:, 1], up[:, 0], up[:, 1], np.array(ta, np.int64), np.array(tb, np.int64), np.array(size, np.int64)]
            if first is not None:
                cols = [np.concatenate((h, x)) for h, x in zip(first, cols)]
            ends = cols[1][1:] == 0
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:-1]) for x in cols), pa.array(ends)], names=names)
            held = [x[-1:] for x in cols]
        if held is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in held), pa.array([True])], names=names)

    # by a hash of its own: an exchange that equals one below it is left out of the plan, and the one below may be read out of order
    sized = slim.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "place")
    return sized.mapInArrow(chain, ", ".join(f"{k} bigint" for k in names[:-1]) + ", ends boolean")


# ---- the trie ----------------------------------------------------------------
def enumerate_nodes(rows: DataFrame) -> DataFrame:
    """One row per digest with its conversations counted; raises if rows of
    one digest differ in parent, turn, size or depth."""
    same = ("depth", "up_a", "up_b", "turn_a", "turn_b", "bytes")
    nodes = materialize(rows.sparkSession, rows.groupBy("a", "b").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        *(F.min(c).alias(c) for c in same), *(F.max(c).alias(f"max_{c}") for c in same)), "trie-nodes")
    differ = " OR ".join(f"{c} != max_{c}" for c in same)
    if nodes.filter(differ).limit(1).count():
        raise ValueError("two prefixes share a 128-bit digest")
    return nodes.drop(*(f"max_{c}" for c in same))


def _branch_sums(nodes: DataFrame, shards: int) -> DataFrame:
    """Sums of the nodes of one band: ``(a, b, n_children, n_leaves, saved,
    outside)``. ``nodes`` carry ``shard``."""
    fields = ("a", "b", "up_a", "up_b", "depth", "children", "leaves", "saved")
    names = ["a", "b", "up_a", "up_b", "n_children", "n_leaves", "saved_tokens", "outside"]

    def run(batches):  # a task may hold several whole branches: one table for all
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        col = {k: whole.column(k).to_numpy() for k in fields}
        is_root = (col["depth"] == 0)
        up_a, up_b = np.where(is_root, 0, col["up_a"]), np.where(is_root, 0, col["up_b"])  # the root is no child of itself
        children, leaves, saved, outside = subtree_sums(col["a"], col["b"], up_a, up_b, col["depth"], col["children"], col["leaves"], col["saved"])
        for i in range(0, len(children), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (col["a"], col["b"], col["up_a"], col["up_b"], children, leaves, saved, outside & ~is_root)], names=names)

    schema = ", ".join(f"{k} bigint" for k in names[:-1]) + ", outside boolean"
    return nodes.select("shard", *fields).repartition(shards, "shard").drop("shard").mapInArrow(run, schema)


def accumulate(rows: DataFrame, nodes: DataFrame, shard_convs: int, shard_nodes: int) -> DataFrame:
    """``(a, b, n_children, n_leaves, saved_tokens)`` of every node."""
    spark = rows.sparkSession
    total = nodes.agg(F.max("n_convs")).first()[0] or 0
    bands, reach = 1, shard_convs
    while reach < total:
        bands, reach = bands + 1, reach * shard_convs
    band = F.lit(0)
    for k in range(1, bands):
        band = F.when(F.col("n_convs") > shard_convs ** k, k).otherwise(band)
    nodes = nodes.withColumn("band", band)
    # the top node of a conversation's path in each band; only nodes above band 0 are looked up
    high = materialize(spark, nodes.filter("band > 0").select("a", "b", "band"), "trie-high")
    along = rows.select("conv_id", "depth", "a", "b").join(high, ["a", "b"], "left").withColumn("band", F.coalesce("band", F.lit(0)))
    tops = along.groupBy("conv_id", "band").agg(F.min(F.struct("depth", "a", "b")).alias("top"))
    nodes = materialize(spark, nodes.join(tops, ["conv_id", "band"]).withColumn("shard", F.xxhash64("top.a", "top.b")).drop("top"), "trie-banded")
    sizes = {r.band: r["count"] for r in nodes.groupBy("band").count().collect()}  # one row per band
    done, below = None, None
    for k in range(bands):
        own = nodes.filter(F.col("band") == k).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
        if below is None:
            own = own.select("*", *(F.lit(0).cast("bigint").alias(c) for c in ("children", "leaves", "under")))
        else:
            own = own.join(below, ["a", "b"], "left").fillna(0, ["children", "leaves", "under"])
        own = own.withColumn("saved", F.col("own") + F.col("under"))
        out = materialize(spark, _branch_sums(own, max(1, -(-sizes.get(k, 0) // shard_nodes))), "trie-band")
        done = out if done is None else done.unionByName(out)
        risen = out.filter("outside").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
            F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("under"))
        # a parent may be more than one band up: what is not taken up yet waits
        below = risen if below is None else risen.unionByName(below).groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "under")))
        if k < bands - 1:
            below = materialize(spark, below.join(nodes.filter(F.col("band") > k).select("a", "b"), ["a", "b"], "left_semi"), "trie-below")
    return done.select("a", "b", "n_children", "n_leaves", "saved_tokens")


def end_digests(rows: DataFrame, block: int = 4096) -> DataFrame:
    """``(a, b, ends_sha256)`` of nodes where conversations end: the hash of
    their ids, ascending, joined by commas. Ids are joined a block of the id
    range at a time; a task then reads a node's blocks in order and holds
    one of them."""
    ids = rows.filter("ends").select("a", "b", "conv_id", F.floor(F.col("conv_id") / F.lit(block)).alias("block"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    joined = ids.groupBy("a", "b", "block").agg(text.alias("ids")).repartition(F.xxhash64("a", "b")).sortWithinPartitions("a", "b", "block")

    def run(batches):
        key, state = None, None
        done: list[tuple] = []

        def flush():
            a, b, h = zip(*done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(h)], names=["a", "b", "ends_sha256"])

        for batch in batches:
            for a, b, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (a, b) == key:
                    state.update(b"," + part.encode())
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(part.encode())
            if done:
                yield flush()
        if key:
            done.append((*key, state.hexdigest()))
            yield flush()

    return joined.select("a", "b", "ids").mapInArrow(run, "a bigint, b bigint, ends_sha256 string")


def trie(turns: DataFrame, shard_convs: int = 256, shard_nodes: int = 1 << 17) -> DataFrame:
    """One row per node of the trie of ``turns(conv_id, place, role, text)``
    (see ``paths``): ``conv_id`` (smallest member), ``depth, parent_conv_id``
    (null for the root), ``n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``.

    Equal conversations share all nodes; a conversation without turns ends
    at the root. An empty table has no nodes. A shard's table holds about
    ``shard_nodes`` nodes; that and ``shard_convs`` set memory, not results.
    """
    spark = turns.sparkSession
    textops.bounded_batches(spark)
    rows = materialize(spark, paths(turns), "trie-paths")
    nodes = enumerate_nodes(rows)
    sums = accumulate(rows, nodes, shard_convs, shard_nodes)
    parent = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    out = (nodes.join(sums, ["a", "b"]).join(end_digests(rows), ["a", "b"], "left")
           .join(parent, ["up_a", "up_b"], "left"))
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                      "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, **how) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns(conv_id, turn, role,
    text)``; other columns are ignored. See ``rebuild`` and ``trie``."""
    return trie(rebuild(turns.select("conv_id", "turn", "role", "text")), **how)
