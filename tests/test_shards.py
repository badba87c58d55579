"""Token-shard files: export then import is the identity; headers are validated."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from shardwright.operators import packing
from shardwright.plans import packing_plans as pp
from shardwright.session import scratch_path
from shardwright.sources import sinks


def test_export_import_round_trip(spark):
    out = scratch_path(spark, "t-shards")
    pieces = packing.pack_shards(pp.tokenized(spark, SF_SMALL), pp.SPEC, pp.BY, "doc_id")
    written = {r["file_name"]: (r["num_tokens"], r["num_special_tokens"])
               for r in sinks.export_shards(pieces, out).collect()}
    stats = {f"{r['source']}-{r['shard']:03d}-{r['file_no']:05d}.data": (r["num_tokens"], r["num_special_tokens"])
             for r in packing.shard_stats(pieces, pp.BY).collect()}
    assert written == stats
    # file bytes: 20-byte header + int32 tokens
    for name, (ntok, _) in written.items():
        assert os.path.getsize(os.path.join(out, name)) == 20 + 4 * ntok
    # the imported token arrays equal the pieces concatenated in offset order
    expect = {}
    for r in pieces.select(F.format_string("%s-%03d-%05d.data", "source", F.col("shard").cast("int"),
                                           F.col("file_no").cast("int")).alias("f"),
                           "file_offset", "ids").collect():
        expect.setdefault(r["f"], []).append((r["file_offset"], list(r["ids"])))
    chunks = {}
    for r in sinks.import_shards(spark, out, 1000).collect():
        chunks.setdefault(os.path.basename(r["path"]), []).append((r["chunk_no"], list(r["ids"])))
    for f, parts in expect.items():
        ids = [t for _, p in sorted(parts) for t in p]
        got = [t for _, c in sorted(chunks[f]) for t in c]
        assert got == ids


def test_bad_header_is_rejected(spark):
    out = scratch_path(spark, "t-bad")
    os.makedirs(out)
    with open(os.path.join(out, "x-000-00000.data"), "wb") as f:
        f.write(struct.pack("<4siiii", b"NOPE", 1, 2, 0, 1) + np.arange(2, dtype="<i4").tobytes())
    with pytest.raises(Exception, match="token-shard header"):
        sinks.shard_headers(spark, out).collect()


def test_export_to_a_uri_and_numbers_after_it(spark):
    out = "file://" + scratch_path(spark, "t-uri")
    pieces = packing.pack_shards(pp.tokenized(spark, SF_SMALL), pp.SPEC, pp.BY, "doc_id")
    written = sinks.export_shards(pieces, out)
    n = written.count()
    heads = sinks.shard_headers(spark, out)
    assert heads.count() == n
    total = sum(len(r["ids"]) for r in sinks.import_shards(spark, out, 1 << 16).collect())
    assert total == heads.agg(F.sum("num_tokens")).first()[0]
    nxt = {(r["prefix"], r["shard"]): r["next_no"] for r in sinks.next_file_no(heads.withColumnRenamed("path", "file_name")).collect()}
    want = {(r["source"], r["shard"]): r["n"] for r in pieces.groupBy("source", "shard").agg((F.max("file_no") + 1).alias("n")).collect()}
    assert nxt == want
