"""The packing stream: windows carried over micro-batches, a shard's rows in
several Arrow batches and out of order inside a micro-batch."""

import json
import os
from collections import defaultdict

from pyspark.sql import functions as F

from shardwright.operators import packing
from shardwright.streaming import incremental

C = 64


def test_windows_equal_one_long_stream(spark, tmp_path):
    texts = {k: "x" * ((k * 37) % 200) if k % 7 else "" for k in range(120)}
    texts[50] = "long " * 400
    files = [range(0, 40), range(40, 41), range(41, 120)]
    inp = tmp_path / "in"
    inp.mkdir()
    for i, ids in enumerate(files):
        path = inp / f"f{i}.json"
        path.write_text("".join(json.dumps({"doc_id": k, "text": texts[k]}) + "\n" for k in sorted(ids, key=lambda k: (k * 31) % 97)))
        os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).json(str(inp))
        tok = packing.assign_shard(packing.tokenize(stream, "text"), "doc_id", 3)
        incremental.run_to_parquet(incremental.pack_stream(tok, C), str(tmp_path / "out"), str(tmp_path / "ckpt"), state_partitions=2, rocksdb=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {(r.shard, r.win): (r.first_doc_id, list(r.input_ids)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    streams = defaultdict(list)
    for r in sorted(packing.tokenize(docs, "text").select("doc_id", "ids").collect(), key=lambda r: r.doc_id):
        streams[r.doc_id % 3] += [(r.doc_id, x) for x in r.ids]
    want = {(s, w): (flat[w * C][0], [x for _, x in flat[w * C:(w + 1) * C]])
            for s, flat in streams.items() for w in range(len(flat) // C)}
    assert got == want


def test_prefix_match_without_a_nested_loop(spark):
    from shardwright.operators import splits
    names = ["a/b/wiki-000-00000.data", "wiki_en-000-00001.data", "w", "book-000-00000.data", "x/wiki", "", None]
    files = spark.createDataFrame([(n,) for n in names], "file_name string")
    config = spark.createDataFrame([("wiki", 1), ("wiki_en", 2), ("book", 3), ("w", 4), ("none", 5), (None, 6)], "corpus string, k int")
    m = splits.prefix_match(files, config)
    got = sorted((r.file_name, r.corpus, r.k) for r in m.collect())
    bare = {n: n.rsplit("/", 1)[-1] for n in names if n is not None}
    assert got == sorted((n, c.corpus, c.k) for n, b in bare.items() for c in config.collect() if c.corpus and b.startswith(c.corpus))
    assert "NestedLoop" not in m._jdf.queryExecution().executedPlan().toString()
    everything = splits.prefix_match(files, spark.createDataFrame([("",)], "corpus string"))
    assert everything.count() == len(bare) and everything.filter(F.col("corpus") == "").count() == len(bare)
