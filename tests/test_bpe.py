"""The pluggable tokenizer path: a tokenizers JSON file, built once per
worker, and the persisted token table it triggers in packing."""

import os

from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from shardwright.functions import tokens
from shardwright.operators import packing
from shardwright.plans import packing_plans as pp
from shardwright.session import scratch_path


def _train_bpe(path, texts):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers
    tok = Tokenizer(models.BPE(unk_token="<|endoftext|>"))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.decoder = decoders.ByteLevel()
    trainer = trainers.BpeTrainer(vocab_size=600, special_tokens=tokens.SPECIAL_TOKENS,
                                  initial_alphabet=pre_tokenizers.ByteLevel.alphabet())
    tok.train_from_iterator(texts, trainer)
    tok.save(path)


def test_json_tokenizer_round_trip_and_packing(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").limit(50).collect()]
    root = scratch_path(spark, "t-bpe")
    os.makedirs(root)
    path = os.path.join(root, "tok.json")
    _train_bpe(path, texts)
    bpe = tokens.JsonFileTokenizer(path)
    assert bpe.cheap is False
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source", "text")
    back = docs.select("text", tokens.decode(tokens.encode("text", bpe), bpe).alias("back"))
    assert back.filter(F.col("back") != F.col("text")).count() == 0
    # the byte-level BPE merges bytes: fewer ids than bytes
    n_ids = docs.select(F.size(tokens.encode("text", bpe)).alias("n")).agg(F.sum("n")).first()[0]
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert n_ids < n_bytes
    # packing with an expensive tokenizer reads a written token table
    tok = pp.tokenized(spark, SF_SMALL, tokenizer=bpe)
    assert "FileScan parquet" in tok._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in tok._jdf.queryExecution().executedPlan().toString()
    w = packing.pack_windows(tok, pp.SPEC, pp.BY, "doc_id")
    total = tok.agg(F.sum("n_tokens")).first()[0]
    assert 0 < w.count() <= total // pp.SPEC.context
