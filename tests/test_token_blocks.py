"""Tokenizers work on blocks of a batch, so a worker holds no batch's ids."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shardwright.functions import tokens

TEXTS = ["", None, "plain", "é" * 700, "<|im_start|>x<|im_end|>", "<|im_end|>" * 90, None, "z" * 5000, "", "tail<|endoftext|>"]


def recorder(limit):
    """A tokenizer that fails on more than ``limit`` bytes (or ids) unless they are one row."""

    class Recorder(tokens.ByteTokenizer):
        def encode_batch(self, texts):
            got = sum(len((t or "").encode()) for t in texts.to_pylist())
            if got > limit and len(texts) > 1:
                raise ValueError(f"{got} bytes in a block")
            return super().encode_batch(texts)

        def decode_batch(self, ids, skip_special=False):
            got = sum(len(t or []) for t in ids.to_pylist())
            if got > limit and len(ids) > 1:
                raise ValueError(f"{got} ids in a block")
            return super().decode_batch(ids, skip_special)

    return Recorder()


def test_blocks_cover_every_row_once():
    for sizes in ([], [0, 0], [5, 0, 9, 1, 1, 0], [100, 1], [1, 100, 1]):
        spans = list(tokens._blocks(np.cumsum(np.array(sizes, dtype=np.int64)), 10))
        assert [i for a, b in spans for i in range(a, b)] == list(range(len(sizes)))
        assert all(sum(sizes[a:b]) <= 10 or b - a == 1 for a, b in spans)


def test_a_batch_is_tokenized_in_blocks(spark):
    """Their common step."""
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "i long, text string").coalesce(1)
    rec = recorder(1 << 20)
    out = df.select("i", "text", tokens.encode("text", rec).alias("ids")).withColumn("back", tokens.decode("ids", rec))
    want = tokens.ByteTokenizer().encode_batch(pa.array(TEXTS, pa.string())).to_pylist()
    got = out.orderBy("i").collect()
    assert len(got) == 6000
    assert all(r.ids == want[r.i % len(TEXTS)] and r.back == r.text for r in got)


def test_two_columns_and_empty_input(spark):
    df = spark.createDataFrame([("ab", "c"), (None, "d")], "x string, y string")
    r = df.select(tokens.encode("x").alias("a"), tokens.encode("y").alias("b"), F.lit(1).alias("k")).collect()
    assert [(x.a, x.b) for x in r] == [([114, 115], [116]), (None, [117])]
    assert df.filter("false").select(tokens.encode("x")).collect() == []
