import pyarrow as pa
from pyspark.sql import functions as F

from shardwright.functions import tokens


def test_byte_tokenizer_vectorised_and_specials():
    tok = tokens.ByteTokenizer()
    arr = pa.array(["hé", None, ""])
    out = tok.encode_batch(arr).to_pylist()
    assert out == [[17 + 0x68, 17 + 0xC3, 17 + 0xA9], None, []]
    sp = tok.encode_batch(pa.array(["a<|im_start|>b<|endoftext|>"])).to_pylist()
    assert sp == [[17 + 97, 1, 17 + 98, 0]]
    back = tok.decode_batch(pa.array([[17 + 97, 1, 17 + 98, 0], None, [17 + 0xC3]], type=pa.list_(pa.int32())))
    assert back.to_pylist() == ["a<|im_start|>b<|endoftext|>", None, "�"]
    skip = tok.decode_batch(pa.array([[17 + 97, 1, 17 + 98, 0]], type=pa.list_(pa.int32())), skip_special=True)
    assert skip.to_pylist() == ["ab"]


def test_round_trip_on_documents(spark):
    from sf_paths import SF_SMALL
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text")
    bad = d.withColumn("back", tokens.decode(tokens.encode("text"))).filter(F.col("back") != F.col("text"))
    assert bad.count() == 0


def test_chat_text_tokens(spark):
    df = spark.createDataFrame([("<|im_start|>user:\n hi<|im_end|>\n",)], "text string")
    ids = df.select(tokens.encode("text")).first()[0]
    assert ids[0] == 1 and ids[-2] == 2 and len(ids) == 1 + len("user:\n hi") + 1 + 1
