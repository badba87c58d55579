from pyspark.sql import functions as F

from shardwright.llm import language_id

SF = "/root/testdata/sf0.01"


def test_copies_and_rare_languages(spark):
    """Thousands of copies of one text and a language of two documents: both
    texts and languages stay in the model."""
    d, p = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang"), spark.read.parquet(f"{SF}/pages.parquet")
    want = language_id.train(d, "text", "lang", 4000)[0]
    rare = spark.createDataFrame([("ett litet dokument p\u00e5 svenska med n\u00e5gra f\u00e5 ord " * 3, "sv"), ("och \u00e4nnu en text om v\u00e4der och vind", "sv")], "text string, lang string")
    first = d.orderBy(F.xxhash64("text", "lang")).first()
    copies = spark.range(5000).select(F.lit(first.text).alias("text"), F.lit(first.lang).alias("lang"))
    docs = d.unionByName(rare).unionByName(copies)
    langs, model = language_id.train(docs, "text", "lang", 400)
    assert langs == sorted([*want, "sv"]) and model.shape[1] == len(langs)
    page = spark.createDataFrame([(9001, "http://x.test/sv/1", "<html lang=sv><p>ett dokument med n\u00e5gra ord om v\u00e4der</p>")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in language_id.identify(p.select(*page.columns).unionByName(page), docs, max_train=400).collect()}
    assert got[9001].lang == "sv"
    other = [r for r in got.values() if r.page_id != 9001]
    assert sum(r.lang == r.url.split("/")[3][:2] for r in other) > 0.95 * len(other)
