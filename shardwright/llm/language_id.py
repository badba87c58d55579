"""Operator 6: language of web pages by Bayesian evidence fusion.

For every page and language l the log posterior adds

* the text: a naive Bayes likelihood of byte trigrams of the page's
  text outside navigation and link lists, trained on labelled documents, tempered so that ``most``
  trigrams count at most (neighbouring trigrams are not independent);
* the language declared by the markup: P(declared | l);
* the address suffix (last label of the host) and a language code in the
  path: P(suffix | l), P(code | l);
* the host's prior: page counts of the host smoothed with those of its
  domain, and those with the whole table's.

All tables but the first are grouped sums of the pages' text posteriors over
the whole table; a page's own posterior is taken out of its host's counts.
A host with a third of all pages is one row of the host table and a skewed
join of narrow rows, which AQE splits.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import html_blocks, textops

BITS = 16


def trigrams(offs: np.ndarray, data: np.ndarray):
    """``(doc, bucket)`` of the letter trigrams of each text (A-Z and their
    UTF-8 look-alikes lower-cased, other signs as one blank)."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = textops.byte_class("alnum") & ~((np.arange(256) >= 48) & (np.arange(256) <= 57))
    x = np.where(letter[data], textops.ascii_fold()[data], 32).astype(np.uint64)
    second = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E)  # capital Latin letters
    x[second] += np.uint64(0x20)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    key = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]
    ok = (doc[2:] == doc[:-2]) & (x[1:-1] != 32)
    return doc[2:][ok], (textops.mix(key[ok]) >> np.uint64(64 - BITS)).astype(np.int64)


def paragraph_text(page: str) -> str:
    """Text of the blocks with few links outside navigation, footers, asides
    and forms, whatever their tag; all text if there are none."""
    found = html_blocks.blocks(page)
    main = [b.text for b in found if 2 * b.linked < len(b.text) and not {"nav", "footer", "aside", "form"} & set(b.tags)]
    return "\n".join(main or [b.text for b in found])


def _host(url: str | None) -> str | None:
    try:
        return (urlsplit(url.strip()).hostname or None) if url else None
    except ValueError:
        return None


def address(url: str | None, known: set) -> tuple:
    """``(host, domain, suffix, code)``: the domain is the host's last two
    labels, the code a path part that is a known language."""
    host = _host(url)
    if not host:
        return None, None, None, None
    parts = host.split(".")
    path = re.split(r"[/?#]", url.split("://")[-1])[1:]
    code = next((p.lower()[:2] for p in path if p.lower()[:2] in known and re.fullmatch(r"[a-zA-Z]{2}(?:[-_][a-zA-Z]{2,4})?", p)), None)
    return host, ".".join(parts[-2:]), parts[-1], code


def train(docs: DataFrame, text_col: str, lang_col: str, max_train: int) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities. Every language of the
    labelled documents is one; its trigrams come from at most ``max_train``
    over the number of languages (one at least) different texts, those with
    the smallest hashes. Documents that mix languages only blur the counts."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("t", F.xxhash64("text"))
    spark = docs.sparkSession
    texts = materialize(spark, rows.select("lang", "t").distinct(), "language-labels")
    sizes = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1 << BITS, 0))
    quota = max(1, max_train // len(langs))
    # hashes are uniform: a bound that some more than ``quota`` texts of each language pass, then the smallest of those
    bound = {l: min(2.0 ** 63, -(2.0 ** 63) + 2.0 ** 64 * (quota + 6 * quota ** 0.5 + 20) / n) for l, n in sizes.items()}
    bounds = F.broadcast(spark.createDataFrame(list(bound.items()), "lang string, bound double"))
    few = texts.join(bounds, "lang").filter(F.col("t").cast("double") <= F.col("bound")).select("lang", "t")
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("t"))).filter(F.col("k") <= quota)
    chosen = spark.createDataFrame([(r.lang, r.t) for r in few.collect()], "lang string, t bigint")  # max_train rows at most, or one per language
    sample = rows.join(F.broadcast(chosen), ["lang", "t"]).groupBy("lang", "t").agg(F.first("text").alias("text")).select("lang", "text")

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            offs, data = textops.utf8(b.column(1))
            for a, z in textops.blocks(offs):
                d, f = trigrams(offs[a:z + 1] - offs[a], data[offs[a]:offs[z]])
                own = np.array(langs[a:z])[d] if len(d) else np.zeros(0, str)
                for l in set(langs[a:z]):
                    held[l] = held.get(l, 0) + np.bincount(f[own == l], minlength=1 << BITS)
        for l, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([l]), pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    for l, raw in sample.mapInArrow(run, "lang string, counts binary").toLocalIterator():  # max_train documents at most
        total[l] = total.get(l, 0) + np.frombuffer(raw, "<i8")
    counts = np.stack([total[l] for l in langs], axis=1) + 0.2
    return langs, np.log(counts / counts.sum(axis=0))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             text_col: str = "text", lang_col: str = "lang", max_train: int = 4000, most: float = 60.0, strength: float = 5.0) -> DataFrame:
    """One row per page: ``id_col, url_col, lang, prob, text_lang, declared``.

    ``lang`` has the largest posterior ``prob``; ``text_lang`` is the best of
    the text alone (null without text), ``declared`` the markup's primary
    subtag. Ties go to the alphabetically first language. A page without
    html, url or text is judged by what it has, at least the prior of the
    table. Without labelled documents all languages are null. Repeated rows
    and null ids are each judged. Other columns are ignored. An empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    textops.bounded_batches(spark)
    langs, model = train(docs, text_col, lang_col, max_train)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    if not langs:
        return base.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("prob"),
                           F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"))
    shared = spark.sparkContext.broadcast((model, langs))
    kind = dict(base.dtypes)["id"]

    def run(batches):
        model, langs = shared.value
        known = set(langs)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                raw = part.column(2).to_pylist()
                text = pa.array([paragraph_text(h) if h else "" for h in raw], pa.large_string())
                offs, data = textops.utf8(text)
                ll, n = np.zeros((len(raw), len(langs))), np.zeros(len(raw))
                for x, z in textops.blocks(offs):
                    d, f = trigrams(offs[x:z + 1] - offs[x], data[offs[x]:offs[z]])
                    n[x:z] = np.bincount(d, minlength=z - x)
                    for k in range(len(langs)):
                        ll[x:z, k] = np.bincount(d, model[f, k], z - x)
                ll *= np.minimum(1.0, most / np.maximum(n, 1))[:, None]
                ll -= ll.max(axis=1, keepdims=True)
                post = np.exp(ll)
                post /= post.sum(axis=1, keepdims=True)
                where = [address(u, known) for u in part.column(1).to_pylist()]
                flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * len(langs), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array([w[i] for w in where], pa.string()) for i in range(4)),
                     pa.array([html_blocks.declared_language(h) if h else None for h in raw], pa.string()), pa.array(n > 0), flat(ll), flat(post)],
                    names=["id", "url", "host", "domain", "suffix", "code", "declared", "has_text", "ll", "post"])

    p = base.mapInArrow(run, f"id {kind}, url string, host string, domain string, suffix string, code string, declared string, has_text boolean, ll array<double>, post array<double>")
    p = materialize(spark, p, "language-text")
    size = len(langs)
    told = F.when(F.col("declared").isin(langs), F.col("declared")).otherwise(F.when(F.col("declared").isNull(), F.lit("")).otherwise(F.lit("?")))
    p = p.withColumn("told", told).withColumn("coded", F.coalesce("code", F.lit("")))
    # pages without text say nothing about the tables
    shown = p.filter("has_text")

    def counts(*by: str) -> DataFrame:
        cols = [F.sum(F.col("post")[k]).alias(f"c{k}") for k in range(size)]
        return shown.groupBy(*by).agg(*cols).select(*by, F.array(*[f"c{k}" for k in range(size)]).alias("n"))

    def vector(row) -> np.ndarray:
        return np.array([row[f"c{k}"] or 0.0 for k in range(size)])

    total = vector(shown.agg(*[F.sum(F.col("post")[k]).alias(f"c{k}") for k in range(size)]).first())
    prior = (total + 1) / (total + 1).sum()

    def given(by: str, classes: int) -> Column:
        """log P(class | l) for a column of at most ``classes`` values. A
        missing or never seen class says nothing (0 for every language)."""
        out = F.lit([0.0] * size)
        for r in counts(by).filter(f"{by} != ''").collect():
            p = np.log((np.array(r["n"]) + 0.5) / (total + 0.5 * classes))
            out = F.when(F.col(by) == F.lit(r[by]), F.lit([float(v) for v in p])).otherwise(out)
        return out

    told_col, code_col = given("told", size + 2), given("coded", size + 1)
    # suffix, domain and host tables grow with the input: joined, not broadcast
    suffix = counts("suffix").filter("suffix IS NOT NULL").select("suffix", F.col("n").alias("ns"))
    host = counts("domain", "host").filter("host IS NOT NULL").select("host", F.col("n").alias("nh"))
    domain = counts("domain").filter("domain IS NOT NULL").select("domain", F.col("n").alias("nd"))
    q = p.join(suffix, "suffix", "left").join(domain, "domain", "left").join(host, "host", "left")
    zero = F.lit([0.0] * size)
    ns, nd, nh = (F.coalesce(c, zero) for c in ("ns", "nd", "nh"))
    own = F.when(F.col("has_text"), F.col("post")).otherwise(zero)
    scores = []
    sums = {name: sum((v[k] for k in range(1, size)), v[0]) for name, v in (("nd", nd), ("nh", nh))}
    for k in range(size):
        alone = F.when(F.col("has_text") & F.col("host").isNotNull(), F.lit(1.0)).otherwise(0.0)
        up = (F.greatest(nd[k] - own[k], F.lit(0.0)) + strength * float(prior[k])) / (F.greatest(sums["nd"] - alone, F.lit(0.0)) + strength)
        here = (F.greatest(nh[k] - own[k], F.lit(0.0)) + strength * up) / (F.greatest(sums["nh"] - alone, F.lit(0.0)) + strength)
        address_part = F.when(F.col("suffix").isNull(), F.lit(0.0)).otherwise(F.log((ns[k] + 0.5) / (float(total[k]) + 5.0)))
        scores.append(F.col("ll")[k] + F.log(here) + told_col[k] + code_col[k] + address_part)
    q = q.withColumn("s", F.array(*scores)).withColumn("top", F.array_max("s"))
    names = F.lit(langs)
    best = F.array_position("s", F.col("top")).cast("int") - 1
    prob = 1 / F.aggregate("s", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top")))
    text_best = F.when(F.col("has_text"), names[F.array_position("ll", F.array_max("ll")).cast("int") - 1])
    return q.select(F.col("id").alias(id_col), F.col("url").alias(url_col), names[best].alias("lang"), prob.alias("prob"), text_best.alias("text_lang"), "declared")
