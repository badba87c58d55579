import hashlib
import io
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from shardwright.llm import html_blocks, html_crf, packing_ga, warc
from shardwright.llm.queries import tokenizer_files

SF = "/root/testdata/sf0.01"


# ---- pages to text ------------------------------------------------------
@pytest.fixture(scope="module")
def model(spark):
    return html_crf.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_chain_against_enumeration():
    rng = np.random.default_rng(1)
    e, tr, sizes = rng.normal(size=(3, 4, 2)), rng.normal(size=(2, 2)), np.array([4, 2, 1])
    z, marginal, pairs = html_crf.forward_backward(e, tr, sizes)
    total = np.zeros((2, 2))
    for p, n in enumerate(sizes):
        paths = [[(k >> t) & 1 for t in range(n)] for k in range(2 ** n)]
        score = np.array([sum(e[p, t, y[t]] for t in range(n)) + sum(tr[a, b] for a, b in zip(y, y[1:])) for y in paths])
        assert z[p] == pytest.approx(np.log(np.exp(score).sum()))
        prob = np.exp(score - z[p])
        assert marginal[p, 0, 1] == pytest.approx(sum(q for q, y in zip(prob, paths) if y[0]))
        for q, y in zip(prob, paths):
            for a, b in zip(y, y[1:]):
                total[a, b] += q
    assert np.allclose(pairs, total)


def test_crf_held_out(spark, model):
    text = " ".join(r.text[:500] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50).collect())
    xs, ys = html_crf.labelled(re.split(r"(?<=\.)\s+", text), 300, seed=77)
    got = html_crf.viterbi(xs, *model)
    assert np.mean(np.concatenate(got) == np.concatenate(ys)) > 0.98


def test_crf_on_pages(spark, model):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_crf.extract(pages, model).collect()}
    right = 0
    for p in pages.collect():
        inner = p.html.split("<article>")[1].split("</article>")[0]
        want = "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inner.replace("<b>", ""))) if x)
        right += got[p.page_id].text == want
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url
    assert right >= 0.97 * len(got)


def test_extract_layouts(spark, model):
    body = "This is the first long sentence of the article, with many words. And here is another one, just as plain."
    page = (f"<!doctype html><head><title>T</title><script>var a='<p>no</p>';</script><style>p{{}}</style></head><body><div class='cookie-notice'>We use cookies.</div>"
            f"<header><div class=logo>Site</div></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav><main><article><h1>The &eacute;vent &amp; more</h1>"
            f"<p>{body}\n  {body}<p>{body}</article></main><aside class=sidebar><p>Related links here</p></aside>"
            f"<section id=comments><h3>Comments</h3><div class=comment><p>I agree with all of this very much indeed, friend.</p></div></section>"
            f"<form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2024 Site</footer>")
    rows = [(1, "u", page, "c"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", "<", "c"), (None, "u", "<p>" + body + "</p>", "c"), (1, "u", page, "c"),
            (6, "u", "<div>" * 3000 + body + "x " * 100_000, "c")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_crf.extract(df, model).collect()
    assert len(got) == 7 and html_crf.extract(df.limit(0), model).count() == 0
    text = {r.page_id: r.text for r in got}
    assert text[1] == f"The évent & more\n{body} {body}\n{body}"
    assert text[2] == text[3] == "" and text[None] == body


def test_blocks():
    b = html_blocks.blocks("<p>a &lt;b&gt;<br>c&nbsp;d <a href=x>link</a><table><tr><td>1<td>2</table><!-- <p>no --><div hidden>h</div><p>z")
    assert [(x.text, x.path[-1]) for x in b] == [("a <b> c d link", "p"), ("1", "td"), ("2", "td"), ("h", "div"), ("z", "p")]
    assert b[0].linked == 4 and b[3].hidden and not b[4].hidden


# ---- archives -----------------------------------------------------------
def test_warc_round_trip(spark):
    big, small = "<p>" + "long enough " * 20, "tiny"
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, small), (5, "u", small), (7, "u", None), (8, "u", ""), (None, "u", big), (4, "u", "é" * 70),
            (9, "u", "é" * 70), (1, "again", big)] + [(100 + k, f"http://h/{k}", f"<html><p>page {k} " + "word " * (k % 50) + "</p></html>") for k in range(300)]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id bigint, url string, html string, digest string, payload int").repartition(3)
    manifest = warc.write(df, warc.scratch_path(spark, "t"), most_bytes=20_000)
    got = warc.read(spark, manifest, with_payload=True).collect()
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) == len(got) and manifest.count() > 3
    text = defaultdict(set)
    for i, _, h in rows:
        text[i].add((h or "").encode())
    for r in got:
        (want,) = text[r.page_id]
        assert r.payload_bytes == len(want) and r.payload_digest == hashlib.sha256(want).hexdigest()
        twin = {(None): 1, 3: 1, 9: 4}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if twin is None else ("revisit", twin))
        assert (bytes(r.payload) == want) if twin is None else r.payload is None
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_dictionary_and_damage():
    records = [warc.record(k, f"http://h/{k}", b"<html>" + bytes(str(k) * 30, "ascii") + b"common words and more" * 5, "0", None, "d") for k in range(200)]
    raw = warc.archive_bytes(records)
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.read_records(io.BytesIO(raw))) == records
    plain = sum(len(zstandard.compress(r)) for r in records)
    size = int.from_bytes(raw[4:8], "little")
    assert size > 0 and len(raw) - size < plain
    with pytest.raises(Exception):
        list(warc.read_records(io.BytesIO(raw[:-5])))
    with pytest.raises(ValueError):
        warc.parse(records[0])  # its digest is not the payload's
    assert list(warc.read_records(io.BytesIO(warc.archive_bytes([b"x"])))) == [b"x"]


# ---- packing ------------------------------------------------------------
def test_ids_equal_the_tokenizers_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = [x for _, x in texts if x] + ["a<|endoftext|>b", "<|endoftext|>", "x  \n\n y\t", "  z 12345 ½ ٣ 漢字 🙂", "don't WE'LL", "\r\n\r\n ", "'s 's"]
    some += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()]
    for x in some:
        assert packing_ga.encode(x, **tokenizer_files()).tolist() == t.encode(x, add_special_tokens=False).ids


def check_packing(rows, texts, capacity):
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(np.append(packing_ga.encode(t or "", **tokenizer_files()), 2).astype("<u4"))
    got = defaultdict(list)
    seqs = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, docs in want.items():
        pieces = sorted((k, a, n, zlib.crc32(ids[a:a + n].tobytes())) for ids in docs for k, (a, n) in enumerate(cuts(len(ids), capacity)))
        assert sorted(got.pop(i)) == pieces
    assert not got
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(seqs), -(-sum(n for p in seqs.values() for _, n in p) // capacity)


def cuts(n, capacity):
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(a, capacity) for a in range(first, n, capacity)]


@pytest.mark.parametrize("capacity,chunk", [(1024, 4096), (64, 100)])
def test_packing(spark, docs, texts, empty, capacity, chunk):
    out = packing_ga.pack(docs, capacity=capacity, chunk_items=chunk, islands=3, epochs=2, **tokenizer_files())
    n, least = check_packing(out.collect(), texts, capacity)
    assert n <= 1.03 * least + 3
    assert packing_ga.pack(empty, **tokenizer_files()).count() == 0


def test_evolution_beats_its_start():
    rng = np.random.default_rng(4)
    sizes = rng.integers(200, 700, 400).tolist()
    start = packing_ga.best_fit(sorted(range(400), key=lambda i: -sizes[i]), sizes, 1024)
    best = packing_ga.evolve(sizes, 1024, 1, [], 6, 60)
    for labels in best:
        load = np.bincount(labels, sizes)
        assert load.max() <= 1024 and load.sum() == sum(sizes)
    assert best[0].max() + 1 <= len(start.items)
    again = packing_ga.evolve(sizes, 1024, 2, [best[0], best[1]], 6, 10)
    assert again[0].max() <= best[0].max()


def test_arrow_blocks_of_sliced_columns():
    from shardwright.llm import textops

    col = pa.array(["a b", None, "c" * 10, "", "d e f"]).slice(1)
    offs, data = textops.utf8(col)
    got = [(a, b, bytes(data[offs[a]:offs[b]])) for a, b in textops.blocks(offs, 4)]
    assert got == [(0, 1, b""), (1, 2, b"c" * 10), (2, 3, b""), (3, 4, b"d e f")] or b"".join(g[2] for g in got) == b"c" * 10 + b"d e f"
