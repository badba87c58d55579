"""One query ``opN_<name>`` per operator, over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, exact_dedup, html_crf, jaccard_join, language_id, pack_histogram, packing_ga, prefix_trie,
               quality, sentence_dedup, spelling_trie, suffix_dedup, warc)
from .crc_sql import crc32
from .registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@query("op5_exact_dedup", """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
""")
def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


@query("op9_jaccard_join", sql=r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')))) END AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) > 0 THEN min(doc_id) OVER (PARTITION BY md5(array_to_string(sh, chr(10)))) ELSE doc_id END AS rep, sh FROM s),
g AS (SELECT rep, n, unnest(sh) AS x FROM t WHERE doc_id = rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.x = b.x AND a.rep < b.rep
      GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT t.doc_id, t.n::BIGINT AS n_shingles, least(t.rep, coalesce(c.b, t.rep)) AS component_id FROM t LEFT JOIN c ON c.a = t.rep""")
def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.find_near(table(spark, sf_dir, "documents"), n_words=4, num=85, den=100)


@query("op10_suffix_dedup", sql="""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
b AS (SELECT doc_id, hx, len(hx) // 2 AS n FROM h),
f AS (SELECT doc_id, n, c, substr(hx, 800 * c + 1, 1600) AS part FROM (SELECT doc_id, n, hx, unnest(range(0, n // 400)) AS c FROM b)),
k AS (SELECT doc_id, 400 * c + j AS i, md5(substr(part, 2 * j + 1, 800)) AS key
      FROM (SELECT *, unnest(range(0, least(400, n - 399 - 400 * c))) AS j FROM f)),
d AS (SELECT doc_id, i FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)),
o AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS fresh FROM d),
u AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o),
s AS (SELECT doc_id, run, min(i) AS lo, max(i) + 400 AS hi FROM u GROUP BY doc_id, run),
q AS (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS prev FROM s),
m AS (SELECT q.doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last,
             string_agg(substr(b.hx, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS kept
      FROM q JOIN b USING (doc_id) GROUP BY q.doc_id)
SELECT b.doc_id, b.n::BIGINT AS n_bytes, coalesce(m.n_removed, 0)::BIGINT AS n_removed, coalesce(m.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN m.doc_id IS NULL THEN b.hx ELSE m.kept || substr(b.hx, 2 * m.last + 1) END)) AS kept_sha256
FROM b LEFT JOIN m ON m.doc_id = b.doc_id""")
def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.find_repeats(table(spark, sf_dir, "documents"), length=400)


@query("op1_decontaminate")
def op1_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_files() -> dict:
    """Rank file and split pattern of the public byte vocabulary."""
    import public_tokenizers

    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    return packing_ga.pack(table(spark, sf_dir, "documents"), **tokenizer_files())


@query("op8_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
                  min(page_id) OVER (PARTITION BY html) AS lowest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> lowest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> lowest THEN lowest END AS refers_to
FROM q
""")
def op8_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages")).drop("url")


@query("op4_quality")
def op4_quality(spark, sf_dir):
    return quality.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_sentence_dedup", """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
         string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])([\\x20\\x09-\\x0D])', '\\1' || chr(1) || '\\2', 'g'),
                                     '\\n', chr(10) || chr(1), 'g'), chr(1)) AS parts
  FROM documents),
parts AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
words AS (
  SELECT *, regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+') AS w,
         regexp_extract(part, '^[^0-9A-Za-z\\x{80}-\\x{10FFFF}]*') AS head
  FROM parts),
-- white space and signs before a sentence's first word belong to the sentence before it
bits AS (
  SELECT doc_id, pos, 0 AS side, head AS bit FROM words
  UNION ALL SELECT doc_id, pos, 1, substr(part, length(head) + 1) FROM words WHERE len(w) > 0),
placed AS (
  SELECT *, greatest(1, count(*) FILTER (WHERE side = 1) OVER (PARTITION BY doc_id ORDER BY pos, side)) AS place FROM bits),
body AS (SELECT doc_id, place, string_agg(bit, '' ORDER BY pos, side) AS body FROM placed GROUP BY doc_id, place),
sentence AS (
  SELECT doc_id, row_number() OVER d AS place, len(w) AS n, array_to_string(w, ' ') AS s,
         lead(array_to_string(w, ' '), 1) OVER d AS s2, lead(len(w), 1) OVER d AS n2, lead(array_to_string(w, ' '), 2) OVER d AS s3
  FROM words WHERE len(w) > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
runs AS (
  SELECT doc_id, place, 3 AS k, concat_ws('.', s, s2, s3) AS run FROM sentence WHERE s3 IS NOT NULL
  UNION ALL SELECT doc_id, place, 2, concat_ws('.', s, s2) FROM sentence WHERE n + n2 >= 25
  UNION ALL SELECT doc_id, place, 1, s FROM sentence WHERE n >= 50),
later AS (
  SELECT doc_id, place, k FROM runs QUALIFY row_number() OVER (PARTITION BY k, run ORDER BY doc_id, place) > 1),
gone AS (SELECT DISTINCT doc_id, place + i AS place FROM later, unnest(range(k)) AS r(i))
SELECT c.doc_id, coalesce(s.n, 0) AS n_sentences, coalesce(g.n, 0) AS n_removed,
       CASE WHEN s.n IS NULL THEN c.text ELSE coalesce(b.text, '') END AS text
FROM cut c
LEFT JOIN (SELECT doc_id, count(*) AS n FROM sentence GROUP BY doc_id) s USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(body, '' ORDER BY place) AS text FROM body ANTI JOIN gone USING (doc_id, place)
           GROUP BY doc_id) b USING (doc_id)""")
def op2_sentence_dedup(spark, sf_dir):
    return sentence_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op3_html_crf")
def op3_html_crf(spark, sf_dir):
    model = html_crf.fit(table(spark, sf_dir, "documents"))
    return html_crf.extract(table(spark, sf_dir, "pages"), model)


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op13_pack_histogram")
def op13_pack_histogram(spark, sf_dir):
    return pack_histogram.pack(table(spark, sf_dir, "documents"), **tokenizer_files())


@query("op12_prefix_trie", f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT i.conv_id, o.place, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 5 AND o.place <= i.h
  UNION ALL
  SELECT i.conv_id, o.place, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.place > i.h),
seqs AS (
  SELECT conv_id, list(length(role) || ':' || role || text ORDER BY place) AS seq, list(strlen(text) ORDER BY place) AS sizes
  FROM turns GROUP BY conv_id),
whole AS (SELECT conv_id, coalesce(seq, []) AS seq, coalesce(sizes, []) AS sizes FROM ids LEFT JOIN seqs USING (conv_id)),
steps AS (SELECT conv_id, d AS depth, list_slice(seq, 1, d) AS path, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(seq) AS ends
          FROM whole, unnest(range(0, len(seq) + 1)) AS r(d)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM steps GROUP BY path, depth),
links AS (SELECT c.path, p.path AS up, p.conv_id AS parent_conv_id FROM nodes c JOIN nodes p ON c.depth > 0 AND p.path = list_slice(c.path, 1, c.depth - 1)),
childs AS (SELECT up AS path, count(*) AS n FROM links GROUP BY up),
sums AS (
  SELECT list_slice(m.path, 1, k) AS path, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.size) AS saved
  FROM nodes m LEFT JOIN childs c ON c.path = m.path, unnest(range(0, m.depth + 1)) AS r(k) GROUP BY 1)
SELECT n.conv_id, n.depth, l.parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN childs c ON c.path = n.path LEFT JOIN links l ON l.path = n.path
""")
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op11_spelling_variants", f"""
WITH RECURSIVE occurrences AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{7,}}')), '{spelling_trie.UPPER}', '{spelling_trie.LOWER}') AS run
  FROM documents),
hashed AS (SELECT run, k, {crc32("id || ':' || run")} AS h FROM (SELECT id, run, count(*) AS k FROM occurrences GROUP BY id, run)),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
vocabulary AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM vocabulary, unnest(range(1, length(word) + 1)) AS r(i)),
pairs AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN vocabulary b ON a.cut = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN vocabulary b ON a.cut = b.word),
ranked AS (
  SELECT p.word, p.near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) AS place
  FROM pairs p JOIN vocabulary v ON v.word = p.near),
formed AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 10 * v.n THEN r.near END AS form, CASE WHEN r.near_n >= 10 * v.n THEN r.near_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1),
walk AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word AND w.next IS NULL
""")
def op11_spelling_variants(spark, sf_dir):
    return spelling_trie.spelling_variants(table(spark, sf_dir, "documents"))
