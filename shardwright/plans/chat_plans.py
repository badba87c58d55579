"""Chat queries. ``conversations(conv_id, turn, role, text)`` regrouped by
``conv_id`` in ``turn`` order stands for each raw dataset shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chat as chatf
from ..operators import chat, packing
from .registry import query
from .tables import table

SEED = 42


def turns(spark, sf_dir) -> DataFrame:
    """``(id, turns array<struct<turn,role,text>>)``; a conversation has 2 to 8 turns."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")) \
        .withColumnRenamed("conv_id", "id")


def groups(spark, sf_dir, k: int) -> DataFrame:
    """Each conversation cut into successive groups of ``k`` turns (the last
    one may be shorter): ``(id = conv_id/group, conv_id, turns)``."""
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(size(turns) - 1) div {k}").cast("int")),
                      lambda i: F.slice("turns", i * k + 1, k))
    g = turns(spark, sf_dir).select(F.col("id").alias("conv_id"), F.posexplode(cut).alias("g", "turns"))
    return g.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("g").cast("string")).alias("id"), "conv_id", "turns")


def _t(i):
    return F.get(F.col("turns"), i)["text"]


def raw_code_problem(spark, sf_dir):
    return groups(spark, sf_dir, 2).select("id", _t(0).alias("problem"), F.coalesce(_t(1), F.lit("")).alias("solution"))


def raw_inst_input_output(spark, sf_dir):
    n = F.size("turns")
    return groups(spark, sf_dir, 3).select(
        "id", F.when(n >= 2, _t(0)).otherwise(F.lit("")).alias("instruction"),
        F.when(n >= 3, _t(1)).otherwise(F.lit("")).alias("input"),
        F.when(n >= 3, _t(2)).when(n == 2, _t(1)).otherwise(_t(0)).alias("output"))


def raw_from_value(spark, sf_dir):
    return turns(spark, sf_dir).select(
        "id", F.transform("turns", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value")))
        .alias("conversations"))


def raw_alternating(spark, sf_dir):
    return turns(spark, sf_dir).select("id", F.transform("turns", lambda x: x["text"]).alias("data"))


def raw_inst_output(spark, sf_dir):
    return groups(spark, sf_dir, 2).select("id", _t(0).alias("instruction"), _t(1).alias("output"))


def raw_commit(spark, sf_dir):
    return groups(spark, sf_dir, 3).select(
        "id", F.when(F.col("conv_id") % 2 == 0, F.lit("Python")).otherwise(F.lit("Java")).alias("lang"),
        _t(0).alias("old_contents"), _t(1).alias("message"),
        F.get(F.col("turns"), F.size("turns") - 1)["text"].alias("new_contents"))


def tree_edges(spark, sf_dir):
    """Parent of turn t is ``(t - 1) div 2``; turn 0 is the root."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("tree_id"), F.col("turn").alias("node_id"),
                    F.when(F.col("turn") == 0, F.lit(None)).otherwise(F.expr("(turn - 1) div 2"))
                    .cast("bigint").alias("parent_id"),
                    F.col("turn").alias("ordinal"), "role", "text")


def summary(df: DataFrame) -> DataFrame:
    """Comparable form of a chat table."""
    return df.select("id", F.md5("text").alias("text_md5"), F.size("chat").cast("bigint").alias("n_turns"),
                     F.array_join(F.transform("chat", lambda x: x["role"]), ",").alias("roles"))


# --- DuckDB pieces -----------------------------------------------------------

def _render(role, content):
    return f"('<|im_start|>' || {role} || ':' || chr(10) || ' ' || {content} || '<|im_end|>' || chr(10))"


def _groups_sql(k):
    return f"""
r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rk FROM conversations),
c AS (
  SELECT conv_id::VARCHAR || '/' || (rk // {k})::VARCHAR AS id, conv_id, count(*) AS n,
         max(CASE WHEN rk % {k} = 0 THEN text END) AS t0, max(CASE WHEN rk % {k} = 1 THEN text END) AS t1,
         max(CASE WHEN rk % {k} = 2 THEN text END) AS t2, arg_max(text, rk) AS tl
  FROM r GROUP BY conv_id, rk // {k})"""


def _u(key_sql):
    return f"((('0x' || substr(md5('{SEED}:' || {key_sql}), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370497::DOUBLE)"


_EN_CODE = chat.CODE_PROBLEM_INSTRUCTION["en"]
_ZH_CODE = chat.CODE_PROBLEM_INSTRUCTION["zh"]


@query("chat_code_problem", sql=f"""
WITH {_groups_sql(2)},
x AS (SELECT id, CASE WHEN {_u('id')} < 0.8::DOUBLE THEN '{_EN_CODE}' ELSE '{_ZH_CODE}' END AS inst, t0,
             coalesce(t1, '') AS t1 FROM c)
SELECT id, md5({_render("'instruction'", 'inst')} || {_render("'user'", 't0')} || {_render("'assistant'", 't1')}) AS text_md5,
       3::BIGINT AS n_turns, 'instruction,user,assistant' AS roles
FROM x""")
def q_chat_code_problem(spark, sf_dir):
    return summary(chat.code_problem(raw_code_problem(spark, sf_dir), seed=SEED))


@query("chat_inst_input_output", sql=f"""
WITH {_groups_sql(3)},
x AS (SELECT id, CASE WHEN n >= 2 THEN t0 ELSE '' END AS instruction, CASE WHEN n >= 3 THEN t1 ELSE '' END AS input,
             CASE WHEN n >= 3 THEN t2 WHEN n = 2 THEN t1 ELSE t0 END AS output FROM c)
SELECT id,
       md5(CASE WHEN length(instruction) > 0 THEN {_render("'instruction'", 'instruction')} ELSE '' END
           || CASE WHEN length(input) > 0 THEN {_render("'user'", 'input')} ELSE '' END
           || {_render("'assistant'", 'output')}) AS text_md5,
       ((length(instruction) > 0)::INTEGER + (length(input) > 0)::INTEGER + 1)::BIGINT AS n_turns,
       concat_ws(',', CASE WHEN length(instruction) > 0 THEN 'instruction' END,
                 CASE WHEN length(input) > 0 THEN 'user' END, 'assistant') AS roles
FROM x""")
def q_chat_inst_input_output(spark, sf_dir):
    return summary(chat.inst_input_output(raw_inst_input_output(spark, sf_dir)))


@query("chat_from_value", sql=f"""
SELECT conv_id::VARCHAR AS id, md5(string_agg({_render('role', 'text')}, '' ORDER BY turn)) AS text_md5,
       count(*) AS n_turns, string_agg(role, ',' ORDER BY turn) AS roles
FROM conversations GROUP BY conv_id""")
def q_chat_from_value(spark, sf_dir):
    return summary(chat.from_value(raw_from_value(spark, sf_dir)))


@query("chat_alternating", sql=f"""
WITH r AS (SELECT conv_id, turn, text,
                  CASE WHEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 2 = 0
                       THEN 'user' ELSE 'assistant' END AS role FROM conversations)
SELECT conv_id::VARCHAR AS id, md5(string_agg({_render('role', 'text')}, '' ORDER BY turn)) AS text_md5,
       count(*) AS n_turns, string_agg(role, ',' ORDER BY turn) AS roles
FROM r GROUP BY conv_id""")
def q_chat_alternating(spark, sf_dir):
    return summary(chat.alternating(raw_alternating(spark, sf_dir)))


@query("chat_inst_output", sql=f"""
WITH {_groups_sql(2)}
SELECT id, md5({_render("'instruction'", "coalesce(t0, 'None')")} || {_render("'assistant'", "coalesce(t1, 'None')")}) AS text_md5,
       2::BIGINT AS n_turns, 'instruction,assistant' AS roles
FROM c""")
def q_chat_inst_output(spark, sf_dir):
    return summary(chat.inst_output(raw_inst_output(spark, sf_dir)))


_EN_COMMIT = chat.COMMIT_INSTRUCTION["en"].split("{lang}")
_ZH_COMMIT = chat.COMMIT_INSTRUCTION["zh"].split("{lang}")


@query("chat_commit_edit", sql=f"""
WITH {_groups_sql(3)},
x AS (SELECT id, CASE WHEN conv_id % 2 = 0 THEN 'Python' ELSE 'Java' END AS lang, t0, t1, tl,
             {_u('id')} < 0.9::DOUBLE AS en FROM c),
y AS (SELECT id,
        CASE WHEN en THEN '{_EN_COMMIT[0]}' || lang || '{_EN_COMMIT[1]}'
             ELSE '{_ZH_COMMIT[0]}' || lang || '{_ZH_COMMIT[1]}' END AS inst,
        t0 || chr(10) || chr(10) || CASE WHEN en THEN 'Modification requirements: ' ELSE '修改要求：' END || coalesce(t1, 'None') AS usr,
        tl FROM x)
SELECT id, md5({_render("'instruction'", 'inst')} || {_render("'user'", 'usr')} || {_render("'assistant'", 'tl')}) AS text_md5,
       3::BIGINT AS n_turns, 'instruction,user,assistant' AS roles
FROM y""")
def q_chat_commit_edit(spark, sf_dir):
    return summary(chat.commit_edit(raw_commit(spark, sf_dir), seed=SEED))


_TREE_SQL = f"""
WITH RECURSIVE e AS (
  SELECT conv_id AS tree_id, turn AS node_id,
         CASE WHEN turn = 0 THEN NULL ELSE (turn - 1) // 2 END AS parent_id, turn AS ordinal, role, text
  FROM conversations),
walk(tree_id, node_id, ords, txt, roles, depth) AS (
  SELECT tree_id, node_id, [ordinal], {_render('role', 'text')}, role, 1 FROM e WHERE parent_id IS NULL
  UNION ALL
  SELECT c.tree_id, c.node_id, list_append(w.ords, c.ordinal), w.txt || {_render('c.role', 'c.text')},
         w.roles || ',' || c.role, w.depth + 1
  FROM walk w JOIN e c ON c.tree_id = w.tree_id AND c.parent_id = w.node_id),
leaf AS (
  SELECT * FROM walk w
  WHERE depth > 1 AND NOT EXISTS (SELECT 1 FROM e c WHERE c.tree_id = w.tree_id AND c.parent_id = w.node_id))
SELECT tree_id::VARCHAR || '/' || (row_number() OVER (PARTITION BY tree_id ORDER BY ords) - 1)::VARCHAR AS id,
       md5(txt) AS text_md5, depth::BIGINT AS n_turns, roles
FROM leaf"""


@query("chat_tree_paths", sql=_TREE_SQL)
def q_chat_tree_paths(spark, sf_dir):
    return summary(chat.tree_paths(spark, tree_edges(spark, sf_dir)))


@query("chat_render", sql=f"""
SELECT conv_id AS conv_id, md5(string_agg({_render('role', 'text')}, '' ORDER BY turn)) AS text_md5,
       sum(strlen(text) + strlen(role))::BIGINT + 26 * count(*) AS n_bytes
FROM conversations GROUP BY conv_id""")
def q_chat_render(spark, sf_dir):
    c = turns(spark, sf_dir).select(
        F.col("id").alias("conv_id"),
        F.transform("turns", lambda x: chatf.turn(x["role"], x["text"])).alias("chat"))
    t = c.select("conv_id", chatf.render_train("chat").alias("text"))
    return t.select("conv_id", F.md5("text").alias("text_md5"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("chat_render_infer", sql="""
SELECT conv_id,
       md5(CASE WHEN arg_min(role, turn) <> 'system'
                THEN '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) ELSE '' END
           || string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)
           || '<|im_start|>assistant' || chr(10)) AS text_md5
FROM conversations GROUP BY conv_id""")
def q_chat_render_infer(spark, sf_dir):
    c = turns(spark, sf_dir).select(
        F.col("id").alias("conv_id"),
        F.transform("turns", lambda x: chatf.turn(x["role"], x["text"])).alias("chat"))
    return c.select("conv_id", F.md5(chatf.render_infer("chat", True)).alias("text_md5"))


@query("special_token_counts", sql="""
SELECT * FROM (VALUES ('<|endoftext|>', 0), ('<|im_start|>', 1), ('<|im_end|>', 2)) AS s(token, token_id)
JOIN (SELECT 0 AS token_id, count(DISTINCT conv_id) AS n FROM conversations
      UNION ALL SELECT 1, count(*) FROM conversations
      UNION ALL SELECT 2, count(*) FROM conversations) USING (token_id)""")
def q_special_token_counts(spark, sf_dir):
    """F5 + Q22: specials in tokenized rendered chats (EOS appended)."""
    from ..functions import tokens
    c = turns(spark, sf_dir).select(
        F.transform("turns", lambda x: chatf.turn(x["role"], x["text"])).alias("chat"))
    tok = packing.tokenize(c.select(chatf.render_train("chat").alias("text")), "text", add_eos=True)
    sp = tok.select(F.explode(F.filter("ids", lambda x: x < F.lit(tokens.BYTE_OFFSET))).alias("token_id"))
    names = F.array(*[F.lit(s) for s in tokens.SPECIAL_TOKENS])
    return sp.groupBy("token_id").agg(F.count("*").alias("n")) \
        .select(F.get(names, F.col("token_id")).alias("token"), "token_id", "n")
