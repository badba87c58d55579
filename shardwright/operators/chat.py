"""Chat normalisers: raw instruction / conversation rows -> ``(id, text, chat)``.

Two parametrised forms cover the flat datasets:
- a *column spec*: an ordered list of turns ``(role, content expression,
  optional)``; optional turns are left out when empty;
- an *array spec*: one turn per element of an array column, role and
  content taken from the element (or alternating by index).
Trees (a prompt with nested replies) become one chat per root-to-leaf path
by pointer doubling over an edge table. Everything is JVM-side SQL; only
trees shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import render_train, turn
from ..functions.hashing import uniform
from ..session import materialize
from .ordering import ordinal, with_range_bucket

CHAT_COLUMNS = ["id", "text", "chat"]

# System instructions of two datasets, by language.
CODE_PROBLEM_INSTRUCTION = {
    "zh": "你是一位经验丰富的程序员，请根据我的需求帮助我编写代码。",
    "en": "You are an experienced programmer, please help me write some code according to my needs.",
}
COMMIT_INSTRUCTION = {  # {lang} is the programming language of the commit
    "zh": "我将给你一段{lang}代码，请你按照我的要求修改代码",
    "en": "I will give you a piece of {lang} code, please modify the code according to my requirements",
}
COMMIT_REQUEST = {  # between the old code and the commit message
    "zh": "\n\n修改要求：",
    "en": "\n\nModification requirements: ",
}
CODE_PROBLEM_EN_RATE = 0.8
COMMIT_EN_RATE = 0.9


@dataclass(frozen=True)
class Turn:
    role: str | Column
    content: Column
    optional: bool = False   # left out when null or empty


def _id(df: DataFrame, id_col: str | None, default_id: Column | None) -> Column:
    """The raw id as a string; an empty or missing id falls back to
    ``default_id`` (``path/position``)."""
    raw = F.nullif(F.col(id_col).cast("string"), F.lit("")) if id_col else F.lit(None).cast("string")
    return F.coalesce(raw, default_id) if default_id is not None else raw


def from_columns(df: DataFrame, turns: Sequence[Turn], id_col: str | None = "id",
                 default_id: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Column spec -> ``(id, text, chat)``."""
    structs = [turn(t.role, t.content) for t in turns]
    arr = F.array(*structs)
    opt = [t.optional for t in turns]
    if any(opt):
        # keep turn i unless it is optional and empty
        flags = F.array(*[F.lit(o) for o in opt])
        arr = F.filter(F.arrays_zip(arr.alias("t"), flags.alias("o")),
                       lambda z: ~z["o"] | (F.coalesce(F.length(z["t"]["content"]), F.lit(0)) > 0))
        arr = F.transform(arr, lambda z: z["t"])
    out = df.select(_id(df, id_col, default_id).alias("id"), arr.alias("chat"), *keep)
    return out.select("id", render_train("chat").alias("text"), "chat", *keep)


def from_array(df: DataFrame, array_col: str, role: str | None = None, content: str | None = None,
               alternate: Sequence[str] = ("user", "assistant"), id_col: str | None = "id",
               default_id: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Array spec -> ``(id, text, chat)``. With ``role``/``content`` field
    names each element gives its turn; without, elements are the contents
    and roles alternate by index."""
    if role is not None:
        chat = F.transform(F.col(array_col), lambda x: turn(x[role], x[content]))
    else:
        a, b = alternate
        chat = F.transform(F.col(array_col),
                           lambda x, i: turn(F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)), x))
    out = df.select(_id(df, id_col, default_id).alias("id"), chat.alias("chat"), *keep)
    return out.select("id", render_train("chat").alias("text"), "chat", *keep)


def _lang_draw(seed, key: Column, p_en: float) -> Column:
    """R8: 'en' with probability ``p_en``, else 'zh', from a seeded hash."""
    return F.when(uniform(seed, key) < F.lit(p_en), F.lit("en")).otherwise(F.lit("zh"))


# --- the nine datasets -----------------------------------------------------

def code_problem(df: DataFrame, seed=42, id_col="id", default_id=None) -> DataFrame:
    """H1: problem / solution with a system instruction, English with p=0.8."""
    key = _id(df, id_col, default_id)
    inst = F.when(_lang_draw(seed, key, CODE_PROBLEM_EN_RATE) == "en",
                  F.lit(CODE_PROBLEM_INSTRUCTION["en"])).otherwise(F.lit(CODE_PROBLEM_INSTRUCTION["zh"]))
    return from_columns(df, [Turn("instruction", inst), Turn("user", F.col("problem")),
                             Turn("assistant", F.col("solution"))], id_col, default_id)


def inst_input_output(df: DataFrame, id_col="id", default_id=None) -> DataFrame:
    """H2 / H7: instruction and input when non-empty, then output. A missing
    input counts as empty."""
    return from_columns(df, [Turn("instruction", F.col("instruction"), True),
                             Turn("user", F.col("input"), True),
                             Turn("assistant", F.col("output"))], id_col, default_id)


def from_value(df: DataFrame, id_col="id", default_id=None) -> DataFrame:
    """H3: ``conversations`` of ``{from, value}``."""
    return from_array(df, "conversations", "from", "value", id_col=id_col, default_id=default_id)


def alternating(df: DataFrame, id_col="id", default_id=None) -> DataFrame:
    """H4: ``data`` of strings, user / assistant alternating."""
    return from_array(df, "data", id_col=id_col, default_id=default_id)


def inst_output(df: DataFrame, id_col="id", default_id=None) -> DataFrame:
    """H5 / H9: instruction then output; a null instruction prints as ``None``."""
    return from_columns(df, [Turn("instruction", F.col("instruction")),
                             Turn("assistant", F.col("output"))], id_col, default_id)


def commit_edit(df: DataFrame, seed=42, id_col="id", default_id=None) -> DataFrame:
    """H6: code edit from a commit, English with p=0.9."""
    key = _id(df, id_col, default_id)
    en = _lang_draw(seed, key, COMMIT_EN_RATE) == "en"
    lang = F.coalesce(F.col("lang"), F.lit("None"))
    inst = F.when(en, F.replace(F.lit(COMMIT_INSTRUCTION["en"]), F.lit("{lang}"), lang)) \
        .otherwise(F.replace(F.lit(COMMIT_INSTRUCTION["zh"]), F.lit("{lang}"), lang))
    req = F.when(en, F.lit(COMMIT_REQUEST["en"])).otherwise(F.lit(COMMIT_REQUEST["zh"]))
    user = F.concat(F.coalesce(F.col("old_contents"), F.lit("None")), req,
                    F.coalesce(F.col("message"), F.lit("None")))
    return from_columns(df, [Turn("instruction", inst), Turn("user", user),
                             Turn("assistant", F.col("new_contents"))], id_col, default_id)


def tree_paths(spark, edges: DataFrame) -> DataFrame:
    """One chat per root-to-leaf path with more than one turn, in
    depth-first order; id ``<tree>/<k>`` with k counted over emitted paths.

    ``edges``: ``(tree_id, node_id, parent_id, ordinal, role, text)``, roots
    have a null parent; ``ordinal`` orders siblings. Any depth and number of
    nodes: each node's pointer to its ancestor doubles its reach per round,
    and the leaves collect the ancestors they can reach, so a depth of d
    takes log2(d) rounds. The rounds carry keys only and are written to the
    shared folder; the texts join once, at the end. Nodes whose ancestors
    do not lead to a root are left out; a cycle raises an error."""
    e = edges.select("tree_id", "node_id", "parent_id", "ordinal",
                     F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    keys = materialize(spark, e.select("tree_id", "node_id", "parent_id"), "tree-nodes")
    # pointers to an ancestor that exists, ``reach`` levels up
    up = keys.filter("parent_id IS NOT NULL").join(
        keys.select("tree_id", F.col("node_id").alias("parent_id")), ["tree_id", "parent_id"], "left_semi") \
        .select("tree_id", "node_id", F.col("parent_id").alias("anc"))
    parents = keys.filter("parent_id IS NOT NULL").select("tree_id", F.col("parent_id").alias("node_id"))
    leaves = keys.join(parents, ["tree_id", "node_id"], "left_anti").filter("parent_id IS NOT NULL")
    pairs = leaves.select("tree_id", F.col("node_id").alias("leaf"), F.col("node_id").alias("anc"),
                          F.lit(0).cast("bigint").alias("dist"))
    most = max(keys.count(), 1)
    reach = 1
    while True:
        up, pairs = materialize(spark, up, "tree-pointers"), materialize(spark, pairs, "tree-pairs")
        if up.isEmpty():
            break
        if reach > 2 * most:
            raise ValueError("the reply tree holds a cycle")
        step = up.select("tree_id", F.col("node_id").alias("anc"), F.col("anc").alias("higher"))
        far = pairs.join(step, ["tree_id", "anc"]).select("tree_id", "leaf", F.col("higher").alias("anc"),
                                                          (F.col("dist") + reach).alias("dist"))
        pairs = pairs.unionByName(far)
        up = up.join(step, ["tree_id", "anc"]).select("tree_id", "node_id", F.col("higher").alias("anc"))
        reach *= 2
    turns = pairs.join(e.withColumnRenamed("node_id", "anc"), ["tree_id", "anc"])
    paths = turns.groupBy("tree_id", "leaf").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "ordinal", "role", "text"))).alias("p"),
        F.max_by(F.col("parent_id").isNull(), "dist").alias("rooted")).filter("rooted")
    paths = paths.select("tree_id", F.transform("p", lambda x: x["ordinal"]).alias("ords"),
                         F.transform("p", lambda x: turn(x["role"], x["text"])).alias("chat"))
    # numbered by ranges of (tree, place): the chats of a large tree are spread over tasks
    placed = with_range_bucket(paths, ["tree_id", "ords"])
    out = ordinal(placed, ["ords"], by=["tree_id"], bucket=F.col("__rbucket"), out="k")
    return out.select(F.concat_ws("/", F.col("tree_id").cast("string"), F.col("k").cast("string")).alias("id"),
                      render_train("chat").alias("text"), "chat")


def drop_empty(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents with empty text are dropped."""
    return df.filter(F.coalesce(F.length(text), F.lit(0)) > 0)


def _walk(tree_id: str, text: str | None):
    """Nodes of one nested tree, parents first: ``(tree_id, node_id,
    parent_id, ordinal, role, text)``, node ids counted in that order."""
    def plain(v):
        return v if v is None or isinstance(v, str) else json.dumps(v)

    try:
        stack = [(json.loads(text) if text is not None else {}, None, 0)]
    except (ValueError, RecursionError) as broken:
        raise ValueError(f"tree {tree_id} is not a JSON tree: {broken}") from None
    n = 0
    while stack:
        node, parent, place = stack.pop()
        replies = node.get("replies") if isinstance(node, dict) else 0
        if not (replies is None or isinstance(replies, list)):
            raise ValueError(f"tree {tree_id} is not a JSON tree: a node is {str(node)[:80]!r}")
        own, n = str(n), n + 1
        yield tree_id, own, parent, place, plain(node.get("role")), plain(node.get("text"))
        stack += [(r, own, i) for i, r in reversed(list(enumerate(replies or []))) if r is not None]


def nested_tree_edges(df: DataFrame, prompt: str = "prompt", tree_id: str = "id") -> DataFrame:
    """Edge table of nested trees ``{role, text, replies: [...]}`` given as
    JSON text (one tree per row). Each text is parsed once and walked with a
    stack in the task that reads it; a missing text is a root without role
    and text, one that is not such a tree fails the job."""
    names = ["tree_id", "node_id", "parent_id", "ordinal", "role", "text"]

    def run(batches):
        def batch(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int32()),
                                               *(pa.array(c, pa.string()) for c in cols[4:])], names=names)

        rows = []
        for b in batches:
            for tree, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in _walk(tree, text):
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return df.select(F.col(tree_id).cast("string"), F.col(prompt).cast("string")).mapInArrow(
        run, "tree_id string, node_id string, parent_id string, ordinal int, role string, text string")
