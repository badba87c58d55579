"""Plug-in registries: text corpora (E3) and chat datasets.

A corpus entry says how its files are read and how a row becomes
``text``; a chat entry says how its files are read and which normaliser
turns a row into ``(id, text, chat)``. Both are plain data, looked up by
name; ``register_*`` adds new ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat


@dataclass(frozen=True)
class CorpusSpec:
    fmt: str                                    # reader format of the files
    glob: str                                   # file pattern
    text: Callable[[DataFrame], DataFrame] | None = None   # row -> text
    drop: tuple[str, ...] = ()                  # columns removed after the map


def title_content(df: DataFrame) -> DataFrame:
    """``title + ' ' + content``; a null prints as ``None``."""
    return df.withColumn("text", F.concat(F.coalesce(F.col("title").cast("string"), F.lit("None")), F.lit(" "),
                                          F.coalesce(F.col("content").cast("string"), F.lit("None"))))


def content_as_text(df: DataFrame) -> DataFrame:
    """``content`` -> ``text``."""
    return df.withColumn("text", F.col("content"))


def content_only(df: DataFrame) -> DataFrame:
    """Only ``content``, as ``text`` (the scan reads that column only)."""
    return df.select(F.col("content").alias("text"))


# The five corpora, their file patterns and dropped columns.
CORPORA: dict[str, CorpusSpec] = {
    "wanjuan-cc": CorpusSpec("json", "*.jsonl", title_content,
                             ("id", "content", "title", "language", "date", "token_num", "cbytes_num",
                              "line_num", "char_num", "toxic_score", "fluency_score", "not_ad_score",
                              "porn_score")),
    "SkyPile": CorpusSpec("json", "*.jsonl"),
    "StarCoderData": CorpusSpec("parquet", "*.parquet", content_only),
    "RefinedWeb": CorpusSpec("parquet", "*.parquet", content_as_text,
                             ("url", "content", "timestamp", "dump", "segment", "image_urls")),
    "FakeText": CorpusSpec("memory", ""),
}

# The four rows of the in-memory corpus.
FAKE_TEXTS = [
    "This is a fake text",
    "This is another fake text",
    "How many fake texts are there?",
    "This is the last fake text",
]


def register_corpus(name: str, spec: CorpusSpec) -> None:
    CORPORA[name] = spec


def fake_texts(spark: SparkSession) -> DataFrame:
    """The in-memory corpus; train and validation are the same rows."""
    return spark.createDataFrame([(t,) for t in FAKE_TEXTS], "text string")


def corpus_text(name: str, rows: DataFrame) -> DataFrame:
    """Apply the corpus's text map and drop its listed columns."""
    spec = CORPORA[name]
    out = spec.text(rows) if spec.text else rows
    drop = [c for c in spec.drop if c in out.columns]
    return out.drop(*drop) if drop else out


def read_corpus(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Read a corpus folder (recursive, by its pattern) and map it to text."""
    spec = CORPORA[name]
    if spec.fmt == "memory":
        return fake_texts(spark)
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", spec.glob)
    return corpus_text(name, r.format(spec.fmt).load(path))


@dataclass(frozen=True)
class ChatSpec:
    fmt: str                    # 'json' lines, 'json_array' or 'parquet'
    glob: str
    normalise: Callable[..., DataFrame]
    schema: str          # columns of the raw rows (a missing one reads as null)
    kwargs: dict = field(default_factory=dict)
    tree: bool = False


_PAIR = "id string, instruction string, output string"
_TRIPLE = "id string, instruction string, input string, output string"

# The nine chat datasets, their formats, patterns and columns.
CHAT_DATASETS: dict[str, ChatSpec] = {
    "Magicoder": ChatSpec("json", "*.jsonl", chat.code_problem, "id string, problem string, solution string"),
    "COIG-CQIA": ChatSpec("json", "*.jsonl", chat.inst_input_output, _TRIPLE),
    "SlimOrca": ChatSpec("json", "*.jsonl", chat.from_value, "id string, conversations array<struct<from:string,value:string>>"),
    "ultrachat": ChatSpec("json", "*.jsonl", chat.alternating, "id string, data array<string>"),
    "Evol-Instruct-Code-80k-v1": ChatSpec("json_array", "*.json", chat.inst_output, _PAIR),
    "commitpackft": ChatSpec("json", "*.jsonl", chat.commit_edit,
                             "id string, lang string, old_contents string, message string, new_contents string"),
    "openhermes": ChatSpec("json_array", "*.json", chat.inst_input_output, _TRIPLE),
    "oasst2": ChatSpec("json", "*.jsonl", chat.tree_paths, "id string, prompt string", tree=True),
    "MathInstruct": ChatSpec("json_array", "*.json", chat.inst_output, _PAIR),
}


def register_chat_dataset(name: str, spec: ChatSpec) -> None:
    CHAT_DATASETS[name] = spec


def prepare_chat(spark: SparkSession, name: str, input_path: str, output_path: str | None = None,
                 max_file_bytes: int = 400 * 1024 * 1024) -> DataFrame:
    """Read a chat dataset's raw files with its reader, normalise, and
    (with ``output_path``) write ``(id, text, chat)`` Parquet per dataset.
    Rows without an id get ``path/position``; trees give one chat per path."""
    from ..sources import readers, sinks
    spec = CHAT_DATASETS[name]
    if spec.tree:
        raw = readers.read_jsonl_positions(spark, input_path, spec.schema, pattern=spec.glob)
        raw = raw.select(F.coalesce(F.nullif("id", F.lit("")), readers.default_id()).alias("id"), "prompt")
        out = spec.normalise(spark, chat.nested_tree_edges(raw))
    else:
        read = readers.read_json_positions if spec.fmt == "json_array" else readers.read_jsonl_positions
        raw = read(spark, input_path, spec.schema, pattern=spec.glob)
        out = spec.normalise(raw, id_col="id", default_id=readers.default_id("file_path", "id_in_file"), **spec.kwargs)
    out = out.withColumn("dataset_name", F.lit(name))
    return sinks.write_chat(out, output_path, max_file_bytes) if output_path else out
