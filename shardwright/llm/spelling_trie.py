"""Operator 11: spelling variants by a relational trie frontier.

The words of a corpus (with their counts) form a trie that is a distributed
edge table ``(node, letter, label, child, onward)``: a node is a prefix, known
by its hash, and an edge leads over all letters up to the next prefix where
words part or end. Two words are near if one inserted, deleted or replaced
code point makes them equal. The neighbours of all words are found at once by
a frontier of states ``(word, position, node, edits)``:

* with no edit spent a word's states are the nodes of its own path where
  other words part from it. They join the edges of their node, other than
  the word's own, and spend the edit: the edge's first letter replaces the
  word's, or is inserted before it. (A deletion is the insertion seen from
  the shorter word.)
* states with the edit spent join the edge table level by level on (node,
  next letter); they live on while the edge's label is what the word says and
  the word's letter after it is one of those that lead on from there.
* a state whose word is used up on a node where a word ends has found a
  neighbour.

Two tries, of the words and of the words backwards, let every word start in
its middle: an edit in its second half leaves the first half as it is, one in
its first half leaves the second half. So no state ever stands near the
root, where all words meet, and a node's states times its edges is bounded by
the alphabet times the words that share half of their letters.

Levels are counted in edges, not letters: a very long word has few, and
equal long stretches are compared in one step. Each level is written before
the next one reads it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import textops

RUN = "[A-Za-z\u00C0-\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``(id, run)``: maximal runs of at least ``least`` letters, A-Z
    lower-cased, one row per occurrence. ``id`` is text, a null one empty."""
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    ascii_only = F.octet_length("run") == F.length("run")  # lower() is quicker, and the same there
    return (docs.select(ident.alias("id"), F.explode(found).alias("run"))
            .withColumn("run", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))))


def with_slips(occurrences: DataFrame, every: int) -> DataFrame:
    """``(word)``: the runs, but where ``every`` divides the CRC-32 of
    ``id:run`` without its code point number CRC-32 % length."""
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return occurrences.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """``(word, n)`` of words long and frequent enough; counted per task
    before the shuffle, so a frequent word is a row per task."""
    return (words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= min_count))


# ---- the trie as tables ------------------------------------------------------
LONG = 64  # letters; a longer word is not written with each of its prefixes


def _prefix_nodes(codes: np.ndarray, offs: np.ndarray, side: int):
    """``(word, position, node, letter)`` of the prefixes of words given as
    code points, from the middle of each on; letter 0 is the end."""
    power, inverse = textops._powers(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(textops.mix(codes.astype(np.uint64) + np.uint64(1)) * power[:len(codes)], out=total[1:])
    size = np.diff(offs)
    first = np.maximum((size + 1) // 2 - 1, 0)  # where a word one letter shorter starts
    rows = size - first + 1
    word = np.repeat(np.arange(len(size)), rows)
    position = np.arange(len(word)) - np.repeat(np.cumsum(rows) - rows, rows) + first[word]
    at = offs[word] + position
    node = textops.mix((total[at] - total[offs[word]]) * inverse[offs[word]] + position.astype(np.uint64) * np.uint64(2) + np.uint64(side))
    letter = np.where(position < size[word], np.append(codes, 0)[at], 0).astype("<u4")
    return word, position, node, letter


def _prefixes(vocabulary: DataFrame) -> DataFrame:
    """``(side, word, key, position, node, letter)``: the prefixes of each
    word from its middle on (side 0) and of the word backwards (side 1);
    ``node`` hashes side and prefix, ``letter`` follows it (empty at the
    end). Words longer than ``LONG`` are null and known by ``key``."""
    names = ["side", "word", "key", "position", "node", "letter"]

    def run(batches):
        for batch in batches:
            words, size = batch.column(0), batch.column(1).to_numpy()
            for a, b in textops.blocks(np.append(0, np.cumsum(size)), 1 << 18):
                own, n = words.slice(a, b - a), size[a:b]
                codes = np.frombuffer("".join(own.to_pylist()).encode("utf-32-le"), "<u4")
                known = pa.array(np.arange(b - a), mask=n > LONG)
                for side in (0, 1):
                    if side:
                        codes, n = codes[::-1], n[::-1]
                    word, position, node, letter = _prefix_nodes(codes, np.append(0, np.cumsum(n)), side)
                    word = b - a - 1 - word if side else word
                    at = pa.array(word)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(word), side, np.int32)), own.take(known.take(at)), batch.column(2).slice(a, b - a).take(at),
                         pa.array(position.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(letter.view("<U1"))], names=names)

    return vocabulary.select("word", F.length("word").cast("bigint"), F.xxhash64("word")).mapInArrow(
        run, "side int, word string, key bigint, position int, node bigint, letter string")


def _spelt(word: str = "word"):
    """The word as its side reads it."""
    return F.when(F.col("side") == 0, F.col(word)).otherwise(F.reverse(word))


def build(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(stops, edges)`` as written tables.

    ``stops(side, word, position, node, letter)``: the nodes on each word's
    path where words part or end, with the letter the word goes on with.
    ``edges(node, letter, label, child, onward)``: one row per edge; ``onward``
    lists the letters that follow its child, `` `` (a space) for an end.
    """
    spark = vocabulary.sparkSession
    steps = _prefixes(vocabulary)
    # an ending is a letter of its own (the empty one), so a node with an end and a branch parts words too
    parting = steps.groupBy("node").agg(F.min("letter").alias("low"), F.max("letter").alias("high")).filter("low != high OR high = ''").select("node")
    parted = steps.join(parting, "node", "left_semi")
    cols = ["side", "word", "position", "node", "letter"]
    named = vocabulary.filter(F.length("word") > LONG).select("word", F.xxhash64("word").alias("key"))
    stops = materialize(spark, parted.filter("word IS NOT NULL").select(*cols).unionByName(
        parted.filter("word IS NULL").drop("word").join(named, "key").select(*cols)), "spelling-stops")
    # a word's stops are at most as many as its letters
    path = stops.groupBy("side", "word").agg(F.sort_array(F.collect_list(F.struct("position", "node", "letter"))).alias("p"))
    hop = path.select("side", "word", "p", F.explode(F.expr("sequence(1, size(p))")).alias("k")).filter("k < size(p)")
    hop = hop.select("side", "word", F.col("p")[F.col("k") - 1].alias("x"), F.col("p")[F.col("k")].alias("y"))
    edges = hop.select(F.col("x.node").alias("node"), F.col("x.letter").alias("letter"),
                       F.substring(_spelt(), F.col("x.position") + 1, F.col("y.position") - F.col("x.position")).alias("label"), F.col("y.node").alias("child")).distinct()
    # at most a letter of the alphabet each
    onward = stops.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(F.when(F.col("letter") == "", " ").otherwise(F.col("letter"))), "").alias("onward"))
    return stops, materialize(spark, edges.join(onward, "child"), "spelling-edges")


def near_pairs(vocabulary: DataFrame, stops: DataFrame, edges: DataFrame) -> DataFrame:
    """``(word, near)``, both ways, of words one edit apart."""
    spark = vocabulary.sparkSession
    ends = stops.filter("letter = ''").select("node", F.col("word").alias("near"))
    at, size = F.col("position"), F.length("label")
    rest = F.substring(F.col("label"), F.lit(2), size)

    def goes_on(position):  # is the next letter, or the end, among those that follow the child?
        nxt = F.substring(F.col("w"), position + 1, F.lit(1))
        return F.instr(F.col("onward"), F.when(nxt == "", " ").otherwise(nxt)) > 0

    own = stops.withColumn("w", _spelt()).filter(at >= F.floor(F.length("word") / 2)).alias("s")
    replaced = (F.col("s.letter") != "") & (F.substring(F.col("w"), at + 2, size - 1) == rest) & goes_on(at + size)
    inserted = (F.substring(F.col("w"), at + 1, size - 1) == rest) & goes_on(at + size - 1)
    first = own.join(edges.alias("e"), "node").filter((F.col("s.letter") != F.col("e.letter")) & (replaced | inserted))
    moves = F.array_compact(F.array(F.when(replaced, at + size), F.when(inserted, at + size - 1)))
    frontier = materialize(spark, first.select("side", "word", F.col("child").alias("node"), F.explode(moves).alias("position")), "spelling-frontier")
    found = None
    while True:
        done = frontier.filter(at == F.length("word")).join(ends, "node").select("word", "near")
        found = done if found is None else found.unionByName(done)
        live = frontier.filter(at < F.length("word"))
        if not live.limit(1).count():
            break
        on = live.withColumn("w", _spelt()).withColumn("letter", F.substring(F.col("w"), at + 1, F.lit(1))).join(edges, ["node", "letter"])
        on = on.filter((F.substring(F.col("w"), at + 1, size) == F.col("label")) & goes_on(at + size))
        frontier = materialize(spark, on.select("side", "word", F.col("child").alias("node"), (at + size).alias("position")), "spelling-frontier")
    both = found.unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near")))
    return both.filter("word != near").distinct()


# ---- forms -------------------------------------------------------------------
def follow(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the last word reached from ``word`` over
    ``forms(word, form)``, by pointer doubling; chains must end."""
    spark = forms.sparkSession
    cur = forms.select("word", F.col("form").alias("root"))
    while True:
        cur = materialize(spark, cur, "spelling-roots")
        nxt = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not cur.join(nxt, "root", "left_semi").limit(1).count():
            return cur
        cur = cur.join(nxt, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def group_variants(words: DataFrame, min_length: int = 7, min_count: int = 2, factor: int = 10) -> DataFrame:
    """One row per word of ``words(word)`` (a row per occurrence) with at
    least ``min_length`` code points and ``min_count`` occurrences: ``word,
    form, root, n, n_near, form_n``.

    ``form`` is the near word with the largest count (ties: the smallest in
    code-point order) if that is ``factor`` times the word's, else null;
    ``root`` is where forms lead in the end. Null words are ignored; an
    empty table gives an empty result.
    """
    spark = words.sparkSession
    textops.bounded_batches(spark)
    vocabulary = materialize(spark, count_words(words, min_length, min_count), "spelling-words")
    pairs = near_pairs(vocabulary, *build(vocabulary))
    count = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = pairs.join(count, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    rows = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("top.near").alias("near"), (-F.col("top.less")).alias("near_n"))
    enough = F.col("near_n") >= factor * F.col("n")
    rows = materialize(spark, rows.select("word", F.when(enough, F.col("near")).alias("form"), "n", "n_near", F.when(enough, F.col("near_n")).alias("form_n")), "spelling-forms")
    roots = follow(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2,
                      factor: int = 10, slip_every: int = 31) -> DataFrame:
    """``group_variants`` of the letter runs of ``docs``, with the slips of
    ``with_slips``. Null texts have no words, a null id counts as empty;
    rows that repeat an id and text count again. Other columns are ignored."""
    return group_variants(with_slips(runs(docs, id_col, text_col, min_length), slip_every), min_length, min_count, factor)
