"""Raw records -> documents ``(id, text, media, metadata, dataset_name)``.

``metadata`` is ``map<string,string>``: the record's own ``metadata`` (a
JSON object is opened, anything else is kept under the key ``metadata``),
then every column not used for id, text or media, the record winning on a
key clash. Non-string values are stored as JSON text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_COLUMNS = ["id", "text", "media", "metadata", "dataset_name"]


def _as_text(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, T.StringType):
        return F.col(c)
    if isinstance(dt, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(F.col(c))
    return F.col(c).cast("string")


def wrap_metadata(meta: Column) -> Column:
    """A JSON object string opens into a map, anything else (broken JSON
    too) becomes ``{"metadata": value}``; null gives an empty map."""
    is_obj = F.ltrim(meta).startswith("{") & F.try_parse_json(meta).isNotNull()
    return (F.when(meta.isNull(), F.create_map().cast("map<string,string>"))
             .when(is_obj, F.from_json(meta, "map<string,string>"))
             .otherwise(F.create_map(F.lit("metadata"), meta)))


def merge_metadata(meta: Column, data: Column) -> Column:
    """``meta | data``: keys of ``data`` win; null values of ``data``
    count as absent keys."""
    # one-element transforms bind the filtered map and its keys, so each is
    # computed once a row and not once a key
    def merged(d):
        keys = F.array(F.map_keys(d))
        return F.get(F.transform(keys, lambda ks: F.map_concat(F.map_filter(meta, lambda k, v: ~F.array_contains(ks, k)), d)), 0)

    return F.get(F.transform(F.array(F.map_filter(data, lambda k, v: v.isNotNull())), merged), 0)


def data_map(df: DataFrame, cols: Sequence[str]) -> Column:
    """The columns as a ``map<string,string>`` (null values kept)."""
    if not cols:
        return F.create_map().cast("map<string,string>")
    return F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[_as_text(df, c) for c in cols]))


def adapt(df: DataFrame, dataset_name: str | None = None, text_key: str = "text", id_key: str = "id",
          default_id: Column | None = None, media_key: str = "media", metadata_key: str = "metadata",
          text: Column | None = None, keep: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """The document form of raw records. ``default_id`` (P4) stands
    for ``path/position`` when the record has no (or an empty) id. Columns of
    ``keep`` stay beside it; those of ``drop`` are no metadata."""
    cols = df.columns
    used = {text_key, id_key, media_key, metadata_key, *drop}
    rest = [c for c in cols if c not in used]
    raw_id = F.nullif(_as_text(df, id_key), F.lit("")) if id_key in cols else F.lit(None).cast("string")
    doc_id = F.coalesce(raw_id, default_id) if default_id is not None else raw_id
    if metadata_key in cols:
        m = df.schema[metadata_key].dataType
        meta = F.col(metadata_key) if isinstance(m, T.MapType) else wrap_metadata(_as_text(df, metadata_key))
    else:
        meta = F.create_map().cast("map<string,string>")
    media = F.coalesce(F.col(media_key).cast("array<string>"), F.array().cast("array<string>")) \
        if media_key in cols else F.array().cast("array<string>")
    return df.select(doc_id.alias("id"), (text if text is not None else F.col(text_key)).cast("string").alias("text"),
                     media.alias("media"), merge_metadata(meta, data_map(df, rest)).alias("metadata"),
                     F.lit(dataset_name).cast("string").alias("dataset_name"), *keep)


def metadata_string(meta: Column | str) -> Column:
    """Map as ``k=v;...`` in key order (for reports and comparisons)."""
    m = F.col(meta) if isinstance(meta, str) else meta
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                    lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
