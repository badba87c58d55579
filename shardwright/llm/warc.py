"""Operator 8: WARC archives with an embedded Zstandard dictionary.

Every archive starts with a skippable frame that holds a dictionary built
from a sample of its own records; each record then is a Zstandard frame of
its own, compressed with that dictionary, so any record can be read alone.
A payload seen before is a revisit record that names the first one.

Archives are written by the tasks that hold the rows, to the shared folder,
under names no other attempt uses; the table of written archives comes from
finished tasks only, so what a lost executor left behind is never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyarrow import fs as pafs

from ..session import materialize, scratch_path
from . import sketches, textops

# Fixed values of the public formats: magic number of the dictionary's
# skippable frame, profile of identical-payload revisits.
DICT_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _line(text: str) -> str:
    """A header value without control characters (percent-encoded)."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def page_uri(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(uri: str):
    v = uri.strip("<>").rpartition(":")[2]
    return None if v == "null" else int(v)


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response record, or a revisit record when ``refers_to`` is given.
    The HTTP header states the full payload's length in both."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", page_uri(page_id)),
              ("WARC-Target-URI", _line(url or "about:blank")), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", page_uri(refers_to))]
        return _header(fields, http)
    return _header(fields, http + payload)


def train(records: list[bytes], dict_bytes: int, sample_bytes: int):
    """Dictionary from records spread over the archive, ``sample_bytes`` at
    most; plain content when there is too little to train on; None when
    there is nothing."""
    step = max(1, sum(map(len, records)) // max(sample_bytes, 1))
    sample = records[::step]
    try:
        return zstandard.train_dictionary(dict_bytes, sample)
    except zstandard.ZstdError:
        raw = b"".join(sample)[-dict_bytes:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if raw else None


def archive_bytes(records: list[bytes], dict_bytes: int = 1 << 16, sample_bytes: int = 4 << 20, level: int = 3) -> bytes:
    """A whole archive: dictionary frame, then a frame per record."""
    d = train(records, dict_bytes, sample_bytes)
    raw = d.as_bytes() if d else b""
    c = zstandard.ZstdCompressor(level=level, dict_data=d) if d else zstandard.ZstdCompressor(level=level)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(raw)), raw, *(c.compress(r) for r in records)])


def read_records(stream, chunk: int = 1 << 14):
    """Records of an archive, one decompressed frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    raw = stream.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind)) if raw else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        one, parts = d.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            rest = stream.read(chunk)
            if not rest:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Fields and payload of a record; payload None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length:")).split(":")[1])
    digest = fields["WARC-Payload-Digest"].partition(":")[2]
    if fields["WARC-Type"] == "response":
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    else:
        payload = None
    return {"page_id": _page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": _page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload}


def first_copies(pages: DataFrame, least: int = 100) -> DataFrame:
    """``pages(page_id, url, payload)`` with ``digest`` and ``refers_to``:
    the smallest page of equal payloads of ``least`` bytes or more, null for
    that page itself. Only pages whose digest may repeat are shuffled."""
    p = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("h", F.xxhash64("digest"))
    large = p.filter(F.octet_length("payload") >= least)
    groups = materialize(pages.sparkSession, large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-copies")
    bitmap = sketches.share(pages.sparkSession, sketches.key_bitmap(groups.select(F.xxhash64("digest").alias("h")), "h"))

    tagged = p.withColumn("maybe", sketches.maybe_in(bitmap)("h"))
    cols = ["page_id", "url", "payload", "digest"]
    alone = tagged.filter("NOT maybe").select(*cols, F.lit(None).cast(dict(pages.dtypes)["page_id"]).alias("refers_to"))
    rest = tagged.filter("maybe").join(groups, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least)
    rest = rest.select(*cols, F.when(revisit, F.col("first")).alias("refers_to"))
    return alone.union(rest)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100,
          date: str = "1970-01-01T00:00:00Z", most_bytes: int = 16 << 20, dict_bytes: int = 1 << 16) -> DataFrame:
    """Writes the archives to ``folder`` (any file system URI or path that
    all executors share) and returns ``(path, records, raw_bytes,
    archive_bytes)``, one row per archive.

    A record per row; null html is an empty payload; a null url is
    ``about:blank``. Of equal payloads of at least ``least`` bytes the
    smallest page id is the response (rows that repeat that id too), the
    others, null ids too, are revisits of it; smaller payloads, and equal
    ones that all lack an id, are responses. Pages carry no date: all
    records get ``date``. An empty table writes nothing. A task holds
    ``most_bytes`` of records (or one longer record) at a time.
    """
    spark = pages.sparkSession
    textops.bounded_batches(spark)
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))

    def run(batches):
        held, size = [], 0
        for b in batches:
            for page, url, payload, digest, ref in zip(*(b.column(i).to_pylist() for i in range(5))):
                r = record(page, url, payload.encode(), digest, ref, date)
                if held and size + len(r) > most_bytes:
                    yield put(held, size)
                    held, size = [], 0
                held.append(r)
                size += len(r)
        if held:
            yield put(held, size)

    def put(held, size):
        out = archive_bytes(held, dict_bytes)
        store, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        name = f"part-{uuid.uuid4().hex}.warc.zst"
        with store.open_output_stream(f"{root}/{name}", compression=None) as f:
            f.write(out)
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()),
                                           pa.array([len(out)], pa.int64())], names=["path", "records", "raw_bytes", "archive_bytes"])

    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
    rows = first_copies(base, least).select("page_id", "url", "payload", "digest", "refers_to")
    return materialize(spark, rows.mapInArrow(run, "path string, records bigint, raw_bytes bigint, archive_bytes bigint"), "warc-manifest")


def read(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the listed archives: ``page_id, url, payload_bytes,
    payload_digest, record_type, refers_to`` (and ``payload`` binary, null
    for revisits). Each response's payload is hashed again; a damaged or cut
    archive raises an error."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
                with store.open_input_stream(name, compression=None) as f:
                    held, size = [], 0
                    for raw in read_records(f):
                        held.append(parse(raw))
                        size += len(raw)
                        if size > (4 << 20):
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    n = max(1, manifest.count())
    out = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    return manifest.select("path").repartition(min(n, 4 * spark.sparkContext.defaultParallelism), F.xxhash64("path")).mapInArrow(run, out)


def archive(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Writes ``pages`` and reads them back; see ``write`` and ``read``."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    return read(spark, write(pages, folder, **how))
