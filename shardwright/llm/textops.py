"""Vectorised byte-level text helpers shared by the operators of this package.

An Arrow string column is one byte buffer plus offsets. The helpers cut it
into blocks of bounded bytes (a longer text is a block of its own) and find
words, hash them and hash word n-grams with whole-array numpy steps.

Hashes are 64 bits: a polynomial over a random byte table modulo 2**64,
finished by a multiply-xorshift mixer. Two different words or n-grams share
a hash with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19  # numpy's temporaries are about 100 bytes for each
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_TABLE = np.random.default_rng(20240501).integers(0, 1 << 64, size=256, dtype=np.uint64)
_POW = np.ones(1, np.uint64)
_INVPOW = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0..n."""
    global _POW, _INVPOW
    if len(_POW) <= n:
        with np.errstate(over="ignore"):
            one = np.ones(1, np.uint64)
            _POW = np.concatenate((one, np.full(n, _MULT, np.uint64))).cumprod(dtype=np.uint64)
            _INVPOW = np.concatenate((one, np.full(n, _INV, np.uint64))).cumprod(dtype=np.uint64)
    return _POW, _INVPOW


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing mixer of a 64-bit hash (a bijection)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def byte_class(spec: str) -> np.ndarray:
    """``[256]`` of the bytes that make up words, 0 outside; a word is a run
    of one value. ``nonspace``: all but space and 0x09-0x0D. ``alnum``:
    ASCII letters, digits and every byte of a non-ASCII character.
    ``tokens``: runs of those and, as words of their own, runs of any other
    bytes but white space and controls."""
    b = np.arange(256)
    if spec == "tokens":
        return np.where(byte_class("alnum"), 1, np.where(b > 32, 2, 0)).astype(np.uint8)
    if spec == "nonspace":
        return ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    if spec == "alnum":
        return ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    raise ValueError(f"unknown byte class {spec}")


def ascii_fold() -> np.ndarray:
    """``uint8[256]`` that lower-cases A-Z."""
    b = np.arange(256, dtype=np.uint8)
    b[65:91] += 32
    return b


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets int64[n+1], bytes uint8)`` of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return offs, data


def bounded_batches(spark) -> None:
    """Arrow batches of at most 8 MB or 2,000 rows, unless the session says
    otherwise: a batch of long texts is held by the JVM and by Python."""
    for name, value in (("maxBytesPerBatch", 8 << 20), ("maxRecordsPerBatch", 2000)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def blocks(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[a, b)`` of at most ``limit`` bytes (or one row)."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums ``uint64[n+1]`` from which ``span_hash`` reads any span."""
    power, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``[start, end)`` for each pair, equal for equal bytes."""
    _, inverse = _powers(len(prefix) - 1)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray, in_word: np.ndarray, fold: np.ndarray | None = None):
    """Words of a block: ``(doc, start, end, hash)``, in text order. ``offs``
    starts at 0. A word never crosses a text's end."""
    n = len(data)
    if fold is not None:
        data = fold[data]
    w = in_word[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    edge = np.ones(n + 1, bool)
    edge[1:n] = w[1:] != w[:-1]
    edge |= first
    at = np.flatnonzero(edge)[:-1] if n else np.zeros(0, np.int64)
    nxt = np.append(at[1:], n)
    keep = w[at] > 0 if n else np.zeros(0, bool)
    start, end = at[keep], nxt[keep]
    doc = np.searchsorted(offs, start, "right") - 1
    return doc, start, end, span_hash(prefix_hash(data), start, end) if n else np.zeros(0, np.uint64)


def ngrams(doc: np.ndarray, word: np.ndarray, n: int, n_docs: int, whole_short: bool = True):
    """Word n-gram hashes ``(doc, position, hash)`` in text order. With
    ``whole_short`` a text of 1..n-1 words gives one gram, its whole word
    sequence."""
    m = len(word)
    count = np.bincount(doc, minlength=n_docs)
    if m >= n:
        at = np.flatnonzero(doc[:m - n + 1] == doc[n - 1:])
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * _U(_MULT) + word[at + k]
    else:
        at, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.concatenate(([0], np.cumsum(count)[:-1])) if n_docs else np.zeros(0, np.int64)
    d, pos, h = doc[at], at - start[doc[at]], mix(h)
    if whole_short:
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for i, s in enumerate(short):
                x = int(count[s])
                for v in word[start[s]:start[s] + count[s]]:
                    x = (x * _MULT + int(v)) & 0xFFFFFFFFFFFFFFFF
                extra[i] = x
            d, pos, h = np.concatenate((d, short)), np.concatenate((pos, np.zeros(len(short), np.int64))), np.concatenate((h, mix(extra)))
            o = np.argsort(d, kind="stable")
            d, pos, h = d[o], pos[o], h[o]
    return d, pos, h


def sorted_sets(doc: np.ndarray, value: np.ndarray, n_docs: int):
    """Per-text sorted distinct values: ``(offsets int64[n_docs+1], values)``."""
    value = value.copy()
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            value[a:b].sort()
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        doc, value = doc[new], value[new]
    return np.searchsorted(doc, np.arange(n_docs + 1)), value


def lists(offs: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values, kind))


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed bigint."""
    return h.view(np.int64)
