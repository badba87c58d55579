"""Tokenizers as Arrow UDFs.

The default is a byte tokenizer: ids 0..16 are the special tokens, byte ``b``
of the UTF-8 text is ``17 + b``. A literal special string inside the text
becomes its one special id, as a tokenizer with added special tokens does.
Another encoder (for instance a ``tokenizers`` JSON file) plugs in through
the same two methods, ``encode_batch`` and ``decode_batch``; it is built once
per Python worker, never per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The special-token table of the tokenizer configuration, in
# id order (id = position). bos, eos, unk and pad are all <|endoftext|> = 0.
SPECIAL_TOKENS = [
    "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<repo_name>", "<reponame>",
    "<file_sep>", "<filename>", "<gh_stars>", "<issue_start>", "<issue_comment>",
    "<issue_closed>", "<jupyter_start>", "<jupyter_text>", "<jupyter_code>",
    "<jupyter_output>", "<jupyter_script>", "<empty_output>",
]
BOS_ID = 0
EOS_ID = 0
PAD_ID = 0
VOCAB_SIZE = 49152
BYTE_OFFSET = len(SPECIAL_TOKENS)  # 17

_SPECIAL_RE = re.compile("(" + "|".join(re.escape(s) for s in SPECIAL_TOKENS) + ")")
_SPECIAL_BYTES_RE = re.compile(_SPECIAL_RE.pattern.encode())
_SPECIAL_ID = {s: i for i, s in enumerate(SPECIAL_TOKENS)}


def special_token_map() -> Column:
    """Literal ``map<string,int>`` special token -> id."""
    return F.create_map(*[x for i, s in enumerate(SPECIAL_TOKENS) for x in (F.lit(s), F.lit(i))])


def _utf8_parts(arr: pa.Array):
    """(offsets int64[n+1], data uint8) of a string array, zero-copy."""
    arr = arr.cast(pa.large_binary())
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset: arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return offs, data


BLOCK_BYTES = 1 << 20  # text (or ids) that a tokenizer works on at a time


def _blocks(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges ``[a, b)`` of at most ``limit`` in all, or of one row;
    ``ends`` are the rows' running sizes."""
    a, n = 0, len(ends)
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


class ByteTokenizer:
    """Bytes + 17; special strings map to their ids. Stateless."""

    # a vectorised byte copy: re-running it is cheaper than writing its output
    cheap = True

    def encode_batch(self, texts: pa.Array) -> pa.Array:
        """All rows at once: bytes + 17, and every special string of the
        buffer that lies inside one row folded to its id."""
        offs, data = _utf8_parts(texts.fill_null(""))
        offs, data = offs - offs[0], data[offs[0]: offs[-1]]
        if len(data) >= 2**31:
            raise ValueError("more than 2 GiB of text in one batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
        vals = data.astype(np.int32) + BYTE_OFFSET
        found = [(m.start(), m.end(), _SPECIAL_ID[m[0].decode()]) for m in _SPECIAL_BYTES_RE.finditer(data.tobytes())]
        if found:
            start, end, sid = (np.array(x) for x in zip(*found))
            inside = np.searchsorted(offs, start, "right") == np.searchsorted(offs, end - 1, "right")
            start, end, sid = start[inside], end[inside], sid[inside]
            gone = np.zeros(len(data) + 1, np.int64)
            np.add.at(gone, start + 1, 1)
            np.add.at(gone, end, -1)
            keep = np.cumsum(gone)[:-1] == 0
            vals[start] = sid
            vals = vals[keep]
            offs = np.concatenate(([0], np.cumsum(keep)))[offs]
        return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(vals), mask=pc.is_null(texts))

    def decode_one(self, ids) -> str:
        out, run = [], bytearray()
        for t in ids:
            if t < BYTE_OFFSET:
                if run:
                    out.append(run.decode("utf-8", errors="replace"))
                    run = bytearray()
                out.append(SPECIAL_TOKENS[t])
            else:
                run.append(t - BYTE_OFFSET)
        if run:
            out.append(run.decode("utf-8", errors="replace"))
        return "".join(out)

    def decode_batch(self, ids: pa.Array, skip_special: bool = False) -> pa.Array:
        """Vectorised: ids - 17 are the UTF-8 bytes; rows holding specials
        (kept) or bytes that are not valid UTF-8 are decoded one by one."""
        n = len(ids)
        lens = np.asarray(pc.list_value_length(ids).fill_null(0), dtype=np.int64)
        vals = np.asarray(pc.list_flatten(ids), dtype=np.int32)
        special = vals < BYTE_OFFSET
        row_of = np.repeat(np.arange(n), lens)
        if skip_special and special.any():
            keep = ~special
            vals = vals[keep]
            lens = np.bincount(row_of[keep], minlength=n).astype(np.int64)
            special = np.zeros(len(vals), dtype=bool)
            row_of = np.repeat(np.arange(n), lens)
        slow = np.zeros(n, dtype=bool)
        if special.any():
            slow[np.unique(row_of[special])] = True
        offs = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(lens, out=offs[1:])
        data = np.where(special, 0, vals - BYTE_OFFSET).astype(np.uint8)
        bin_arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(data)])
        rows = None
        if not slow.any():
            try:
                out = bin_arr.cast(pa.large_string())
            except pa.ArrowInvalid:
                rows = bin_arr.to_pylist()
                out = pa.array([r.decode("utf-8", errors="replace") for r in rows], type=pa.large_string())
        else:
            rows = ids.to_pylist()
            out = pa.array([self.decode_one([t for t in r if not skip_special or t >= BYTE_OFFSET])
                            if r is not None else None for r in rows], type=pa.large_string())
        if ids.null_count:
            out = pc.if_else(pc.is_null(ids), pa.scalar(None, pa.large_string()), out)
        return out.cast(pa.string())


class JsonFileTokenizer:
    """A ``tokenizers`` JSON file, loaded lazily once per Python worker."""

    _cache: dict = {}
    # BPE costs far more than a write of its output: callers persist it
    cheap = False

    def __init__(self, path: str):
        self.path = path

    def _tok(self):
        tok = JsonFileTokenizer._cache.get(self.path)
        if tok is None:
            from tokenizers import Tokenizer
            tok = Tokenizer.from_file(self.path)
            JsonFileTokenizer._cache[self.path] = tok
        return tok

    def encode_batch(self, texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        idx = [i for i, t in enumerate(rows) if t is not None]
        enc = self._tok().encode_batch([rows[i] for i in idx], add_special_tokens=False)
        out = [None] * len(rows)
        for i, e in zip(idx, enc):
            out[i] = e.ids
        return pa.array(out, type=pa.list_(pa.int32()))

    def decode_batch(self, ids: pa.Array, skip_special: bool = False) -> pa.Array:
        tok = self._tok()
        return pa.array([None if r is None else tok.decode(r, skip_special_tokens=skip_special)
                         for r in ids.to_pylist()], type=pa.string())


DEFAULT_TOKENIZER = ByteTokenizer()


def encode(text: Column | str, tokenizer=None) -> Column:
    """Text -> ``array<int>`` with no special tokens added (F3). A batch is
    tokenized and returned in blocks: ids and work arrays take many times
    the bytes of their text, so a worker never holds those of a whole batch."""
    tok = tokenizer or DEFAULT_TOKENIZER

    @F.arrow_udf("array<int>")
    def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in batches:
            sizes = np.asarray(pc.binary_length(t).fill_null(0), dtype=np.int64)
            for a, b in _blocks(np.cumsum(sizes), BLOCK_BYTES):
                yield tok.encode_batch(t.slice(a, b - a))

    return _encode(F.col(text) if isinstance(text, str) else text)


def decode(ids: Column | str, tokenizer=None, skip_special: bool = False) -> Column:
    """``array<int>`` -> text (F7), in blocks as ``encode``."""
    tok = tokenizer or DEFAULT_TOKENIZER

    @F.arrow_udf("string")
    def _decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in batches:
            sizes = np.asarray(pc.list_value_length(t).fill_null(0), dtype=np.int64)
            for a, b in _blocks(np.cumsum(sizes), BLOCK_BYTES):
                yield tok.decode_batch(t.slice(a, b - a), skip_special)

    return _decode(F.col(ids) if isinstance(ids, str) else ids)


def to_bytes(ids: Column | str) -> Column:
    """``array<int>`` -> ``struct<ids binary, wide boolean>``, little-endian
    ids of 32 bits (wide) or, where all of a block fit, of 16; null: empty.
    Python reads and returns bytes whole, but lists of ids one by one."""

    @F.arrow_udf("struct<ids binary, wide boolean>")
    def _to_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in batches:
            sizes = np.asarray(pc.list_value_length(t).fill_null(0), dtype=np.int64)
            for a, b in _blocks(np.cumsum(sizes), BLOCK_BYTES):
                vals = np.asarray(pc.list_flatten(t.slice(a, b - a)), dtype=np.int32)
                wide = len(vals) > 0 and bool(vals.min() < 0 or vals.max() >= 1 << 16)
                data = vals.astype("<i4" if wide else "<u2")
                offs = np.concatenate(([0], np.cumsum(sizes[a:b]))) * data.itemsize
                out = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data)])
                yield pa.StructArray.from_arrays([out, pa.array(np.full(b - a, wide))], ["ids", "wide"])

    return _to_bytes(F.col(ids) if isinstance(ids, str) else ids)


def from_bytes(ids: Column | str) -> Column:
    """Little-endian 32-bit ids -> ``array<int>``."""

    @F.arrow_udf("array<int>")
    def _from_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in batches:
            sizes = np.asarray(pc.binary_length(t).fill_null(0), dtype=np.int64)
            for a, b in _blocks(np.cumsum(sizes), BLOCK_BYTES):
                offs, data = _utf8_parts(t.slice(a, b - a))
                vals = data[offs[0]: offs[-1]].copy().view("<i4")
                yield pa.ListArray.from_arrays(pa.array(((offs - offs[0]) // 4).astype(np.int32)), pa.array(vals, pa.int32()))

    return _from_bytes(F.col(ids) if isinstance(ids, str) else ids)


_NUMBERS: list[pa.Array] = []  # the numbers under 65,536 as strings, made once per worker


def _strings(vals: np.ndarray) -> pa.Array:
    if len(vals) == 0 or vals.min() < 0 or vals.max() >= 1 << 16:
        return pa.array(vals).cast(pa.string())
    if not _NUMBERS:
        _NUMBERS.append(pa.array([str(i) for i in range(1 << 16)]))
    return _NUMBERS[0].take(pa.array(vals))


def joined(ids: Column | str, sep: str = ",") -> Column:
    """``array_join`` of ids (null: null) in blocks, the numbers looked up."""

    @F.arrow_udf("string")
    def _joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in batches:
            ends = np.cumsum(np.asarray(pc.list_value_length(t).fill_null(0), dtype=np.int64))
            for a, b in _blocks(ends, BLOCK_BYTES):
                rows = t.slice(a, b - a)
                offs = (np.concatenate(([ends[a - 1] if a else 0], ends[a:b])) - (ends[a - 1] if a else 0)).astype(np.int32)
                texts = _strings(np.asarray(pc.list_flatten(rows), dtype=np.int32))
                yield pc.binary_join(pa.ListArray.from_arrays(pa.array(offs), texts, mask=pc.is_null(rows)), sep)

    return _joined(F.col(ids) if isinstance(ids, str) else ids)


def add_specials(ids: Column, add_bos: bool, add_eos: bool,
                 bos_id: int = BOS_ID, eos_id: int = EOS_ID) -> Column:
    """Prepend BOS / append EOS (F4), JVM side."""
    parts = []
    if add_bos:
        parts.append(F.array(F.lit(bos_id)))
    parts.append(ids)
    if add_eos:
        parts.append(F.array(F.lit(eos_id)))
    return F.concat(*parts) if len(parts) > 1 else ids


def piece_special_count(ids: Column, bos_id: int = BOS_ID, eos_id: int = EOS_ID) -> Column:
    """Special count of a piece as the token-shard writer counts it (F6):
    first token is BOS plus last token is EOS. With bos = eos a one-token
    piece ``[eos]`` counts two."""
    first = F.coalesce((F.get(ids, 0) == F.lit(bos_id)).cast("int"), F.lit(0))
    last = F.coalesce((F.get(ids, F.size(ids) - 1) == F.lit(eos_id)).cast("int"), F.lit(0))
    return first + last


def exact_special_count(ids: Column) -> Column:
    """Number of ids below the byte range (each one is a special token)."""
    return F.size(F.filter(ids, lambda x: x < F.lit(BYTE_OFFSET)))
