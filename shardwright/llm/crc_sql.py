"""DuckDB text of an unsigned CRC-32, which that engine has no function for."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a string of ASCII and U+00C0 to U+00FF.
    Each byte is followed by seven zeros, so the fold takes a bit a step."""
    code = f"list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [195, unicode(ch) - 64] END)"
    bits = f"flatten(list_transform(flatten({code}), lambda b: [CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), {step}), 4294967295)"
