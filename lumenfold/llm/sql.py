"""Pieces of SQL that several queries' texts share."""

from __future__ import annotations

#: A table, crc, of one row: t is what the reflected polynomial makes of every byte.
CRC_TABLE = "crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) bytes(i))"


def crc32(text: str) -> str:
    """crc32 (unsigned) of the UTF-8 bytes of a text, where crc is joined."""
    octets = f"list_transform(range(length(hex(encode({text}))) // 2), lambda k: ('0x' || substr(hex(encode({text})), (2 * k + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c // 256, crc.t[(xor(c, b) % 256 + 1)::INT]), 4294967295::BIGINT), 4294967295::BIGINT)"
