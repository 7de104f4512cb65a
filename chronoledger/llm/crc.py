"""The crc32 of a text as a DuckDB expression, for statements beside Spark's own crc32."""

from __future__ import annotations

#: Defines ``crc`` with the column ``tab``, which holds what each byte's eight steps of division leave.
TABLE = "crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) as tab)"


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of ``text``, where ``tab`` is in scope."""
    hexed = f"hex(encode({text}))"
    byte = f"cast('0x' || substr({hexed}, cast(2 * k + 1 as integer), 2) as bigint)"
    return f"xor(list_reduce(range(cast(length({hexed}) // 2 as bigint)), lambda c, k: xor(c >> 8, tab[(xor(c, {byte}) & 255) + 1]), 4294967295), 4294967295)"
