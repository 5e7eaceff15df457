"""What several operators of this subpackage need."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqspark.sources.shared import Bucketed, bucketed, discard, stored

__all__ = ["ASCII_SPACE", "LOWER", "UPPER", "WORD_BYTES", "Bucketed", "ascii_lower", "bucketed", "discard", "stored", "utf8", "word_chunks"]

#: The six ASCII white-space characters, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Maps bytes outside 0-9, A-Z, a-z and 0x80-0xFF to a blank, and A-Z to a-z.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def utf8(text: str = "text") -> Column:
    """The text's UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character left; lower() serves where the text is all ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_chunks(data: bytes, table: bytes | None = None, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of data in lists, from pieces of about size bytes, so that a very long text stays within bounds.

    Words are split at ASCII white space, after translation by table if one is given.
    """
    if len(data) <= size:
        yield (data.translate(table) if table else data).split()
        return
    rest = b""
    for at in range(0, len(data), size):
        piece = rest + (data[at : at + size].translate(table) if table else data[at : at + size])
        cut = max(piece.rfind(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) + 1
        rest = piece[cut:]
        yield piece[:cut].split()
    yield rest.split()
