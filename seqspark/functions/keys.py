"""Keys: the slot of a key, which keys are valid, and the integers that requests carry as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The number of slots, and the most bytes (and characters) of a key.
SLOT_COUNT = 16384
MAX_KEY = 256


def slot_for_key(key: Column) -> Column:
    """CRC-32 (IEEE) of the key's UTF-8 bytes modulo the number of slots; the empty key has slot 0, a null one none."""
    return (F.crc32(key.cast("binary")) % SLOT_COUNT).cast("int")


def key_problem(key: Column) -> Column:
    """Why a key is refused: null, empty, too_long (in characters, or in bytes) or blank; null for a valid key.

    Blank means white space only in Unicode's sense, no-break and ideographic spaces included.
    """
    return (
        F.when(key.isNull(), "null")
        .when(key == "", "empty")
        .when((F.char_length(key) > MAX_KEY) | (F.octet_length(key) > MAX_KEY), "too_long")
        .when(~key.rlike("(?U)\\S"), "blank")
    )


def or_default(value: Column, default: str) -> Column:
    """The value without white space around it; the default if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(value, "(?U)^\\s+|\\s+\\z", ""), F.lit("")), F.lit(default))


def parse_int64(text: Column) -> Column:
    """A base-10 integer with an optional sign and nothing around it; null for anything else and beyond 64 bits."""
    return F.when(text.rlike("^[+-]?[0-9]+\\z"), text).try_cast("bigint")
