"""Sharding by histogram sort: splitters are found by counting bytes below probes, then rows are exchanged once.

The sort key is (hash of the text, hash of doc_id), so that equal texts are neighbours. Each round counts, over all
partitions, the exact bytes below equally spaced probes inside the interval that each open splitter lies in, and narrows
the interval to a gap between two probes, until the bytes below a probe meet the splitter's target within the tolerance.
A group of equal texts is split only where it alone is too large for that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import stored

WORD = 64
MOST_PROBES = 1 << 18


@dataclass
class Open:
    """A splitter whose place is known to be inside a prefix of the key's 128 bits."""

    target: int
    prefix: int = 0
    below: int = 0


def byte_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def sort_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.xxhash64(doc_id)


def _high_bits(k1: Column, k2: Column, bits: int) -> list[Column]:
    """The key's first bits as columns in order: signed prefixes of one word or two."""
    if bits <= WORD:
        return [F.shiftright(k1, WORD - bits) if bits else F.lit(0).cast("long")]
    return [k1, F.shiftright(k2, 2 * WORD - bits)]


def _joined(row, bits: int) -> int:
    """The columns of _high_bits() as one unsigned number in the key's order."""
    if bits <= WORD:
        return row[0] + (1 << bits - 1) if bits else 0
    low = bits - WORD
    return (row[0] + (1 << WORD - 1) << low) + row[1] + (1 << low - 1)


def _parted(prefix: int, bits: int) -> tuple[int, ...]:
    """The inverse of _joined()."""
    if bits <= WORD:
        return (prefix - (1 << bits - 1) if bits else 0,)
    low = bits - WORD
    return (prefix >> low) - (1 << WORD - 1), (prefix & (1 << low) - 1) - (1 << low - 1)


def find_splitters(keys: DataFrame, parts: int, total: int, tolerance: float) -> list[int]:
    """parts - 1 boundaries, as 128-bit keys in order: those below belong to the parts before. keys has k1, k2, size.

    Up to MOST_PROBES counts, or two for each splitter if that is more, come to the driver at once. A boundary is off its target by up to tolerance of a part,
    or by the size of one row (or of rows with equal keys) if that is larger.
    """
    allowed = tolerance * total / parts
    done: dict[int, int] = {}
    waiting = {i: Open(total * i // parts) for i in range(1, parts)}
    bits, k1, k2 = 0, F.col("k1"), F.col("k2")
    while waiting and bits < 2 * WORD:
        active = sorted({s.prefix for s in waiting.values()})
        more = max(1, min(8, (MOST_PROBES // len(active)).bit_length() - 1))
        more = min(more, (WORD if bits < WORD else 2 * WORD) - bits)
        inside = keys
        if bits:
            names = [f"p{i}" for i in range(len(_parted(0, bits)))]
            chosen = keys.sparkSession.createDataFrame([_parted(p, bits) for p in active], ", ".join(f"{n} long" for n in names))
            prefixed = keys.select("k1", "k2", "size", *[c.alias(n) for c, n in zip(_high_bits(k1, k2, bits), names, strict=True)])
            inside = prefixed.join(F.broadcast(chosen), names, "left_semi")
        counts = inside.groupBy(*[c.alias(f"q{i}") for i, c in enumerate(_high_bits(k1, k2, bits + more))]).agg(F.sum("size").alias("bytes"))
        found: dict[int, list[tuple[int, int]]] = {}
        for row in counts.collect():
            probe = _joined(row, bits + more)
            found.setdefault(probe >> more, []).append((probe, row["bytes"]))
        for i, s in list(waiting.items()):
            below = s.below
            for probe, size in sorted(found.get(s.prefix, [])):
                if abs(below - s.target) <= allowed:
                    done[i] = probe << 2 * WORD - bits - more
                    break
                if below + size > s.target + allowed:
                    s.prefix, s.below = probe, below
                    if bits + more == 2 * WORD:
                        after = s.target - below > below + size - s.target
                        done[i] = probe + after
                    break
                below += size
            else:
                done[i] = s.prefix + 1 << 2 * WORD - bits
            if i in done:
                del waiting[i]
        bits += more
    return [done[i] for i in range(1, parts)]


def part_of(splitters: list[int], k1: Column, k2: Column) -> Column:
    """The number of splitters that are not above the key."""
    top = (1 << 2 * WORD) - 1
    high = np.array([(min(s, top) >> WORD) - (1 << WORD - 1) for s in splitters], dtype=np.int64)
    low = np.array([(min(s, top) & (1 << WORD) - 1) - (1 << WORD - 1) for s in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def place(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.to_numpy(), b.to_numpy()
        first, last = np.searchsorted(high, a, "left"), np.searchsorted(high, a, "right")
        out = last.copy()
        for i in np.flatnonzero(last > first):
            out[i] = first[i] + np.searchsorted(low[first[i] : last[i]], b[i], "right")
        return pd.Series(out.astype(np.int32))

    return place(k1, k2)


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, size: Column | None = None, key: tuple[Column, Column] | None = None, part_bytes: int = 1 << 28, tolerance: float = 0.01
) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (from 0, without gaps): every row in one shard, sizes near equal.

    size is a row's size in bytes, by default those of its UTF-8 text plus 1; key is the sort key, two long columns, by
    default hashes of text and doc_id. A shard is made of parts of about
    part_bytes, 4 at least, each a range of keys; a part is sorted by one task, however many parts there are. Columns
    named shard and slot are replaced. Nulls, empty texts and repeated rows have keys like others; equal rows get slots in any order. An empty
    table stays empty.
    """
    size = byte_size() if size is None else size
    rows = docs.drop("shard", "slot")
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    k1, k2 = key or sort_key()
    keyed = rows.select(row, k1.alias("k1"), k2.alias("k2"), size.alias("size"))
    keys = stored(keyed.select("k1", "k2", "size"), "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    per_shard = max(4, -(-total // (shards * part_bytes)))
    splitters = find_splitters(keys, shards * per_shard, total, tolerance)
    part = part_of(splitters, F.col("k1"), F.col("k2"))
    counts = {r["part"]: r["n"] for r in keys.select(part.alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for p in range(shards * per_shard):
        before = 0 if p % per_shard == 0 else before
        starts.append((p, p // per_shard, before))
        before += counts.get(p, 0)
    places = F.broadcast(docs.sparkSession.createDataFrame(starts, "part int, shard int, start long"))
    dealt = keyed.select("row", "k1", "k2", part.alias("part")).withColumn(
        "nth", F.expr("row_number() OVER (PARTITION BY part ORDER BY k1, k2)") - 1
    )
    out = dealt.join(places, "part")
    return out.select(*[F.col(f"row.`{c}`") for c in rows.columns], "shard", (F.col("start") + F.col("nth")).alias("slot"))
