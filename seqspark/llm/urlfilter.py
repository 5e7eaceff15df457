"""URL filters: host and path rules, and a Bloom filter cascade over the keys of a corpus.

A cascade answers membership exactly for every key of the universe that it was built over. Level 1 encodes the listed
keys, level 2 the unlisted keys that pass level 1, level 3 the listed keys that pass level 2, and so on until no false
positive is left. A key's answer is the parity of the first level that rejects it. Keys are dealt to shards by hash, and
each shard holds a cascade of its own, so that none is built from more keys than a task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import LOWER, UPPER, discard, stored

#: (host, path, verdict)
Rule = tuple[str, str, str]


def host_of(url: str = "url") -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, like net/, and its verdict; null if none does.

    Of rules of one length that fit, that with the longer host decides; of equal rules with both verdicts, block.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of x changes about half of the result's."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _probes(h1: np.ndarray, h2: np.ndarray, level: int, n_hashes: int, n_bits: int) -> np.ndarray:
    """Bit positions of each key, (n_hashes, n); each level has its own."""
    with np.errstate(over="ignore"):
        start = _mixed(h1 ^ _mixed(h2 + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
        step = _mixed(start) | np.uint64(1)
        return np.stack([(start + np.uint64(k) * step >> np.uint64(11)) % np.uint64(n_bits) for k in range(n_hashes)])


def _passes(h1: np.ndarray, h2: np.ndarray, level: int, n_hashes: int, bits: np.ndarray) -> np.ndarray:
    at = _probes(h1, h2, level, n_hashes, len(bits) * 8)
    return reduce(np.logical_and, (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1 for p in at)).astype(bool)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, bytes]]:
    """(number of hashes, bits) of each level. The first level's rate of false positives is set so that listed and
    unlisted keys weigh alike in the next one, the further levels' is a half."""
    levels, member = [], (h1[listed], h2[listed])
    against = (h1[~listed], h2[~listed])
    while len(member[0]):
        rate = 0.5 if levels else min(0.5, max(1e-6, len(member[0]) / (1.4 * max(1, len(against[0])))))
        n_bits = max(64, int(np.ceil(-len(member[0]) * np.log(rate) / np.log(2) ** 2 / 8)) * 8)
        n_hashes = max(1, round(-np.log2(rate)))
        on = np.zeros(n_bits, dtype=np.uint8)
        on[_probes(*member, len(levels), n_hashes, n_bits).astype(np.int64).ravel()] = 1
        bits = np.packbits(on, bitorder="little")
        through = _passes(*against, len(levels), n_hashes, bits) if len(against[0]) else np.zeros(0, bool)
        levels.append((n_hashes, bits.tobytes()))
        if len(levels) > 64:
            raise ValueError("a listed and an unlisted key share both hashes")
        member, against = (against[0][through], against[1][through]), member
    return levels


def ask_levels(levels: list[tuple[int, bytes]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first level that rejects it has an even number if so (1 is the first)."""
    answer = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    for k, (n_hashes, bits) in enumerate(levels):
        if not len(left):
            return answer
        ok = _passes(h1[left], h2[left], k, n_hashes, np.frombuffer(bits, np.uint8))
        answer[left[~ok]] = k % 2 == 1
        left = left[ok]
    answer[left] = len(levels) % 2 == 1
    return answer


def hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the key."""
    return F.xxhash64(key), F.xxhash64(F.md5(key.cast("binary")))


def shard_of(h2: Column, shards: int) -> Column:
    return F.pmod(h2, F.lit(shards)).cast("int")


CASCADE = "shard int, level int, n_hashes int, bits binary"


def build_cascade(universe: DataFrame, key: str, listed: DataFrame, keys_per_shard: int = 1 << 16, least_shards: int = 16) -> tuple[DataFrame, int]:
    """The cascade's levels and its number of shards, over all distinct values of universe[key].

    listed is a table whose first column has the listed keys, of any number; those outside the universe have no effect,
    as nobody asks for them. A null key is taken for an empty one, in both tables; an empty universe has an empty cascade.
    Keys that many rows share are made one before the shuffle, and a shard gets about keys_per_shard.
    """
    h1, h2 = hashes(F.col("key"))
    asked = universe.select(F.coalesce(F.col(key), F.lit("")).alias("key"), F.lit(True).alias("there"), F.lit(False).alias("listed"))
    named = listed.select(F.coalesce(F.col(listed.columns[0]), F.lit("")).alias("key"), F.lit(False).alias("there"), F.lit(True).alias("listed"))
    keys = asked.unionByName(named).groupBy("key").agg(F.max("there").alias("there"), F.max("listed").alias("listed")).where("there")
    keys = stored(keys.select(h1.alias("h1"), h2.alias("h2"), "listed"), "universe")
    shards = max(least_shards, -(-keys.count() // keys_per_shard))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(group.h1.to_numpy().view(np.uint64), group.h2.to_numpy().view(np.uint64), group.listed.to_numpy(bool))
        return pd.DataFrame(
            [(int(group["shard"].iat[0]), k, n, bits) for k, (n, bits) in enumerate(levels)], columns=["shard", "level", "n_hashes", "bits"]
        )

    by_shard = keys.select("h1", "h2", "listed", shard_of(F.col("h2"), shards).alias("shard")).groupBy("shard")
    cascade = stored(by_shard.applyInPandas(build, CASCADE), "cascade")
    discard(keys)
    return cascade, shards


def in_cascade(rows: DataFrame, key: str, cascade: DataFrame, shards: int, out: str = "listed", broadcast_bytes: int = 1 << 26, salts: int = 64) -> DataFrame:
    """rows with a boolean column out: whether the row's key is listed; every key must be of the universe.

    A cascade of up to broadcast_bytes is broadcast. A larger one goes to the rows: both are dealt by shard and by one of
    salts salts (so many tasks share a shard's rows), each shard's levels come first in a partition sorted so, and rows
    stream past them. A column named out is replaced.
    """
    size = cascade.agg(F.coalesce(F.sum(F.octet_length("bits") + 16), F.lit(0)).alias("n")).first()["n"]
    h1, h2 = hashes(F.coalesce(F.col(key), F.lit("")))
    if size <= broadcast_bytes:
        by_shard: dict[int, list] = {}
        for r in sorted(cascade.collect(), key=lambda r: (r["shard"], r["level"])):
            by_shard.setdefault(r["shard"], []).append((r["n_hashes"], bytes(r["bits"])))
        held = rows.sparkSession.sparkContext.broadcast(by_shard)

        @F.pandas_udf("boolean")
        def ask(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            levels = held.value
            for a, b, s in batches:
                h1, h2, shard = a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64), s.to_numpy()
                answer, order = np.zeros(len(shard), bool), np.argsort(shard, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
                    answer[part] = ask_levels(levels.get(int(shard[part[0]]), []), h1[part], h2[part])
                yield pd.Series(answer)

        return rows.withColumn(out, ask(h1, h2, shard_of(h2, shards)))
    return _in_large_cascade(rows, h1, h2, cascade, shards, out, salts)


def _in_large_cascade(rows: DataFrame, h1: Column, h2: Column, cascade: DataFrame, shards: int, out: str, salts: int) -> DataFrame:
    rows = rows.drop(out)
    kind = f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in rows.schema)}>"
    tail = "shard int, salt int, level int, n_hashes int, bits binary, h1 bigint, h2 bigint"
    asked = rows.select(
        shard_of(h2, shards).alias("shard"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"),
        F.lit(1 << 30).alias("level"), F.lit(0).alias("n_hashes"), F.lit(None).cast("binary").alias("bits"),
        h1.alias("h1"), h2.alias("h2"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
    )
    filters = cascade.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "level", "n_hashes", "bits",
        F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(None).cast(kind).alias("row"),
    )
    dealt = asked.unionByName(filters).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "level")

    def answer(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, levels = None, []
        for batch in batches:
            shard, salt, level, n, bits = (batch.column(c).to_pylist() for c in ("shard", "salt", "level", "n_hashes", "bits"))
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            said, lo = np.zeros(len(shard), bool), 0
            while lo < len(shard):
                if (shard[lo], salt[lo]) != at:
                    at, levels = (shard[lo], salt[lo]), []
                if level[lo] < 1 << 30:
                    levels.append((n[lo], bits[lo]))
                    lo += 1
                    continue
                hi = lo
                while hi < len(shard) and (shard[hi], salt[hi]) == at and level[hi] == 1 << 30:
                    hi += 1
                said[lo:hi] = ask_levels(levels, h1[lo:hi], h2[lo:hi])
                lo = hi
            asked = np.array([x == 1 << 30 for x in level], bool)
            table = pa.RecordBatch.from_arrays([batch.column("row"), pa.array(said)], ["row", out])
            yield table.filter(pa.array(asked))

    done = dealt.mapInArrow(answer, f"row {kind}, `{out}` boolean")
    return done.select(*[F.col(f"row.`{c}`") for c in rows.columns], f"`{out}`")


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, key: str = "url", broadcast_bytes: int = 1 << 26) -> DataFrame:
    """page_id, host, path, rule, verdict and listed. The longest rule decides; without one, a listed page is blocked.

    key is what the list has: whole urls (a null one is empty) or hosts, as host_of() gives them. listed is a table whose
    first column has the keys. A cascade over all keys of pages answers for each page; the tables are not joined.
    """
    rows = pages.select("page_id", host_of().alias("host"), path_of().alias("path"), F.coalesce("url", F.lit("")).alias("url"))
    cascade, shards = build_cascade(rows, key, listed)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    asked = in_cascade(rows, key, cascade, shards, "listed", broadcast_bytes)
    said = F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))
    return asked.select("page_id", "host", "path", name.alias("rule"), said.alias("verdict"), "listed")
