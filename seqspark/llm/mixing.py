"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is due the same number of copies, a whole part and a fraction. Fractions are rounded in pairs:
mass is moved at random from one document to the other until one of the two is integral, such that a source's words stay
the same and no document's expectation changes. Leaves of a bounded number of documents are rounded first, each leaving
one fraction at most; these residuals are paired on the way up a tree, level by level, down to one for each source.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import stored

WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
EDGE = 1e-9


def word_count(text: str = "text") -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+, none for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def ranked(sums: DataFrame) -> DataFrame:
    """sums with rank, the place of its source by code point from 0, null last; sources are sorted into ranges, so that
    their number is not bounded by a task."""
    placed = stored(sums.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, starts, n = F.shiftright("at", 33), [], 0
    for row in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((row["part"], n))
        n += row["n"]
    start = F.broadcast(sums.sparkSession.createDataFrame(starts, "part long, start long"))
    return placed.withColumn("part", part).join(start, "part").select(*sums.columns, (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, n_docs (of a positive size), source_size and target of each source; sized has source and size.

    Sources by code point, null last, have the weights in turn and share the given part of all sizes by weight. A target
    stops at most times its source's size; the excess is reshared by weight among the others until none is above.
    """
    sums = sized.groupBy("source").agg(F.count(F.when(F.col("size") > 0, 1)).alias("n_docs"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    sources = stored(ranked(sums).select("source", "n_docs", "source_size", weight.alias("weight")), "weights")
    limit = F.col("source_size") * F.lit(float(most))
    level, before = 0.0, -1.0
    while level > before:
        full = F.col("weight") * level >= limit
        sums = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weights"),
        ).first()
        before, level = level, (share * sums["size"] - sums["full"]) / sums["weights"] if sums["weights"] > 0 else level
    return sources.select("source", "n_docs", "source_size", F.least(F.col("weight") * level, limit).alias("target"))


def pivot(copies: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> int:
    """Round copies (each from 0 to 1) in place, pair by pair; the place of the one that stays a fraction, or -1.

    A step moves words between two fractions until one is 0 or 1; which way, is drawn so that expectations stay.
    """
    held = -1
    for k in range(len(copies)):
        if not EDGE < copies[k] < 1 - EDGE:
            copies[k] = round(copies[k])
            continue
        if held < 0:
            held = k
            continue
        a, b = copies[held], copies[k]
        up = min((1 - a) * sizes[held], b * sizes[k])
        down = min(a * sizes[held], (1 - b) * sizes[k])
        move = up if draws[k] * (up + down) < down else -down
        a, b = a + move / sizes[held], b - move / sizes[k]
        copies[held], copies[k] = a, b
        whole_a, whole_b = not EDGE < a < 1 - EDGE, not EDGE < b < 1 - EDGE
        if whole_a:
            copies[held] = round(a)
            held = -1 if whole_b else k
        if whole_b:
            copies[k] = round(b)
    return held


def _round(groups: pd.DataFrame) -> pd.DataFrame:
    """Rounds a group's fractions; one may stay for the next level, unless there is none: then it is drawn too.

    Large documents come first: they are settled among themselves, and what stays a fraction is small.
    """
    rows = groups.sort_values(["size", "draw", "row"], ascending=[False, True, True], kind="stable")
    fraction, draws = rows["fraction"].to_numpy(float, copy=True), rows["draw"].to_numpy(float)
    held = pivot(fraction, rows["size"].to_numpy(float), draws)
    done = np.ones(len(rows), bool)
    if held >= 0 and rows["leaves"].iat[0] <= 1:
        fraction[held] = float(draws[held] < fraction[held])
    elif held >= 0:
        done[held] = False
    return rows.assign(fraction=fraction, done=done)


#: Rows of as many sources are broadcast at most; of more, rows and sources are dealt alike, and Spark splits a hot source.
MOST_BROADCAST = 1 << 16
#: A row is repeated in steps of so many.
CHUNK = 1024


def group_copies(
    groups: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, leaf_rows: int = 4096, fan_in: int = 16, more: tuple[str, ...] = ()
) -> DataFrame:
    """source, size, row, n, source_size, target, copies (of all n together) and the columns more, for each of groups.

    groups are of alike rows, with source, size, row and n, so that no leaf grows with repeated rows. row is a long, such
    as a hash: the draws come from it, so that reruns agree however the rows are dealt. A source's leaves hold about
    leaf_rows groups each. Rows of size 0 take nothing; theirs are the whole copies.
    """
    sources = targets(groups.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    leaves = F.greatest(F.ceil(F.col("n_docs") / leaf_rows), F.lit(1))
    known = stored(sources.select(F.col("source").alias("of"), "source_size", "target", ratio.alias("ratio"), leaves.cast("long").alias("leaves")), "ratios")
    n_sources, n_leaves = known.agg(F.count("*"), F.coalesce(F.max("leaves"), F.lit(0))).first()
    due = groups.select("source", "size", "row", "n", *more).join(F.broadcast(known) if n_sources <= MOST_BROADCAST else known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # Rows of size 0 have whole copies each; the others of a group share what is due to them together.
    all_ = F.when(F.col("size") > 0, F.col("n") * F.col("ratio")).otherwise(F.col("n") * F.floor(F.col("ratio") + EDGE))
    whole = F.floor(all_ + EDGE)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "row", "size"), 11) / F.lit(float(1 << 53))
    fraction = F.greatest(all_ - whole, F.lit(0.0))
    due = due.withColumns({"whole": whole, "fraction": fraction, "draw": draw, "leaf": F.pmod(F.xxhash64("row", "size"), F.col("leaves")), "done": (fraction <= EDGE) | (F.col("size") <= 0)})
    due = due.drop("ratio").withColumn("fraction", F.when(F.col("done"), 0.0).otherwise(F.col("fraction")))
    due = stored(due, "due")
    levels, left = [due.where("done")], due.where("NOT done")
    while n_leaves:
        rounded = stored(left.groupBy("source", "leaf").applyInPandas(_round, due.schema), "rounded")
        levels.append(rounded.where("done"))
        left = rounded.where("NOT done").withColumns({"leaf": F.floor(F.col("leaf") / fan_in), "leaves": F.ceil(F.col("leaves") / fan_in)})
        n_leaves = -(-n_leaves // fan_in) if n_leaves > 1 else 0
    out = reduce(DataFrame.unionByName, levels)
    return out.select("source", "size", "row", "n", *more, "source_size", "target", (F.col("whole") + F.round("fraction").cast("long")).alias("copies"))


def repeated(rows: DataFrame, times: Column) -> DataFrame:
    """Each row times times, in chunks that are dealt out, so that no task writes all repetitions of one row."""
    once, often = rows.where(times <= CHUNK), rows.where(times > CHUNK)
    chunks = often.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / CHUNK)))).repartition(F.xxhash64("chunk", *[F.col(f"`{c}`") for c, kind in rows.dtypes if kind == "bigint"]))
    steps = F.sequence(F.lit(1), F.least(times - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("int"))
    out = once.where(times > 0).select("*", F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("step"))
    return out.unionByName(chunks.select(*rows.columns, F.explode(steps).alias("step"))).drop("step")


def grouped(rows: DataFrame) -> DataFrame:
    """source, size, row and n, the number of rows that are alike; they are counted before the shuffle."""
    return rows.groupBy("source", "size", "row").agg(F.count("*").alias("n"))


def copies(rows: DataFrame, **how) -> DataFrame:
    """source, size, row, source_size, target and copies for each of rows, which has source, size and row (a long).

    Rows with equal source, size and row are alike; which of them gets which copies does not matter. The rows are read
    once: what is worked on further are their three columns.
    """
    rows = stored(rows.select("source", "size", "row"), "sized")
    found = stored(group_copies(stored(grouped(rows), "groups"), **how), "copies")
    each = found.withColumns({"least": F.floor(F.col("copies") / F.col("n")), "more": F.pmod("copies", "n")})
    columns = ["source", "size", "row", "source_size", "target"]
    some = repeated(each.select(*columns, (F.col("n") - F.col("more")).alias("times"), F.col("least").alias("copies")), F.col("times"))
    others = repeated(each.where("more > 0").select(*columns, F.col("more").alias("times"), (F.col("least") + 1).alias("copies")), F.col("times"))
    return some.unionByName(others).drop("times")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Sizes are words; docs has source and text.

    Rows are told apart by two hashes of all columns. Equal rows are alike: each is taken as often as all are at least,
    and one of them stands for what is left over. Rows without words are taken as often as their source's whole number
    of copies.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    row, other = F.xxhash64(*names), F.xxhash64(F.lit("other"), *names)
    sized = docs.select("source", word_count().alias("size"), row.alias("row"), other.alias("other"))
    alike = stored(sized.groupBy("source", "size", "row", "other").agg(F.count("*").alias("n")), "groups")
    found = group_copies(alike, **how, more=("other",)).where("copies > 0")
    taken = stored(found.select("row", "other", F.floor(F.col("copies") / F.col("n")).alias("times"), F.pmod("copies", "n").alias("rest")), "taken")
    held = docs.select(F.struct(*names).alias("held"), row.alias("row"), other.alias("other"))
    out = held.join(taken.where("times > 0"), ["row", "other"]).select("held", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    rest = taken.where("rest > 0")
    if rest.limit(1).count():
        one = held.join(rest, ["row", "other"]).dropDuplicates(["row", "other"]).select("held", "row", "other", F.col("rest").alias("times"))
        out = out.select("held").unionByName(repeated(one, F.col("times")).select("held"))
    return out.select(*[F.col(f"held.`{c}`") for c in docs.columns])
