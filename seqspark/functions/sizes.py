"""Byte sizes and memory limits, as columns."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The units that a size may have, and the bounds of a limit.
UNITS = {"": 0, "B": 0, "KiB": 10, "MiB": 20, "GiB": 30, "TiB": 40}
LEAST_LIMIT = 64 << 20
MAX_INT64 = (1 << 63) - 1
MAX_UINT64 = (1 << 64) - 1
_PATTERN = "^([0-9]+)(TiB|GiB|MiB|KiB|B)?\\z"


def parse_size(value: Column) -> Column:
    """Bytes of a text like 64MiB as decimal(20,0); null if it is no such text or exceeds 64 unsigned bits."""
    text = F.regexp_replace(value, "(?U)^\\s+|\\s+\\z", "")
    digits = F.regexp_replace(F.regexp_extract(text, _PATTERN, 1), "^0+(?=[0-9])", "")
    unit = F.regexp_extract(text, _PATTERN, 2)
    number = F.when(F.length(digits).between(1, 20), digits).try_cast("decimal(20,0)")
    scale = reduce(lambda rest, u: F.when(unit == u, F.lit(1 << UNITS[u])).otherwise(rest), UNITS, F.lit(1)).cast("decimal(13,0)")
    size = number * scale
    return F.when(size <= F.lit(Decimal(MAX_UINT64)), size).cast("decimal(20,0)")


def limit_problem(size: Column) -> Column:
    """Why a limit in bytes is refused: invalid (null), too_small or unlimited; null if it serves."""
    return F.when(size.isNull(), "invalid").when(size < LEAST_LIMIT, "too_small").when(size >= F.lit(MAX_INT64), "unlimited")


def managed_memory(total: Column, released: Column) -> Column:
    """What of the total is not released, never below 0."""
    return F.when(total > released, total - released).otherwise(F.lit(0))


def utilization(managed: Column, limit: Column) -> Column:
    """managed / limit; 0 where the limit is 0 or as good as none."""
    return F.when((limit <= 0) | (limit >= F.lit(MAX_INT64)), 0.0).otherwise(managed.cast("double") / limit.cast("double"))


def detected_limit(cgroup: Column, system: Column) -> tuple[Column, Column]:
    """The smaller of the usable limits and where it is from; of equal ones the first; nulls if neither is usable."""
    usable = [F.when((c > 0) & (c < F.lit(MAX_INT64)), c) for c in (cgroup, system)]
    limit = F.least(*usable)
    return limit, F.when(usable[0] == limit, "cgroup").when(usable[1] == limit, "system")


def configured_limit(config: Column, environment: Column, cgroup: Column, system: Column, ratio: Column) -> tuple[Column, Column]:
    """Limit in bytes and its source: the configured size, else the environment's, else detected; the value auto means
    ratio of what is detected, truncated. Nulls where nothing serves."""
    trim = lambda c: F.regexp_replace(c, "(?U)^\\s+|\\s+\\z", "")
    value = F.coalesce(trim(config), trim(environment), F.lit("auto"))
    named = F.when(config.isNotNull(), "configuration").when(environment.isNotNull(), "environment").otherwise("auto")
    base, found = detected_limit(cgroup, system)
    auto = F.when((ratio > 0) & (ratio < 1), F.floor(base.cast("double") * ratio).cast("decimal(20,0)"))
    limit = F.when(value == "auto", auto).otherwise(parse_size(value))
    serves = limit_problem(limit).isNull()
    return F.when(serves, limit), F.when(serves, F.when(value == "auto", found).otherwise(named))
