"""Which paths and tools a caller may use, as predicates."""

from __future__ import annotations

from enum import IntEnum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Permission(IntEnum):
    READ, WRITE, EXECUTE = 0, 1, 2


def under(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or below one."""
    hits = [(path == r.rstrip("/")) | F.startswith(path, F.lit(r.rstrip("/") + "/")) for r in roots]
    return reduce(Column.__or__, hits, F.lit(False))


def allowed(path: Column, readable: list[str], writable: list[str], write: bool = False) -> Column:
    """Reading is allowed below all roots, writing below the writable ones that lie below no readable one alone."""
    return (under(path, writable) & ~under(path, readable)) if write else under(path, [*readable, *writable])


def may_run(calls: DataFrame, tools: DataFrame, most: Permission) -> DataFrame:
    """Calls (name, ...) of tools (name, permission) that need no more than `most`; tools that are not listed only read."""
    need = calls.join(tools.select("name", F.col("permission").alias("_need")), "name", "left")
    return need.where(F.coalesce("_need", F.lit(int(Permission.READ))) <= int(most)).drop("_need")
