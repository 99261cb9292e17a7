"""Changes to tables as DataFrame programs: each gives the table's new state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame, key: Sequence[str], *, mode: str = "error") -> DataFrame:
    """INSERT: on a key that is there, ``error``, ``ignore``, ``replace`` or ``update`` (given columns only)."""
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns]) if mode != "update" else rows
    if mode == "ignore":
        return table.unionByName(rows.join(table, list(key), "left_anti"))
    if mode == "replace":
        return table.join(rows, list(key), "left_anti").unionByName(rows)
    if mode == "update":
        given = [c for c in rows.columns if c not in key]
        r = rows.select(*[F.col(c).alias(f"__{c}") for c in rows.columns], F.lit(True).alias("__hit"))
        cond = reduce(Column.__and__, [F.col(k) == F.col(f"__{k}") for k in key])
        met = table.join(r, cond, "full")
        return met.select(*[
            F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in key else F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
            for c in table.columns
        ])
    both = table.unionByName(rows)
    twice = both.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*key)
    if not twice.isEmpty():
        raise ValueError("a row with this key is there already")
    return both


def update(table: DataFrame, where: Column, new: Mapping[str, Column]) -> DataFrame:
    """UPDATE: all expressions see the old values."""
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    """DELETE: rows for which the condition is true go."""
    return table.where(~F.coalesce(where, F.lit(False)))


def merge(table: DataFrame, source: DataFrame, key: Sequence[str], *, matched: Mapping[str, Column] | None = None, delete_when: Column | None = None, not_matched: bool = True, not_by_source_delete: bool = False) -> DataFrame:
    """MERGE on a key: update or delete what matches, insert what doesn't; expressions see t.* and s.*."""
    twice = source.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*key)
    if not table.select(*key).join(twice, list(key), "left_semi").isEmpty():
        raise ValueError("a row of the table is matched by several rows of the source")
    t, s = table.withColumn("__t", F.lit(True)).alias("t"), source.withColumn("__s", F.lit(True)).alias("s")
    cond = reduce(Column.__and__, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in key])
    met = t.join(s, cond, "full")
    both = F.col("__t").isNotNull() & F.col("__s").isNotNull()
    only_source = F.col("__t").isNull()
    keep = F.lit(True)
    if delete_when is not None:
        keep = keep & ~(both & F.coalesce(delete_when, F.lit(False)))
    if not not_matched:
        keep = keep & ~only_source
    if not_by_source_delete:
        keep = keep & F.col("__s").isNotNull()
    cols = []
    for c in table.columns:
        old = F.col(f"t.{c}")
        new = F.when(both, (matched or {}).get(c, old)).otherwise(old)
        got = F.col(f"s.{c}") if c in source.columns else F.lit(None).cast(table.schema[c].dataType)
        cols.append(F.when(only_source, got).otherwise(new).alias(c))
    return met.where(keep).select(*cols)
