"""Aggregation beyond GROUP BY: levels, extremes, order, measures, privacy, pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_array_agg(
    value: Column, order: Column | None = None, *, descending: bool = False, limit: int | None = None, nulls: bool = True, distinct: bool = False
) -> Column:
    """ARRAY_AGG with DISTINCT, ORDER BY, LIMIT and null treatment.

    A tie in the order is broken by the value, so the result is repeatable.
    """
    one = F.struct(value.alias("v"))
    if order is None:
        rows = F.collect_set(one) if distinct else F.collect_list(one)
    else:
        rows = (F.collect_set if distinct else F.collect_list)(F.struct(order.alias("k"), value.alias("v")))
        rows = F.sort_array(rows, asc=not descending)
    if not nulls:
        rows = F.filter(rows, lambda x: x["v"].isNotNull())
    out = F.transform(rows, lambda x: x["v"])
    out = F.slice(out, 1, limit) if limit is not None else out
    return F.when(F.size(out) > 0, out)


def string_agg(value: Column, delimiter: str = ",", order: Column | None = None, **how) -> Column:
    """STRING_AGG: nulls are skipped; null for no rows."""
    return F.array_join(ordered_array_agg(value, order, nulls=False, **how), delimiter)


def having_extreme(df: DataFrame, keys: Sequence[str], by: Column, aggs: Mapping[str, Column], *, greatest: bool = True) -> DataFrame:
    """Aggregate only each group's rows at its greatest (least) ``by``: HAVING MAX / MIN.

    The extreme is found by an aggregation and joined back, so that no window
    has to hold a group.
    """
    pick = F.max if greatest else F.min
    marked = df.withColumn("__by", by)
    tops = marked.groupBy(*keys).agg(pick("__by").alias("__top"))
    if keys:
        r = tops.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__top")
        cond = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        kept = marked.join(r, cond & (F.col("__by") == F.col("__top")), "left_semi")
        out = kept.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
        # A group without any value to compare aggregates no rows.
        none = marked.where(F.lit(False)).agg(*[c.alias(n) for n, c in aggs.items()])
        return out.unionByName(tops.where(F.col("__top").isNull()).select(*keys).crossJoin(F.broadcast(none)))
    top = tops.select("__top").scalar()
    return marked.where(F.col("__by") == top).agg(*[c.alias(n) for n, c in aggs.items()])


def multi_level(df: DataFrame, outer: Sequence[str], inner: Sequence[str], inner_aggs: Mapping[str, Column], outer_aggs: Mapping[str, Column]) -> DataFrame:
    """AGG(INNER_AGG(x) GROUP BY k): reduce to (outer + inner) keys, then to the outer keys."""
    first = df.groupBy(*outer, *[k for k in inner if k not in outer]).agg(*[c.alias(n) for n, c in inner_aggs.items()])
    return first.groupBy(*outer).agg(*[c.alias(n) for n, c in outer_aggs.items()])


def measure(df: DataFrame, keys: Sequence[str], row_key: Sequence[str], needs: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Evaluate measures at their table's grain: each base row counts once a group, however often a join repeats it."""
    once = df.groupBy(*keys, *row_key).agg(*[F.any_value(c).alias(c) for c in needs if c not in (*keys, *row_key)])
    return once.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in row_key])).groupBy(*keys).agg(
        *[c.alias(n) for n, c in aggs.items()]
    )


def threshold(df: DataFrame, keys: Sequence[str], unit: str, least: int, aggs: Mapping[str, Column]) -> DataFrame:
    """Groups with at least ``least`` distinct privacy units."""
    out = df.groupBy(*keys).agg(F.count_distinct(unit).alias("__units"), *[c.alias(n) for n, c in aggs.items()])
    return out.where(F.col("__units") >= least).drop("__units")


def laplace(scale: float, seed: int) -> Column:
    """Laplace noise from one uniform draw, in Spark's own functions."""
    u = F.rand(seed) - F.lit(0.5)
    return -F.signum(u) * F.log1p(-2 * F.abs(u) + F.lit(1e-16)) * F.lit(scale)


def private_sums(
    df: DataFrame,
    keys: Sequence[str],
    unit: str,
    value: Column,
    *,
    low: float,
    high: float,
    epsilon: float,
    delta: float,
    groups_per_unit: int = 1,
    seed: int | None = None,
) -> DataFrame:
    """Differentially private COUNT and SUM by group.

    Each unit adds one clamped sum to at most ``groups_per_unit`` groups picked
    at random; groups whose noisy number of units is under the threshold that
    ``delta`` asks for are withheld. Without a ``seed``, as it should be outside
    of tests, the noise can't be foretold.
    """
    import math
    import secrets

    seed = secrets.randbits(60) if seed is None else seed
    own = df.groupBy(unit, *keys).agg(F.sum(value).alias("__v"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(unit).orderBy(F.rand(seed))
    own = own.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= groups_per_unit)
    clamped = F.greatest(F.lit(low), F.least(F.lit(high), F.col("__v").cast("double")))
    part = epsilon / 3
    least = 1 - groups_per_unit * math.log(2 * (1 - (1 - delta) ** (1 / groups_per_unit))) / part
    reach = max(abs(low), abs(high))
    sums = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("__units"), F.sum(clamped).alias("__sum"))
    noisy = sums.withColumn("__noisy", F.col("__units") + laplace(groups_per_unit / part, seed + 1))
    return noisy.where(F.col("__noisy") >= least).select(
        *keys,
        F.round(F.col("__units") + laplace(groups_per_unit / part, seed + 2)).cast("long").alias("anon_count"),
        (F.col("__sum") + laplace(groups_per_unit * reach / part, seed + 3)).alias("anon_sum"),
    )


def pivot(df: DataFrame, keys: Sequence[str], on: str, values: Mapping[str, object], aggs: Mapping[str, Column]) -> DataFrame:
    """PIVOT with given values (name -> value) and named aggregates; one pass, no discovery."""
    names = {f"{a}_{n}" if a else n: (c, v) for n, v in values.items() for a, c in aggs.items()}
    inv = {v: n for n, v in values.items()}
    rows = df.where(F.col(on).isin(list(inv))) if keys == () else df
    out = rows.groupBy(*keys).pivot(on, list(inv)).agg(*[c.alias(a or "__one") for a, c in aggs.items()])
    renamed = {}
    for v, n in inv.items():
        for a in aggs:
            old = f"{v}_{a}" if len(aggs) > 1 else str(v)
            renamed[old] = f"{a}_{n}" if a else n
    return out.withColumnsRenamed(renamed).select(*keys, *names)


def unpivot(df: DataFrame, keep: Sequence[str], columns: Mapping[str, str], *, name: str, value: str, nulls: bool = False) -> DataFrame:
    """UNPIVOT columns (column -> label) into rows; rows with a null value go unless ``nulls``."""
    pairs = F.array(*[F.struct(F.lit(label).alias(name), F.col(c).alias(value)) for c, label in columns.items()])
    out = df.select(*keep, F.explode(pairs).alias("__p")).select(*keep, f"__p.{name}", f"__p.{value}")
    return out if nulls else out.where(F.col(value).isNotNull())
