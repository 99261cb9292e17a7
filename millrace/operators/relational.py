"""Joins, set operations, star modifiers, samples and ordered limits.

Each function takes DataFrames and gives one, declared with Spark's own
operators so that Catalyst sees the whole plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.DoubleType, T.FloatType)


def equi_join(left: DataFrame, right: DataFrame, on: Mapping[str, str] | Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys by SQL's rules for floats: NaN equals nothing, not even NaN.

    Keys given as a list are merged as USING does; a mapping keeps both sides.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {k: k for k in on}
    merged = not isinstance(on, Mapping)
    a, b = left.alias("l"), right.alias("r")
    conds = []
    for x, y in pairs.items():
        cond = F.col(f"l.{x}") == F.col(f"r.{y}")
        if isinstance(left.schema[x].dataType, _FLOATS):
            cond = cond & ~F.isnan(F.col(f"l.{x}"))
        conds.append(cond)
    out = a.join(b, reduce(Column.__and__, conds), how)
    if not merged or how in ("left_semi", "left_anti"):
        return out
    keys = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in pairs]
    rest = [F.col(f"l.{c}") for c in left.columns if c not in pairs] + [F.col(f"r.{c}") for c in right.columns if c not in pairs]
    return out.select(*keys, *rest)


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """SELECT * REPLACE: all expressions see the old columns; order stays."""
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Keep the rows for which a condition over window functions is true."""
    return df.withColumn("__qualify", condition).where("__qualify").drop("__qualify")


def set_operation(left: DataFrame, right: DataFrame, op: str, *, distinct: bool, by_name: str | None = None) -> DataFrame:
    """UNION, INTERSECT or EXCEPT, by position or by name.

    ``by_name`` is strict (same names), inner (common names), left (the left's
    names) or full (all names, absent ones null).
    """
    if by_name == "strict" and set(left.columns) != set(right.columns):
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    if by_name == "inner":
        names = [c for c in left.columns if c in right.columns]
        left, right = left.select(*names), right.select(*names)
    elif by_name == "left":
        right = right.select(*[F.col(c) if c in right.columns else F.lit(None).alias(c) for c in left.columns])
    elif by_name == "full":
        names = left.columns + [c for c in right.columns if c not in left.columns]
        left, right = (d.select(*[F.col(c) if c in d.columns else F.lit(None).alias(c) for c in names]) for d in (left, right))
    elif by_name == "strict":
        right = right.select(*left.columns)
    if op == "union":
        out = left.union(right)
        return out.distinct() if distinct else out
    if op == "intersect":
        return left.intersect(right) if distinct else left.intersectAll(right)
    if op == "except":
        return left.subtract(right) if distinct else left.exceptAll(right)
    raise ValueError(op)


def unnest(df: DataFrame, arrays: Mapping[str, Column], *, offset: str | None = None, outer: bool = False, mode: str = "PAD") -> DataFrame:
    """Join each row with the elements of its arrays, side by side.

    ``mode`` settles unequal lengths: PAD with nulls, TRUNCATE to the shortest,
    STRICT to raise an error.
    """
    named = [c.alias(n) for n, c in arrays.items()]
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in arrays.values()]
    zipped = F.arrays_zip(*[F.coalesce(c, F.slice(c, 1, 0)).alias(n) for n, c in arrays.items()]) if len(named) > 1 else F.transform(
        next(iter(arrays.values())), lambda x: F.struct(x.alias(next(iter(arrays))))
    )
    if len(named) > 1 and mode == "TRUNCATE":
        zipped = F.slice(zipped, F.lit(1), F.least(*sizes))
    if len(named) > 1 and mode == "STRICT":
        zipped = F.when(F.least(*sizes) == F.greatest(*sizes), zipped).otherwise(
            F.raise_error(F.lit("arrays to unnest differ in length")).cast(df.select(zipped.alias("z")).schema["z"].dataType)
        )
    explode = F.posexplode_outer if outer else F.posexplode
    out = df.select("*", explode(zipped).alias("__offset", "__item"))
    out = out.select(*df.columns, *[F.col(f"__item.{n}").alias(n) for n in arrays], "__offset")
    return out.withColumnRenamed("__offset", offset) if offset else out.drop("__offset")


def sample_bernoulli(df: DataFrame, percent: float, *, seed: int | None = None, weight: str | None = None) -> DataFrame:
    """Keep each row with the given chance; ``weight`` names a column with its inverse."""
    out = df.sample(fraction=percent / 100, seed=seed)
    return out.withColumn(weight, F.lit(100 / percent if percent else None).cast("double")) if weight else out


def sample_rows(df: DataFrame, rows: int, *, by: Sequence[str] = (), seed: int = 0, weight: str | None = None) -> DataFrame:
    """A uniform sample of ``rows`` rows, of each group if ``by`` is given.

    Ungrouped, only each task's best rows move (a top-k); grouped, Spark's
    window-group-limit prunes each task's groups before the shuffle.
    """
    keyed = df.withColumn("__rand", F.rand(seed))
    if not by:
        out = keyed.orderBy("__rand").limit(rows)
        if weight:
            n = df.count()
            out = out.withColumn(weight, F.lit(max(1.0, n / rows) if rows else None).cast("double"))
        return out.drop("__rand")
    w = Window.partitionBy(*by).orderBy("__rand")
    out = keyed.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= rows)
    if weight:
        sizes = df.groupBy(*by).agg(F.greatest(F.lit(1.0), F.count(F.lit(1)) / rows).alias(weight))
        out = out.join(sizes, list(by))
    return out.drop("__rand", "__k")


def recursive_union(seed: DataFrame, step, *, distinct: bool = True, depth: str | None = None, most: int = 500) -> DataFrame:
    """WITH RECURSIVE: ``step`` maps the rows new in the last round to the next.

    Every round is checkpointed, so the plan stays flat and a lost executor
    costs no more than its own tasks. DISTINCT drops rows seen before, which
    ends cycles. ``depth`` names a column with the round a row first came in.
    """
    spark = seed.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file:///tmp/checkpoints/millrace")
    new = (seed.distinct() if distinct else seed).checkpoint()
    total, k = new.withColumn("__depth", F.lit(0).cast("long")), 0
    while not new.isEmpty():
        k += 1
        if k > most:
            raise RuntimeError(f"the recursion hasn't ended after {most} rounds")
        new = step(new).select(*seed.columns)
        if distinct:
            new = new.distinct()
            seen = total.select(*seed.columns)
            cond = reduce(Column.__and__, [new[c].eqNullSafe(seen[c]) for c in seed.columns])
            new = new.join(seen, cond, "left_anti")
        new = new.checkpoint()
        total = total.unionByName(new.withColumn("__depth", F.lit(k).cast("long")))
    return total.withColumnRenamed("__depth", depth) if depth else total.drop("__depth")
