"""Distances between vectors and exact nearest-neighbour search."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nearest

#: From so many queries on, scoring a row takes several times as long as sending it elsewhere.
MANY_QUERIES = 4096


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot_product(a: Column, b: Column) -> Column:
    """The sum of products."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l1_norm(a: Column) -> Column:
    """The sum of magnitudes."""
    return _sum(F.transform(a, lambda x: F.abs(x.cast("double"))))


def l2_norm(a: Column) -> Column:
    """The Euclidean length."""
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine."""
    return 1 - dot_product(a, b) / (l2_norm(a) * l2_norm(b))


def euclidean_distance(a: Column, b: Column) -> Column:
    """The length of the difference."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def manhattan_distance(a: Column, b: Column) -> Column:
    """The sum of absolute differences."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


DISTANCES = {"COSINE": cosine_distance, "EUCLIDEAN": euclidean_distance, "MANHATTAN": manhattan_distance, "DOT_PRODUCT": lambda a, b: -dot_product(a, b)}


def vector_search(base: DataFrame, queries: DataFrame, vector: str, query_vector: str, query_id: str, *, top_k: int = 10, distance: str = "COSINE", block_bytes: int = 64 << 20) -> DataFrame:
    """The ``top_k`` base rows nearest to every query, exactly.

    Queries are broadcast in blocks whose size is checked; each task scores all
    its base rows by matrix products (``nearest``) and keeps its own best per
    query, and only those are shuffled by query. Many queries make a row so much
    work that rows are dealt evenly over the cores first.
    """
    from pyspark.sql import Window
    from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

    if distance.upper() not in DISTANCES:
        raise KeyError(distance)
    spark = base.sparkSession
    ansi = spark.conf.get("spark.sql.ansi.enabled") == "true"
    others = [c for c in base.columns if c != vector]
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("__q"))
    plain = all(d.schema[c].dataType.elementType == FloatType() for d, c in ((base, vector), (q, "__q")))
    q = q if plain else q.withColumn("__q", F.col("__q").cast("array<double>"))
    rows = base.select(*others, F.col(vector).cast("array<float>" if plain else "array<double>").alias("__v"))
    n, size = q.agg(F.count(F.lit(1)), F.sum(F.size("__q") * 8 + 16)).first()
    blocks = 1 + (size or 0) // block_bytes
    if n >= MANY_QUERIES:
        rows = rows.repartition(3 * spark.sparkContext.defaultParallelism)
    rows = rows.sortWithinPartitions(*others) if others else rows  # of equal distances, each task keeps the rows that come first
    schema = StructType([q.schema["query_id"], *(base.schema[c] for c in others), StructField("distance", DoubleType())])
    w = Window.partitionBy("query_id").orderBy("distance", *others)
    out = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        packed = spark.sparkContext.broadcast(nearest.pack(part.toArrow()))
        met = rows.mapInArrow(partial(nearest.nearest, packed=packed, kind=distance.upper(), k=max(1, top_k), ansi=ansi), schema)
        met = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
        out = met if out is None else out.unionByName(met)
    return out
