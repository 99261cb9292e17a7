"""Sources and sinks: tables by path, delimited text, JSON, Parquet, ORC, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The driver's tables.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, folder: str, names: Sequence[str] = TABLES) -> None:
    """Register Parquet tables of a folder as views; nothing is read."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table by the dialect's rule: a header line, every column STRING; no inference pass."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=False)


def read_tbl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A pipe-delimited table whose lines end in a delimiter."""
    return spark.read.csv(path, sep="|", header=False, schema=schema)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).json(path)


def read_proto(spark: SparkSession, path: str, message: str, descriptor: str) -> DataFrame:
    """Files of one binary message each, as a struct column ``value``."""
    from pyspark.sql.protobuf.functions import from_protobuf

    raw = spark.read.format("binaryFile").load(path)
    return raw.select(from_protobuf("content", message, descriptor).alias("value"))


def export_data(df: DataFrame, path: str, *, format: str = "parquet", mode: str = "error", partition_by: Sequence[str] = (), **options) -> None:
    """EXPORT DATA: write a query's result."""
    df.write.format(format).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def create_table_as(df: DataFrame, name: str, *, bucket_by: str | None = None, buckets: int = 64, mode: str = "error") -> None:
    """CREATE TABLE AS; bucketing by a join key spares later joins their shuffle."""
    w = df.write.mode(mode)
    (w.bucketBy(buckets, bucket_by).sortBy(bucket_by) if bucket_by else w).saveAsTable(name)


def single_row(spark: SparkSession) -> DataFrame:
    """The one-row relation of SELECT without FROM."""
    return spark.range(1).select(F.lit(None).alias("__none")).drop("__none")


def show(df: DataFrame, form: str = "table", most: int = 1000) -> str:
    """The first rows for display: a table or JSON lines."""
    rows = df.limit(most)
    if form == "json":
        return "\n".join(rows.toJSON().collect())
    data = [df.columns, *[["NULL" if v is None else str(v) for v in r] for r in rows.collect()]]
    width = [max(len(r[i]) for r in data) for i in range(len(df.columns))]
    line = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    body = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |" for r in data]
    return "\n".join([line, body[0], line, *body[1:], line])
