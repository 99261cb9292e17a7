"""Shared helpers of the training-data operators.

Everything here keeps to three rules: inputs are read by Spark only, large
intermediates live in the shared folder the cluster names in
``spark.checkpoint.dir``, and nothing whose size follows the corpus reaches
the driver.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediates go when the session names no shared folder (tests).
DEFAULT_SHARED = "file:///tmp/checkpoints/millrace"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session may leave it unnamed: on a cluster a folder of this
    machine would be out of the executors' reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or DEFAULT_SHARED).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors: the files are
    in shared storage, not on the machine that computed them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    count: str,
    spread: Column,
    *,
    total: int,
    most_hot: int = 1000,
    least: int = 1000,
) -> DataFrame:
    """Left-join ``facts`` (unique by ``key``, a long) to ``rows`` without a hot task.

    ``count`` is the column of ``facts`` with the number of ``rows`` that bear
    the key. Keys with at least ``total / most_hot`` rows (and ``least``) are
    hot; there are at most ``most_hot`` of them whatever the size of the input,
    so they are broadcast. All others meet in a shuffle, where a settled row
    takes part under a key of its own (``spread``) that matches nothing.
    """
    names = [c for c in facts.columns if c not in (key, count)]
    floor = max(least, -(-total // most_hot))
    hot = facts.where(F.col(count) >= floor).select(F.col(key), F.struct(*names).alias("__hot"))
    cold = facts.where(F.col(count) < floor).select(
        F.col(key).alias("__key"), F.lit(0).alias("__own"), F.struct(*names).alias("__cold")
    )
    met = rows.join(F.broadcast(hot), key, "left")
    open_ = F.col("__hot").isNull() & F.col(key).isNotNull()
    met = met.withColumn("__key", F.when(open_, F.col(key)).otherwise(spread)).withColumn(
        "__own", F.when(open_, F.lit(0)).otherwise(F.lit(1))
    )
    met = met.join(cold, ["__key", "__own"], "left")
    for n in names:
        met = met.withColumn(n, F.coalesce(F.col(f"__hot.{n}"), F.col(f"__cold.{n}")))
    return met.drop("__hot", "__cold", "__key", "__own")


# --- numpy helpers for Arrow-batched operators ------------------------------

#: The multipliers and shift of a published 64-bit finaliser.
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply), on unsigned arrays."""
    x = x ^ (x >> _S)
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of two 64-bit hashes."""
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive entries.

    Runs of a power of two come from two halves; other sizes chain the powers
    of two that make them up. Costs O(n log size) vector operations.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    level, width, done, out = words, 1, 0, None
    rest = size
    while rest:
        if rest & width:
            part = level[done : done + n]
            out = part if out is None else pair_hash(out, part)
            done += width
            rest -= width
        if rest:
            level = pair_hash(level[:-width], level[width:])
            width *= 2
    return mix64(out + np.uint64(size)) if size & (size - 1) else out


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Indexes at which a run of equal neighbours begins."""
    if not len(keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


# --- CRC-32 as polynomial arithmetic over GF(2) -----------------------------

_CRC_POLY = 0xEDB88320


def _multiply(a: int, b: int) -> int:
    """a(x) * b(x) modulo the CRC polynomial, bits reflected."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_CRC_POLY if b & 1 else 0)
    return out


def _powers() -> list[int]:
    """x^(8 * 2^k) for k in 0..39."""
    p = 1 << 30
    for _ in range(3):
        p = _multiply(p, p)
    out = [p]
    for _ in range(39):
        out.append(_multiply(out[-1], out[-1]))
    return out


_POWERS = _powers()


def _multiply_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros_like(a)
    b = b.copy()
    for i in range(31, -1, -1):
        out ^= b * (a >> np.uint32(i) & np.uint32(1))
        b = b >> np.uint32(1) ^ (b & np.uint32(1)) * np.uint32(_CRC_POLY)
    return out


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a text in which ``n_bytes`` follow it.

    The CRC of a concatenation is the XOR of its parts' shifted CRCs, so an
    aggregation can put it together in any order.
    """
    out = crc.astype(np.uint32)
    left = n_bytes.astype(np.int64)
    for k, power in enumerate(_POWERS):
        if not (left >> k).any():
            break
        at = np.flatnonzero(left >> k & 1)
        if len(at):
            out[at] = _multiply_all(out[at], np.full(len(at), power, np.uint32))
    return out
