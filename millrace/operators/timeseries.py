"""Time windows, buckets and range sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UNITS = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}


def micros(interval: str) -> int:
    """The microseconds of an interval such as ``15 minutes``."""
    n, unit = interval.split()
    return int(n) * _UNITS[unit.lower().rstrip("s")]


def bucket_start(ts: Column, width: str, origin: str = "1950-01-01") -> Column:
    """The start of the bucket that holds a timestamp; buckets are dealt from the origin both ways."""
    w, o = F.lit(micros(width)), F.unix_micros(F.lit(origin).cast("timestamp"))
    return F.timestamp_micros(o + F.floor((F.unix_micros(ts.cast("timestamp")) - o) / w).cast("long") * w)


def tumble(df: DataFrame, ts: str, size: str, origin: str = "1970-01-01") -> DataFrame:
    """Add window_start and window_end of each row's fixed window. Works on streams too."""
    start = bucket_start(F.col(ts), size, origin)
    end = F.timestamp_micros(F.unix_micros(start) + micros(size))
    return df.drop("window_start", "window_end").select("*", start.alias("window_start"), end.alias("window_end"))


def hop(df: DataFrame, ts: str, size: str, step: str, origin: str = "1970-01-01") -> DataFrame:
    """A row for each window of ``size``, one every ``step``, that holds the row."""
    s, w = micros(step), micros(size)
    last = F.unix_micros(bucket_start(F.col(ts), step, origin))
    starts = F.filter(
        F.sequence(last - F.lit((w - 1) // s * s), last, F.lit(s)), lambda x: x > F.unix_micros(F.col(ts).cast("timestamp")) - F.lit(w)
    )
    out = df.drop("window_start", "window_end").select("*", F.explode(starts).alias("__start"))
    return out.select(
        *[c for c in out.columns if c != "__start"],
        F.timestamp_micros("__start").alias("window_start"),
        F.timestamp_micros(F.col("__start") + F.lit(w)).alias("window_end"),
    )


def range_sessionize(df: DataFrame, start: str, end: str, keys: Sequence[str], *, meets: bool = True) -> DataFrame:
    """Join ranges [start, end) of a key that overlap (or, with ``meets``, touch) into sessions.

    Adds session_start and session_end. A null bound is unbounded. A session
    begins where a range starts past every end before it.
    """
    low = F.coalesce(F.unix_micros(F.col(start).cast("timestamp")), F.lit(-(1 << 62)))
    high = F.coalesce(F.unix_micros(F.col(end).cast("timestamp")), F.lit(1 << 62))
    w = Window.partitionBy(*keys).orderBy("__low", "__high")
    before = F.max("__high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("__low") > before) if meets else (F.col("__low") >= before)
    rows = df.withColumn("__low", low).withColumn("__high", high).withColumn("__new", F.coalesce(apart, F.lit(True)).cast("int"))
    rows = rows.withColumn("__id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy(*keys, "__id")
    kind = df.schema[start].dataType
    bound = lambda c, agg, open_: F.when(agg(c).over(s) != open_, F.timestamp_micros(agg(c).over(s)).cast(kind))
    return rows.select(
        *df.columns,
        bound("__low", F.min, -(1 << 62)).alias("session_start"),
        bound("__high", F.max, 1 << 62).alias("session_end"),
    )


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, columns: Sequence[str]) -> DataFrame:
    """To each left row the latest right row of its key at or before its time.

    Both sides are put in one ordered stream per key and the last right row is
    carried forward: one shuffle, no pair of rows is built.
    """
    a = left.select(*keys, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct("*").alias("__row"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("__got"))
    b = right.select(*keys, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__row"), F.struct(*columns).alias("__got"))
    w = Window.partitionBy(*keys).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__last", F.last("__got", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__row.*", *[F.col(f"__last.{c}").alias(c) for c in columns])
