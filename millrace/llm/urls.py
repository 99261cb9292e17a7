"""URL filters by a temporal list join (operator 5), native.

A list is a log of dated entries: from ``effective`` on, ``rule`` (a domain,
or a domain and path prefix) has ``action`` - block, allow, or drop, which ends
the rule. Entries of a rule become validity intervals [effective, next entry),
kept in order as the rule's history.

A capture takes part with the suffixes of its host and the prefixes of its
path, as many of each as the list's deepest rule has. Each meets a history at
most once, whatever the number of its entries, and the entry active at fetch
time is found in it by bisection (as-of). The most specific rule decides: the
longest host suffix, then the longest path; on a tie block wins.

Histories are cut into stretches of ``STRETCH`` entries, so no row grows with a
rule's. The list is broadcast when its measured size is under
``broadcast_bytes``; beyond that it is joined in a shuffle, in which Spark
splits hot rules. Verdicts are reduced to one per capture with map-side
combine. No Python runs on executors.

Cases: a null or hostless URL, or a null fetch time, is kept without a rule; a
URL of any length costs what it takes to split it, and no more keys than the
list is deep; entries with a null rule, action or date are no entries; entries
of a rule at one instant count as one, block before allow before drop; repeated
captures, and captures without an id, stay as they are; an empty list keeps
all; an empty table gives no rows. Other columns of the captures, whatever
their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ACTIONS = ("block", "allow", "drop")
#: Entries of a rule that one row holds.
STRETCH = 1024


def host_of(url: Column) -> Column:
    """The lower-cased host without user, port or trailing dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::\d*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    """The path, from its slash on, without query or fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column, deepest: int, longest: int) -> Column:
    """The rules that could cover the URL, of at most ``deepest`` labels and ``longest`` path steps."""
    labels = F.split(host_of(url), r"\.")
    labels = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - deepest + 1), F.lit(deepest))
    hosts = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.lit(deepest)), "."))
    steps = F.slice(F.array_remove(F.split(path_of(url), "/"), ""), 1, max(1, longest))
    paths = F.transform(steps, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i + 1), "/")))
    paths = F.concat(F.array(F.lit("")), paths) if longest else F.array(F.lit(""))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def rule_of(rule: Column) -> Column:
    """A rule as the keys are written: the host in lower case, the path as it is without empty steps."""
    host = F.substring_index(rule, "/", 1)
    steps = F.array_remove(F.split(F.substr(rule, F.length(host) + 1), "/"), "")
    return F.array_join(F.concat(F.array(F.lower(host)), steps), "/")


def intervals(entries: DataFrame) -> DataFrame:
    """rule, action, since, until (null: still valid) of the dated ``entries``."""
    rank = F.array_position(F.array(*map(F.lit, _ACTIONS)), F.col("action"))
    rows = entries.where("rule is not null and effective is not null").where(F.col("action").isin(*_ACTIONS))
    rows = rows.select(rule_of(F.col("rule")).alias("rule"), F.col("effective").alias("since"), rank.alias("rank"))
    rows = rows.groupBy("rule", "since").agg(F.min("rank").alias("rank"))
    until = F.lead("since").over(Window.partitionBy("rule").orderBy("since"))
    rows = rows.withColumn("until", until).where(F.col("rank") < len(_ACTIONS))
    return rows.select("rule", F.element_at(F.array(*map(F.lit, _ACTIONS)), F.col("rank").cast("int")).alias("action"), "since", "until")


def histories(valid: DataFrame) -> DataFrame:
    """rule, from, to (null: no end) and ``history``, the intervals in order, a row for each stretch of a rule."""
    ordered = valid.withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy("since")) - 1)
    rows = ordered.groupBy("rule", F.expr(f"k div {STRETCH}").alias("stretch")).agg(
        F.min("since").alias("from"),
        F.max(F.struct("since", "until"))["until"].alias("to"),
        F.sort_array(F.collect_list(F.struct("since", "until", "action"))).alias("history"),
    )
    return rows.drop("stretch")


def active(history: Column, at: Column) -> Column:
    """The interval of a history that holds ``at``, by bisection; null if none does."""
    ends = F.struct(F.lit(0).alias("low"), F.size(history).alias("high"))  # the last with since <= at is in [low, high)

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        before = F.get(history, middle)["since"] <= at
        return F.struct(
            F.when(before, middle).otherwise(a["low"]).alias("low"), F.when(before, a["high"]).otherwise(middle).alias("high")
        )

    times = F.array(*[F.lit(i) for i in range(STRETCH.bit_length())])
    last = F.aggregate(times, ends, halve, lambda a: F.get(history, a["low"]))
    return F.when((last["since"] <= at) & (last["until"].isNull() | (at < last["until"])), last)


def judge(captures: DataFrame, entries: DataFrame, *, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """capture_id, url, fetched, action, rule and kept of every capture (capture_id, url, fetched)."""
    valid = intervals(entries)
    host, steps = F.substring_index("rule", "/", 1), F.size(F.split("rule", "/")) - 1
    size, deepest, longest = valid.agg(F.sum(F.length("rule") + 64), F.max(F.size(F.split(host, r"\."))), F.max(steps)).first()
    past = histories(valid)
    past = F.broadcast(past) if (size or 0) <= broadcast_bytes else past
    rows = captures.select("capture_id", "url", "fetched").withColumn("row", F.monotonically_increasing_id())
    keys = F.explode_outer(keys_of(F.col("url"), deepest or 1, longest or 0)).alias("rule")
    keys = rows.select("row", "capture_id", "url", "fetched", keys)
    when = (F.col("fetched") >= F.col("from")) & (F.col("to").isNull() | (F.col("fetched") < F.col("to")))
    met = keys.join(past.withColumnRenamed("rule", "key"), (F.col("rule") == F.col("key")) & when, "left")
    met = met.withColumn("entry", active(F.col("history"), F.col("fetched")))
    found = F.when(
        F.col("entry").isNotNull(),
        F.struct(
            F.length(host).alias("host"),
            F.length("rule").alias("length"),
            (F.col("entry.action") == "block").alias("blocks"),
            F.col("rule").alias("rule"),
            F.col("entry.action").alias("action"),
        ),
    )
    best = met.groupBy("row", "capture_id", "url", "fetched").agg(F.max(found).alias("best"))
    return best.select(
        "capture_id",
        "url",
        "fetched",
        F.col("best.action").alias("action"),
        F.col("best.rule").alias("rule"),
        (~F.coalesce(F.col("best.blocks"), F.lit(False))).alias("kept"),
    )
