"""Quality rules with a hashed n-gram likelihood ratio (operator 3), native.

Two multinomials over hashed word unigrams and bigrams are counted in one
aggregation: one of the whole raw corpus, one of its trusted documents (all
that are labelled good and not toxic). A document's score is the mean over its
n-grams of log p(target) - log p(raw); it is kept when that is at least the
threshold, one number for all, so every document is judged alike and alone.

Both counts grow with the corpus and its labels, and so does the threshold's
ground: the scores of all labelled rows that pass the rules. It lies half way
between the first percentile of the good and the 99th of the bad, or at the
first percentile of the good where the two overlap; percentiles are exact, found
by counting in ever narrower bins. Passes over texts are map-side: counting
shuffles one row per bucket and task, scoring nothing. The threshold is known
only when all labelled rows are scored: see :func:`judge`. Trusted ids are
broadcast up to ``BROADCAST_IDS``, and joined in a shuffle beyond; labels meet
the stored scores in a shuffle.

Everything is Spark expressions: no Python runs on executors.

Cases: a null text has no words and fails the rules; an empty one too; a text
of any length is judged whole; a null ``doc_id`` is judged like any other and
is in no target; labels that repeat or are null add nothing, and one that is
good but toxic neither; a document labelled good and bad is bad; without a trusted
row every ratio is 0 and the base rules alone decide; without good or bad rows
to calibrate by, ``THRESHOLD`` stands in; an empty table gives no rows. Other
columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: White space that ends a word, as fixed by the contract.
SPACES = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]"
#: The least mean log ratio where labels can't tell it.
THRESHOLD = -0.1
#: Trusted ids up to which they are broadcast.
BROADCAST_IDS = 2_000_000
#: Buckets of the hashed n-grams, and the pseudo-count that draws rare ones to ratio 1.
BUCKETS, PRIOR = 1 << 16, 10.0
#: Bins of one step of a percentile's search: what the driver gets at once.
BINS = 4096


def words_of(text: Column) -> Column:
    """The words of a text; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _zero() -> Column:
    return F.lit(0).cast("long")


def repeat_words(h: Column) -> Column:
    """How many words lie in a three-word window that the text holds twice or more.

    ``h`` has a hash for each word. Windows are sorted with their places, so
    equal ones are neighbours, and the places found are swept once.
    """
    windows = F.when(
        F.size(h) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(h) - 3),
            lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("k"), i.alias("p")),
        ),
    )
    return F.sort_array(windows)


def _covered(ranked: Column) -> Column:
    def twin(x: Column, i: Column) -> Column:
        before, after = F.get(ranked, i - 1)["k"], F.get(ranked, i + 1)["k"]
        return x["k"].eqNullSafe(before) | x["k"].eqNullSafe(after)

    places = F.sort_array(F.transform(F.filter(ranked, twin), lambda x: x["p"]))
    start = F.struct(F.lit(0).alias("done"), _zero().alias("n"))
    swept = F.aggregate(
        places,
        start,
        lambda a, p: F.struct((p + 3).alias("done"), (a["n"] + (p + 3 - F.greatest(a["done"], p))).alias("n")),
        lambda a: a["n"],
    )
    return F.coalesce(swept, _zero())


def add_rules(docs: DataFrame, prefix: str = "") -> DataFrame:
    """Add the base figures, ``base_failed`` and the word hashes ``h`` under a prefix."""
    p = prefix
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD))
    out = docs.withColumn(f"{p}words", words_of(F.col("text"))).withColumn(f"{p}lines", lines)
    out = out.withColumn(f"{p}n_words", F.size(f"{p}words").cast("long"))
    out = out.withColumn(f"{p}word_chars", F.length(F.array_join(f"{p}words", "")).cast("long"))
    out = out.withColumn(f"{p}n_symbols", F.size(F.regexp_extract_all(text, F.lit("[#*$%&|<>]"), F.lit(0))).cast("long"))
    out = out.withColumn(f"{p}n_dup_lines", (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"))
    out = out.withColumn(f"{p}h", F.transform(f"{p}words", lambda w: F.xxhash64(w))).drop(f"{p}words", f"{p}lines")
    out = out.withColumn(f"{p}ranked", repeat_words(F.col(f"{p}h")))
    out = out.withColumn(f"{p}n_repeat_words", _covered(F.col(f"{p}ranked"))).drop(f"{p}ranked")
    n, r = F.col(f"{p}n_words"), F.col(f"{p}n_repeat_words")
    return out.withColumn(f"{p}base_failed", (n < 50) | (100 * r > 50 * n))


def grams(h: Column, buckets: int) -> Column:
    """The buckets of a document's unigrams and bigrams, given its word hashes."""
    mask = F.lit(buckets - 1)
    ones = F.transform(h, lambda x: x.bitwiseAND(mask).cast("int"))
    twos = F.when(
        F.size(h) >= 2,
        F.transform(
            F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)).bitwiseAND(mask).cast("int")
        ),
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(ones, twos)


def _labelled(labels: DataFrame) -> DataFrame:
    """doc_id and ``good`` of all rows whose label says something: good and not toxic, or bad, toxic or not."""
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False)) if "toxic" in labels.columns else F.lit(False)
    good = F.when(F.col("quality") == 0, False).when(~toxic, True)
    rows = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", good.alias("good"))
    return rows.where("good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))


def fit(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """One row, one column ``llr``: the log ratio of each bucket."""
    ids = _labelled(labels).where("good").select("doc_id", F.lit(1).cast("long").alias("__trusted"))
    few = ids.count() <= BROADCAST_IDS
    rows = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", "left")
    rows = rows.select(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"), F.coalesce("__trusted", _zero()).alias("trusted"))
    counts = rows.select("trusted", F.explode(grams(F.col("h"), buckets)).alias("bucket"))
    counts = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    # One entry a bucket, in order; those that no document has stay at ratio 1.
    filled = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    whole = filled.agg(
        F.sum("raw").cast("double").alias("raw"),
        F.sum("target").cast("double").alias("target"),
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"),
    )
    due = F.col("target") / F.col("raw")
    ratio = F.transform("rows", lambda x: F.log((x["target"] + PRIOR) / (x["raw"] * due + PRIOR)))
    learned = F.transform(ratio, lambda x: F.when(F.col("target") > 0, F.coalesce(x, F.lit(0.0))).otherwise(0.0).cast("float"))
    return whole.select(learned.alias("llr"))


def add_score(docs: DataFrame, model: DataFrame, *, prefix: str = "", buckets: int = BUCKETS) -> DataFrame:
    """Add ``score``, the mean log ratio of the document's n-grams (0 if it has none)."""
    h, llr, g = (F.col(f"{prefix}{c}") for c in ("h", "llr", "grams"))
    out = docs.withColumn(f"{prefix}grams", grams(h, buckets)).drop(f"{prefix}h")
    # The model is a scalar subquery, named once, so that it is a constant where it is used.
    out = out.withColumn(f"{prefix}llr", model.select("llr").scalar())
    total = F.aggregate(g, F.lit(0.0), lambda a, i: a + F.get(llr, i))
    n = F.col(f"{prefix}n_words")
    score = F.when(n > 0, total / (2 * n - 1)).otherwise(0.0)
    return out.withColumn(f"{prefix}score", score).drop(f"{prefix}llr", f"{prefix}grams")


def percentile(values: DataFrame, share: float) -> float | None:
    """The exact percentile of the one column ``score``, between neighbours in proportion; none without values.

    Counts in bins from the least value to the greatest, then only inside the
    bin that holds the rank, until the values left are equal. The ends of a
    range never share a bin, so every step narrows it.
    """
    x = F.col("score")
    counted = (F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
    n, low, high = values.agg(*counted).first()
    if not n:
        return None
    rank, part = divmod(share * (n - 1), 1)
    before, beyond = 0, None  # values below the range, and the next one above it
    while low < high:
        place = F.least(F.floor((x - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = sorted(values.where((x >= low) & (x <= high)).groupBy(place.alias("place")).agg(*counted).collect())
        at = 0
        while before + bins[at].n <= rank:
            before += bins[at].n
            at += 1
        beyond = bins[at + 1].low if at + 1 < len(bins) else beyond
        _, n, low, high = bins[at]
    after = low if rank + 1 < before + n or beyond is None else beyond
    return low + part * (after - low)


def calibrate(scored: DataFrame, labels: DataFrame, prefix: str = "") -> float:
    """The threshold that the scores of all labelled rows give."""
    passed = scored.where(~F.col(f"{prefix}base_failed")).select("doc_id", F.col(f"{prefix}score").alias("score"))
    rows = materialize(passed.join(_labelled(labels).hint("shuffle_hash"), "doc_id").select("good", "score"), "scores")
    good, bad = percentile(rows.where("good").select("score"), 0.01), percentile(rows.where("not good").select("score"), 0.99)
    discard(rows)
    if good is None or bad is None:
        return THRESHOLD
    return (good + bad) / 2 if bad < good else good


def judge(
    docs: DataFrame,
    labels: DataFrame,
    *,
    prefix: str = "",
    threshold: float | None = None,
    buckets: int = BUCKETS,
    without: tuple[str, ...] = (),
) -> DataFrame:
    """Add all figures, ``base_failed``, ``score`` and ``kept`` to ``docs``, under a prefix.

    ``without`` names columns that the result leaves out. If the text is one, the
    figures are stored and every text is scored once. Else no text is written:
    the labelled documents are scored first, for the threshold (all documents if
    over ``BROADCAST_IDS`` are labelled, which spares a shuffle of texts).
    :func:`millrace.llm.common.discard` deletes what the result reads, when done with.
    """
    model = materialize(fit(docs, labels, buckets=buckets), "ratios")
    out = add_score(add_rules(docs, prefix), model, prefix=prefix, buckets=buckets).drop(*without)
    path = model.stored_at
    if "text" in without:
        out = materialize(out, "figures")
        discard(model)
        path = out.stored_at
        if threshold is None:
            threshold = calibrate(out, labels, prefix)
    elif threshold is None:
        rows, ids = docs.select("doc_id", "text"), _labelled(labels).select("doc_id")
        if ids.count() <= BROADCAST_IDS:
            rows = rows.join(F.broadcast(ids), "doc_id", "left_semi")
        rows = add_score(add_rules(rows), model, buckets=buckets).select("doc_id", "base_failed", "score")
        rows = materialize(rows, "figures")
        threshold = calibrate(rows, labels)
        discard(rows)
    # Not deterministic to the optimizer, which else moves a filter on it, and with it all
    # of the above, below the columns that hold each step's result.
    here = F.monotonically_increasing_id() >= 0
    kept = ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}score") >= threshold) & here
    out = out.withColumn(f"{prefix}kept", kept)
    out.stored_at = path
    return out
