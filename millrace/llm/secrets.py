"""Secret scans with corpus-wide ownership frequency (operator 2), native.

Each text is searched with a few patterns. Base finds (assignments, access
keys, hex strings) always count. Further candidates - assignments with a
shorter value, and tokens with a provider's mark - count only when they look
live: how many distinct owners and repositories hold the same value over the
whole corpus tells an owner's credential from an example that is copied about.

Ownership is counted in two steps, each with map-side combine: values are first
reduced to distinct (value, owner, repository), then to counts per value, so a
value in a third of all rows is no hot group. Verdicts go back to candidates
by a look-up that broadcasts the few hot values and shuffles the rest.

Positions are running sums over the pieces between matches, in Spark's own
functions: no Python runs on executors. All positions are code points, the end exclusive.

Cases: a null text is empty; a text of any length is searched whole, and many
finds in one text cost no square of their number; a null owner or repository counts as one of its
own; repeated rows hold the same values once per owner; values that tie share
a verdict; a null ``doc_id`` passes through; an empty table gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize

_KEYWORD = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The base kinds in their order: pattern, value group, what the value's length must reach.
BASE = {
    "assign": (_KEYWORD, 2, 12),
    "access": ("AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),
}  # a run too short for its kind holds no other match, so the two last may ask for their length at once
#: Marks of published token formats.
_PROVIDER = (
    "(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
    "|glpat-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"
    "|-----BEGIN [A-Z ]*PRIVATE KEY-----)"
)
#: Candidates that need a verdict: pattern, value group, least and greatest length of the value.
MORE = {"short": (_KEYWORD, 2, 8, 11), "provider": (_PROVIDER, 0, 8, 1 << 30)}
#: A value with more distinct owners than this is a copied example.
MOST_OWNERS = 2
KINDS = [*BASE, *MORE]


def found(text: Column, pattern: str, group: int, kind: str) -> Column:
    """All matches in order: structs of start, kind's place, end, value, and kind."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # What stands before each match, and after the last; zipped, so that it is computed once.
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("m"), values.alias("v"))
    ends = running(parts, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
    none = F.array().cast("array<struct<start:int,rank:int,last:int,value:string,kind:string>>")

    def one(x: Column) -> Column:
        return F.struct(
            (x["end"] - F.length(x["p"]["m"])).alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            x["end"].alias("last"),
            x["p"]["v"].alias("value"),
            F.lit(kind).alias("kind"),
        )

    both = F.filter(F.arrays_zip(parts.alias("p"), ends.alias("end")), lambda x: x["p"]["m"].isNotNull())
    return F.when(text.rlike(pattern), F.transform(both, one)).otherwise(none)


def running(rows: Column, length: Callable[[Column], Column], block: int = 256) -> Column:
    """The running sums of the rows' lengths.

    A fold that appends to an array costs the square of its length, so blocks
    are folded apart and then moved by what stands before them.
    """
    grown = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / block).cast("int")), lambda i: i * block + 1)
    inside = F.transform(starts, lambda i: F.aggregate(F.transform(F.slice(rows, i, F.lit(block)), length), begin, grown, lambda a: a["out"]))
    moved = F.aggregate(
        inside,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.element_at(x, -1)).alias("at"), F.concat(a["out"], F.array(F.transform(x, lambda y: y + a["at"]))).alias("out")
        ),
        lambda a: a["out"],
    )
    return F.flatten(moved)


def _joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["last"])), ",")


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """A row for each document: its id, owner, repository, and the finds of each kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("\x00")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("\x00")).alias("repository"),
        text.alias("text"),
    )
    assigned = found(F.col("text"), *BASE["assign"][:2], "assign")
    rows = rows.withColumn("assigned", assigned)
    _, _, low, high = MORE["short"]
    short = F.filter("assigned", lambda x: F.length(x["value"]).between(low, high) & x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    as_short = F.transform(
        short, lambda x: x.withField("rank", F.lit(KINDS.index("short"))).withField("kind", F.lit("short"))
    )
    kinds = {"assign": F.filter("assigned", lambda x: F.length(x["value"]) >= BASE["assign"][2])}
    for k in ("access", "hex"):
        pattern, group, least = BASE[k]
        kinds[k] = _long(found(F.col("text"), pattern, group, k), least)
    provider = _long(found(F.col("text"), MORE["provider"][0], 0, "provider"), MORE["provider"][2])
    rows = rows.select(
        "doc_id",
        "owner",
        "repository",
        F.monotonically_increasing_id().alias("row"),
        *[c.alias(k) for k, c in kinds.items()],
        as_short.alias("short"),
        provider.alias("provider"),
    )
    base = F.array_sort(F.concat(*BASE))
    return rows.select("*", base.alias("base"), F.concat("short", "provider").alias("more"))


def _long(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda x: F.length(x["value"]) >= least)


def ownership(finds: DataFrame) -> DataFrame:
    """For each value (``value_hash``): its finds, distinct owners and repositories."""
    one = finds.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    two = one.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return two.groupBy("value_hash").agg(
        F.sum("n").alias("n_finds"),
        F.count(F.lit(1)).alias("owners"),
        F.sum("repositories").alias("repositories"),
    )


def scan(docs: DataFrame, *, owner: str = "source", repository: str = "source", most_owners: int = MOST_OWNERS) -> DataFrame:
    """doc_id, counts and digest of the base finds, all spans, and what ownership says of them."""
    rows = materialize(candidates(docs, owner, repository), "candidates")
    finds = rows.select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("find"))
    finds = finds.withColumn("value_hash", F.xxhash64("find.value"))
    facts = materialize(ownership(finds), "ownership")
    total = facts.agg(F.sum("n_finds")).first()[0] or 0
    met = lookup(finds, facts, "value_hash", "n_finds", F.xxhash64("row", "find.start"), total=total)
    live = F.col("owners") <= most_owners
    more = F.col("find.rank") >= len(BASE)
    judged = met.groupBy("row").agg(
        F.collect_list(F.when(more & live, F.col("find"))).alias("added"),
        F.count_if(live).alias("n_owner_specific"),
        F.count_if(~live).alias("n_copied"),
        F.max("owners").alias("most_owners"),
        F.max("repositories").alias("most_repositories"),
    )
    out = rows.join(judged, "row", "left")
    zero = F.lit(0).cast("long")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.filter("more", lambda x: F.lit(False)))))
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_owner_specific", "n_copied", "most_owners", "most_repositories")],
    )
