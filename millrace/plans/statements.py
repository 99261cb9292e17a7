"""Statements that Spark's parser has no form for, over the token tree.

Set operations by name, recursion that ends at a fixed point, and changes to
tables. Tables are temporary views here: a change gives the view its new state
and returns it as a DataFrame; nothing is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dml, relational

#: Primary keys of the tables that CREATE TABLE made, by name.
KEYS: dict[str, list[str]] = {}
_SET = ("UNION", "INTERSECT", "EXCEPT")


def set_by_name(spark: SparkSession, items: list, args, d) -> DataFrame | None:
    """``q [mode] OP ALL|DISTINCT BY NAME [ON (..)] | [STRICT] CORRESPONDING [BY (..)] q``; None for other text."""
    for at in range(len(items) - 1, -1, -1):  # the last operator is the outermost
        if d.up(items[at]) not in _SET:
            continue
        i = at + 1
        distinct = d.up(items[i]) == "DISTINCT" if i < len(items) else False
        i += d.up(items[i]) in ("ALL", "DISTINCT") if i < len(items) else 0
        words = [d.up(t) for t in items[i : i + 3]]
        strict = words[:1] == ["STRICT"]
        i += strict
        words = words[strict:]
        if words[:2] == ["BY", "NAME"]:
            mode, i = "strict", i + 2
        elif words[:1] == ["CORRESPONDING"]:
            mode, i = "strict" if strict else "inner", i + 1
        else:
            return None
        names = None
        if i + 1 < len(items) and d.up(items[i]) in ("ON", "BY") and isinstance(items[i + 1], d.Group):
            names, i = [t for t in items[i + 1] if t != ","], i + 2
        end = at
        for word in ("OUTER", "FULL", "LEFT", "INNER"):
            if end and d.up(items[end - 1]) == word:
                end -= 1
                mode = word.lower() if word != "OUTER" else mode
        left, right = (query(spark, q, args, d) for q in (items[:end], items[i:]))
        if names:
            left, right = (q.select(*[c for c in names if mode in ("full", "left") and c in q.columns or mode not in ("full", "left")]) for q in (left, right))
        return relational.set_operation(left, right, d.up(items[at]).lower(), distinct=distinct, by_name=mode)
    return None


def query(spark: SparkSession, items: list, args, d) -> DataFrame:
    """Run a query given as tokens."""
    while len(items) == 1 and isinstance(items[0], d.Group):
        items = list(items[0])
    return d.run_tokens(spark, list(items), args)


def recursion(spark: SparkSession, items: list, args, d) -> DataFrame | None:
    """``WITH RECURSIVE r AS (base UNION DISTINCT step) [WITH DEPTH [AS c]] query``; None for other text."""
    if [d.up(t) for t in items[:2]] != ["WITH", "RECURSIVE"] or len(items) < 5 or not isinstance(items[4], d.Group):
        return None
    name, body, rest = items[2], list(items[4]), items[5:]
    depth = None
    if [d.up(t) for t in rest[:2]] == ["WITH", "DEPTH"]:
        depth, rest = "depth", rest[2:]
        if d.up(rest[0]) == "AS":
            depth, rest = rest[1], rest[2:]
        if d.up(rest[0]) in ("BETWEEN", "MAX"):
            raise ValueError("a bound on the depth is not supported")
    at = d.find(body, "UNION")
    distinct = at >= 0 and d.up(body[at + 1]) == "DISTINCT"
    if at < 0 or not (distinct or depth):
        return None
    seed = query(spark, body[:at], args, d)

    def step(new: DataFrame) -> DataFrame:
        new.createOrReplaceTempView(name)
        return query(spark, body[at + 2 :], args, d).toDF(*seed.columns)

    out = relational.recursive_union(seed, step, distinct=distinct, depth=depth)
    out.createOrReplaceTempView(name)
    return query(spark, rest, args, d)


def change(spark: SparkSession, items: list, args, d) -> DataFrame | None:
    """CREATE TABLE, INSERT, UPDATE, DELETE and TRUNCATE; None for other text."""
    word = d.up(items[0])
    make = {"CREATE": _create, "INSERT": _insert, "UPDATE": _update, "DELETE": _delete, "TRUNCATE": _truncate}.get(word)
    return make(spark, items[1:], args, d) if make else None


def _store(name: str, df: DataFrame) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def _create(spark: SparkSession, items: list, args, d) -> DataFrame | None:
    words = [d.up(t) for t in items]
    if "TABLE" not in words[:4] or "USING" in words:
        return None
    at = words.index("TABLE") + 1
    if words[at : at + 3] == ["IF", "NOT", "EXISTS"]:
        if spark.catalog.tableExists(items[at + 3]):
            return spark.table(items[at + 3])
        at += 3
    name, rest = items[at], items[at + 1 :]
    KEYS.pop(name, None)
    if rest and d.up(rest[0]) == "AS":
        return _store(name, query(spark, rest[1:], args, d))
    columns = []
    for c in d.split_on(rest[0]):
        if [d.up(t) for t in c[:2]] == ["PRIMARY", "KEY"]:
            KEYS[name] = [t for t in c[2] if t != ","]
            continue
        end = next((i for i, t in enumerate(c) if d.up(t) in ("NOT", "PRIMARY", "DEFAULT", "OPTIONS")), len(c))
        if [d.up(t) for t in c[end : end + 2]] == ["PRIMARY", "KEY"]:
            KEYS[name] = [c[0]]
        columns.append(f"{c[0]} {d._type(c[1:end])}")
    return _store(name, spark.createDataFrame([], ", ".join(columns)))


def _insert(spark: SparkSession, items: list, args, d) -> DataFrame:
    mode, at = "error", 0
    if d.up(items[0]) == "OR":
        mode, at = d.up(items[1]).lower(), 2
    at += d.up(items[at]) == "INTO"
    name, at = items[at], at + 1
    table = spark.table(name)
    names = table.columns
    if isinstance(items[at], d.Group) and not (items[at] and d.up(items[at][0]) in ("SELECT", "FROM", "WITH")):
        names, at = [t for t in items[at] if t != ","], at + 1
    rest = items[at:]
    rows = spark.sql(f"SELECT * FROM VALUES {d.text_of(rest[1:])}", args) if d.up(rest[0]) == "VALUES" else query(spark, rest, args, d)
    if len(rows.columns) != len(names):
        raise ValueError(f"INSERT names {len(names)} columns and gives {len(rows.columns)}")
    rows = rows.toDF(*names).select(*[F.col(c).cast(table.schema[c].dataType) for c in names])
    key = KEYS.get(name)
    if not key:
        if mode != "error":
            raise ValueError(f"INSERT OR {mode.upper()} needs a primary key")
        return _store(name, table.unionByName(rows, allowMissingColumns=True).select(*table.columns))
    return _store(name, dml.insert(table, rows, key, mode=mode))


def _where(items: list, d) -> tuple[list, str]:
    at = d.find(items, "WHERE")
    if at < 0:
        raise ValueError("a WHERE clause is needed")
    return items[:at], d.text_of(items[at + 1 :])


def _update(spark: SparkSession, items: list, args, d) -> DataFrame:
    head, cond = _where(items, d)
    at = d.find(head, "SET")
    name = head[0]
    sets = {s[0]: s[s.index("=") + 1 :] for s in d.split_on(head[at + 1 :])}
    table = spark.table(name)
    alias = head[at - 1] if at > 1 else name
    unknown = set(sets) - set(table.columns)
    if unknown:
        raise ValueError(f"no column {sorted(unknown)}")
    hit = f"coalesce({cond}, false)"
    cols = [f"CASE WHEN {hit} THEN cast({d.text_of(sets[c])} as {table.schema[c].dataType.simpleString()}) ELSE {c} END AS {c}" if c in sets else c for c in table.columns]
    return _store(name, spark.sql(f"SELECT {', '.join(cols)} FROM {name} AS {alias}", args))


def _delete(spark: SparkSession, items: list, args, d) -> DataFrame:
    head, cond = _where(items[1:] if d.up(items[0]) == "FROM" else items, d)
    return _store(head[0], spark.sql(f"SELECT * FROM {head[0]} AS {head[-1]} WHERE NOT coalesce({cond}, false)", args))


def _truncate(spark: SparkSession, items: list, args, d) -> DataFrame:
    name = items[1]
    return _store(name, spark.table(name).where(F.lit(False)))
