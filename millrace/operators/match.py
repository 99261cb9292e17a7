"""Row pattern matching (MATCH_RECOGNIZE).

Symbols' predicates are Spark columns (LAG and LEAD give PREV and NEXT); each
row is reduced to its order key and one bit per symbol before any Python sees
it. A partition's bits run through a prioritised NFA, and measures are plain
aggregations over the matched rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<num>\{\s*\d*\s*,?\s*\d*\s*\})|(?P<op>[()|*+?^$]))")


def parse(pattern: str):
    """A pattern as nested tuples: sym, cat, alt, rep (low, high, greedy), start, end."""
    tokens, at = [], 0
    while at < len(pattern.rstrip()):
        m = _TOKEN.match(pattern, at)
        if not m:
            raise ValueError(f"unreadable pattern at {pattern[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else (None, None)

    def alt():
        nonlocal pos
        out = [cat()]
        while peek() == ("op", "|"):
            pos += 1
            out.append(cat())
        return out[0] if len(out) == 1 else ("alt", out)

    def cat():
        out = []
        while peek()[0] and peek()[1] not in ("|", ")"):
            out.append(quantified())
        return out[0] if len(out) == 1 else ("cat", out)

    def quantified():
        nonlocal pos
        kind, text = peek()
        pos += 1
        if kind == "name":
            node = ("sym", text)
        elif text == "(":
            node = alt()
            if peek()[1] != ")":
                raise ValueError("a parenthesis isn't closed")
            pos += 1
        elif text in "^$":
            return ("start",) if text == "^" else ("end",)
        else:
            raise ValueError(f"misplaced {text!r}")
        kind, text = peek()
        if text in ("*", "+", "?") or kind == "num":
            pos += 1
            if kind == "num":
                low, comma, high = re.fullmatch(r"\{\s*(\d*)\s*(,?)\s*(\d*)\s*\}", text).groups()
                bounds = (int(low or 0), int(high) if high else None if comma else int(low))
            else:
                bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[text]
            greedy = peek() != ("op", "?")
            pos += not greedy
            node = ("rep", node, *bounds, greedy)
        return node

    node = alt()
    if pos != len(tokens):
        raise ValueError("a parenthesis isn't open")
    return node


def compile_pattern(node) -> list[tuple]:
    """Instructions: sym, split (preferred branch first), jump, start, end, match."""
    code: list[tuple] = []

    def emit(n) -> None:
        kind = n[0]
        if kind == "sym":
            code.append(n)
        elif kind in ("start", "end"):
            code.append(n)
        elif kind == "cat":
            for x in n[1]:
                emit(x)
        elif kind == "alt":
            ends = []
            for i, x in enumerate(n[1]):
                if i < len(n[1]) - 1:
                    at = len(code)
                    code.append(())
                    emit(x)
                    ends.append(len(code))
                    code.append(())
                    code[at] = ("split", at + 1, len(code))
                else:
                    emit(x)
            for e in ends:
                code[e] = ("jump", len(code))
        else:
            _, x, low, high, greedy = n
            for _ in range(low):
                emit(x)
            if high is None:
                at = len(code)
                code.append(())
                emit(x)
                code.append(("jump", at))
                code[at] = ("split", at + 1, len(code)) if greedy else ("split", len(code), at + 1)
            else:
                holes = []
                for _ in range(high - low):
                    holes.append(len(code))
                    code.append(())
                    emit(x)
                for h in holes:
                    code[h] = ("split", h + 1, len(code)) if greedy else ("split", len(code), h + 1)

    emit(node)
    code.append(("match",))
    return code


def find(code: list[tuple], bits: Sequence[int], symbols: Mapping[str, int], begin: int, longest: bool) -> list[str] | None:
    """The symbols of the preferred (or longest) match that begins at a row; None if there is none."""
    n = len(bits)

    def close(threads: list, at: int, pc: int, path, seen: set) -> None:
        stack = [(pc, path)]
        while stack:
            pc, path = stack.pop()
            if pc in seen:
                continue
            seen.add(pc)
            op = code[pc]
            if op[0] == "jump":
                stack.append((op[1], path))
            elif op[0] == "split":
                stack.append((op[2], path))
                stack.append((op[1], path))
            elif op[0] == "start":
                if at == 0:
                    stack.append((pc + 1, path))
            elif op[0] == "end":
                if at == n:
                    stack.append((pc + 1, path))
            else:
                threads.append((pc, path))

    threads: list = []
    close(threads, begin, 0, None, set())
    best, at = None, begin
    while threads:
        nxt: list = []
        seen: set = set()
        for pc, path in threads:
            op = code[pc]
            if op[0] == "match":
                best = (path, at)
                if not longest:
                    break
            elif at < n and bits[at] >> symbols[op[1]] & 1:
                close(nxt, at + 1, pc + 1, (op[1], path), seen)
        threads, at = nxt, at + 1
    if best is None:
        return None
    out, path = [], best[0]
    while path:
        out.append(path[0])
        path = path[1]
    return out[::-1]


def match_rows(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    pattern: str,
    define: Mapping[str, Column],
    *,
    after: str = "past last row",
    longest: bool = False,
) -> DataFrame:
    """The matched rows of ``df`` with match_number, match_row_number and classifier.

    ``define`` gives each symbol's predicate; a symbol without one matches any
    row. ``after`` is ``past last row`` or ``to next row``.
    """
    code = compile_pattern(parse(pattern))
    symbols = {s: i for i, s in enumerate(dict.fromkeys(op[1] for op in code if op[0] == "sym"))}
    if len(symbols) > 62:
        raise ValueError("a pattern may name 62 symbols")
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    mask = F.lit(0).cast("long")
    rows = df
    for s, i in symbols.items():
        rows = rows.withColumn(f"__is_{i}", F.coalesce(define[s], F.lit(False)) if s in define else F.lit(True))
        mask = mask + F.when(F.col(f"__is_{i}"), F.lit(1 << i)).otherwise(F.lit(0))
    rows = rows.withColumn("__rn", F.row_number().over(w)).withColumn("__bits", mask)
    rows = rows.drop(*[f"__is_{i}" for i in symbols.values()])
    past = after.lower() == "past last row"
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("match_number", T.LongType()),
            T.StructField("match_row_number", T.LongType()),
            T.StructField("classifier", T.StringType()),
        ]
    )

    def solve(t: pa.Table) -> pa.Table:
        """The matched rows of whole partitions, which begin where __rn is 1."""
        begin = np.flatnonzero(t["__rn"].to_numpy() == 1).tolist()
        bits = t["__bits"].to_pylist()
        at_rows, numbers, places, names = [], [], [], []
        for a, b in zip(begin, [*begin[1:], len(bits)], strict=True):
            part, at, number = bits[a:b], 0, 0
            while at < len(part):
                got = find(code, part, symbols, at, longest)
                if got:
                    number += 1
                    at_rows += range(a + at, a + at + len(got))
                    numbers += [number] * len(got)
                    places += range(1, len(got) + 1)
                    names += got
                at += max(1, len(got or ())) if past else 1
        out = t.drop_columns(["__rn", "__bits"]).take(pa.array(at_rows, pa.int64()))
        out = out.append_column("match_number", pa.array(numbers, pa.int64()))
        out = out.append_column("match_row_number", pa.array(places, pa.int64()))
        return out.append_column("classifier", pa.array(names, pa.string()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last partition's rows, until the next one begins
        for rb in batches:
            t = pa.Table.from_batches([rb])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not len(t):
                continue
            last = int(np.flatnonzero(t["__rn"].to_numpy() == 1)[-1])
            if last:
                yield from solve(t.slice(0, last)).to_batches()
            held = t.slice(last)
        if held is not None:
            yield from solve(held).to_batches()

    # A window's output comes partition by partition, in order: no further shuffle or sort.
    return rows.select(*df.columns, "__rn", "__bits").mapInArrow(run, schema)


def match_recognize(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], pattern: str, define: Mapping[str, Column], measures: Mapping[str, Column], **how) -> DataFrame:
    """One row per match: the partition's keys, match_number and the measures (aggregates over matched rows)."""
    rows = match_rows(df, partition_by, order_by, pattern, define, **how)
    return rows.groupBy(*partition_by, "match_number").agg(*[c.alias(n) for n, c in measures.items()])


def first(symbol: str | None, value: Column) -> Column:
    """FIRST(symbol.value) over a match."""
    at = F.col("match_row_number") if symbol is None else F.when(F.col("classifier") == symbol, F.col("match_row_number"))
    return F.min_by(value, at)


def last(symbol: str | None, value: Column) -> Column:
    """LAST(symbol.value) over a match."""
    at = F.col("match_row_number") if symbol is None else F.when(F.col("classifier") == symbol, F.col("match_row_number"))
    return F.max_by(value, at)
