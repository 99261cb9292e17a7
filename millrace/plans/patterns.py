"""The text form of MATCH_RECOGNIZE, on top of :mod:`millrace.operators.match`."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match

_HEADS = ("PARTITION", "ORDER", "MEASURES", "AFTER", "PATTERN", "DEFINE", "OPTIONS")


def _sections(items: list, up: Callable) -> dict[str, list]:
    out: dict[str, list] = {}
    head = None
    for i, t in enumerate(items):
        if up(t) in _HEADS and (up(t) not in ("PARTITION", "ORDER") or up(items[i + 1]) == "BY"):
            head = up(t)
            out[head] = []
        elif not (up(t) == "BY" and head in ("PARTITION", "ORDER") and not out[head]):
            out[head].append(t)
    return out


def _flat(items: list) -> str:
    """Tokens as text, brackets included."""
    closing = {"(": ")", "[": "]", "{": "}"}
    return " ".join(t if isinstance(t, str) else f"{t.kind}{_flat(t)}{closing[t.kind]}" for t in items)


def _unqualified(text: str, symbols: set[str]) -> str:
    return re.sub(r"\b(" + "|".join(map(re.escape, symbols)) + r")\s*\.\s*", "", text)


def _define(text: str, symbols: set[str], over: str) -> str:
    text = _unqualified(text, symbols)
    text = re.sub(r"(?i)\bPREV\s*(\([^()]*\))", rf"LAG\1 OVER ({over})", text)
    return re.sub(r"(?i)\bNEXT\s*(\([^()]*\))", rf"LEAD\1 OVER ({over})", text)


def _measure(text: str, symbols: set[str]) -> str:
    """FIRST, LAST and aggregates of a symbol's rows, as aggregates over the match's rows."""
    text = re.sub(r"(?i)\bMATCH_NUMBER\s*\(\s*\)", "max(match_number)", text)
    text = re.sub(r"(?i)\bCLASSIFIER\s*\(\s*\)", "max_by(classifier, match_row_number)", text)

    def call(m: re.Match) -> str:
        name, inner = m[1].upper(), m[2].strip()
        found = re.search(r"\b(" + "|".join(map(re.escape, symbols)) + r")\s*\.", inner)
        test = f"classifier = '{found[1]}'" if found else "true"
        if name == "COUNT" and inner.endswith("*"):
            return f"count_if({test})"
        value = _unqualified(inner, symbols)
        if name in ("FIRST", "LAST"):
            return f"{'min_by' if name == 'FIRST' else 'max_by'}({value}, CASE WHEN {test} THEN match_row_number END)"
        return f"{m[1]}(CASE WHEN {test} THEN {value} END)"

    return re.sub(r"(?i)\b(FIRST|LAST|COUNT|SUM|MIN|MAX|AVG|ANY_VALUE|ARRAY_AGG)\s*\(((?:[^()]|\([^()]*\))*)\)", call, text)


def apply(spark: SparkSession, df: DataFrame, items: list, up: Callable, split: Callable, desugar: Callable) -> DataFrame:
    """Run the clause, given as tokens, over a DataFrame: one row a match."""
    s = _sections(items, up)
    pattern = _flat(list(s["PATTERN"][0]))
    symbols = {n for n in re.findall(r"[A-Za-z_]\w*", pattern)}
    keys = [_flat(k) for k in split(s.get("PARTITION", []))] if s.get("PARTITION") else []
    order = [_flat(k) for k in split(s["ORDER"])]
    over = f"{'PARTITION BY ' + ', '.join(keys) + ' ' if keys else ''}ORDER BY {', '.join(order)}"
    define = {}
    for d in split(s.get("DEFINE", [])):
        if d:
            define[d[0]] = F.expr(desugar(_define(_flat(d[2:]), symbols, over)))
    skip = " ".join(map(up, s.get("AFTER", [])))
    sort = [F.expr(re.sub(r"(?i)\s+(asc|desc)$", "", o)).desc() if re.search(r"(?i)\bdesc$", o) else F.expr(re.sub(r"(?i)\s+asc$", "", o)) for o in order]
    rows = match.match_rows(
        df, keys, sort, pattern, define,
        after="to next row" if "NEXT ROW" in skip else "past last row",
        longest="LONGEST_MATCH" in _flat(s.get("OPTIONS", [])).upper().replace(" ", "") and "TRUE" in _flat(s.get("OPTIONS", [])).upper(),
    )
    measures = []
    for m in split(s["MEASURES"]):
        measures.append(F.expr(desugar(_measure(_flat(m[:-2]), symbols))).alias(m[-1]))
    return rows.groupBy(*keys, "match_number").agg(*measures).select(*keys, *[m[-1] for m in split(s["MEASURES"])])
