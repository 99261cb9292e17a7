"""The SQL dialect's front end: text in, DataFrame out.

Spark parses nearly all of the dialect. ``desugar`` rewrites the rest - calls
from the catalogue, type names, array literals and subscripts, UNNEST,
QUALIFY, SAFE calls, ordered ARRAY_AGG and STRING_AGG, date arithmetic - to
text that Catalyst plans as usual. ``run`` also takes the pipe operators Spark
has no syntax for, one DataFrame step each.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import expand
from ..functions.python import register
from . import patterns, statements

_LEX = re.compile(
    r"(?P<space>\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/)"
    r"|(?P<string>[rRbB]{0,2}(?:'''.*?'''|\"\"\".*?\"\"\"|'(?:\\.|''|[^'\\])*'|\"(?:\\.|[^\"\\])*\"))"
    r"|(?P<name>`[^`]*`|[A-Za-z_][A-Za-z0-9_]*)"
    r"|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|0[xX][0-9a-fA-F]+)"
    r"|(?P<param>@@?\w+|\?)"
    r"|(?P<op>\|>|\|\||<=>|->|=>|<=|>=|<>|!=|<<|>>|::|[-+*/%=<>(),.;\[\]{}:&|^~!])",
    re.S,
)
TYPES = {"INT64": "BIGINT", "INT32": "INT", "UINT32": "BIGINT", "UINT64": "DECIMAL(20,0)", "FLOAT64": "DOUBLE", "FLOAT32": "FLOAT", "BYTES": "BINARY", "NUMERIC": "DECIMAL(38,9)", "BIGNUMERIC": "DECIMAL(38,18)", "BOOL": "BOOLEAN", "DATETIME": "TIMESTAMP_NTZ", "JSON": "STRING"}
_CLAUSES = {"SELECT", "FROM", "WHERE", "GROUP", "HAVING", "QUALIFY", "WINDOW", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT"}
_WORDS = _CLAUSES | {"AND", "OR", "NOT", "IN", "ON", "AS", "BY", "CASE", "WHEN", "THEN", "ELSE", "END", "JOIN", "CROSS", "LEFT", "RIGHT", "FULL", "INNER", "OUTER", "BETWEEN", "IS", "NULL", "LIKE", "WITH", "OFFSET", "USING", "DISTINCT", "ALL", "ASC", "DESC", "RETURN", "EXTEND", "SET", "VALUES", "IF"}
_PARTS = {"DAY": ("day", 1), "WEEK": ("day", 7), "MONTH": ("month", 1), "QUARTER": ("month", 3), "YEAR": ("month", 12)}
_NEST = {"(": ")", "[": "]", "{": "}"}
_ids = count()


class Group(list):
    """A bracketed run of tokens; ``kind`` is its opening bracket."""

    def __init__(self, kind: str, items=()) -> None:
        super().__init__(items)
        self.kind = kind


def tokens(text: str) -> Group:
    """The token tree of a text: strings, and Groups for brackets."""
    root = Group("")
    stack, at = [root], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"unreadable SQL at {text[at : at + 30]!r}")
        at = m.end()
        t = m[0]
        if m.lastgroup == "space":
            continue
        if t in _NEST:
            g = Group(t)
            stack[-1].append(g)
            stack.append(g)
        elif t in ")]}":
            if len(stack) == 1 or _NEST[stack[-1].kind] != t:
                raise ValueError("brackets don't match")
            stack.pop()
        else:
            stack[-1].append(t)
    if len(stack) > 1:
        raise ValueError("a bracket isn't closed")
    return root


def up(t) -> str:
    """A word in upper case; empty for a group."""
    return t.upper() if isinstance(t, str) else ""


def is_name(t) -> bool:
    """Whether a token is an identifier that isn't a keyword."""
    return isinstance(t, str) and bool(re.match(r"[A-Za-z_`]", t)) and up(t) not in _WORDS and not is_string(t)


def is_string(t) -> bool:
    """Whether a token is a string literal."""
    return isinstance(t, str) and bool(re.match(r"[rRbB]{0,2}['\"]", t))


def split_on(items: list, sep: str = ",") -> list[list]:
    """Split a level at a separator."""
    out: list[list] = [[]]
    for t in items:
        if t == sep:
            out.append([])
        else:
            out[-1].append(t)
    return out


def find(items: list, *words: str, start: int = 0) -> int:
    """Where the words stand in a row at this level; -1 if nowhere."""
    for i in range(start, len(items) - len(words) + 1):
        if all(up(items[i + k]) == w for k, w in enumerate(words)):
            return i
    return -1


def text_of(items: list) -> str:
    """Desugared text of a level."""
    return " ".join(_render(rewrite(items)))


def _render(items: list) -> list[str]:
    out: list[str] = []
    for t in items:
        if isinstance(t, Group):
            inner = text_of(t)
            if t.kind == "[":
                out.append(f"array({inner})")
            else:
                s = f"{t.kind}{inner}{_NEST[t.kind]}"
                if out and out[-1] and (re.fullmatch(r"[\w`.]+", out[-1]) and out[-1].upper() not in _WORDS):
                    out[-1] += s
                else:
                    out.append(s)
        elif t == "." and out:
            out[-1] += "."
        elif out and out[-1].endswith(".") and not out[-1].endswith(".."):
            out[-1] += t
        else:
            out.append(t)
    return out


def rewrite(items: list) -> list:
    """One level of the token tree with the dialect's own forms replaced."""
    return _expressions(_unnest(_qualify(_star_replace(_windows(list(items))))))


def _star_replace(items: list) -> list:
    """SELECT * [EXCEPT (..)] REPLACE (e AS c): the pipe operator SET puts the value in the column's place."""
    at = find(items, "REPLACE")
    begin = find(items, "SELECT")
    if at < 0 or begin < 0 or begin + 1 >= len(items) or items[begin + 1] != "*" or at > begin + 4 or not isinstance(items[at + 1], Group):
        return items
    end = next((i for i in range(at + 2, len(items)) if up(items[i]) in ("ORDER", "LIMIT", "UNION", "INTERSECT") or items[i] == "|>"), len(items))
    sets: list = []
    for e in split_on(items[at + 1]):
        sets += [*([","] if sets else []), e[-1], "=", Group("(", e[:-2])]
    inner = Group("(", ["SELECT", "*", *items[at + 2 : end], "|>", "SET", *sets])
    return [*items[:at], "FROM", inner, *items[end:]]


def _windows(items: list) -> list:
    """Put the definition of a named window where a call extends it: OVER (w ...)."""
    at = find(items, "WINDOW")
    if at < 0:
        return items
    known, i = {}, at + 1
    while i + 2 < len(items) and up(items[i + 1]) == "AS" and isinstance(items[i + 2], Group):
        body = list(items[i + 2])
        if body and up(body[0]) in known:
            body = known[up(body[0])] + body[1:]
        known[up(items[i])] = body
        items[i + 2] = Group("(", body)
        i += 4 if i + 3 < len(items) and items[i + 3] == "," else 3

    def fill(t):
        if not isinstance(t, Group):
            return t
        return Group(t.kind, known[up(t[0])] + t[1:] if len(t) > 1 and up(t[0]) in known else map(fill, t))

    return [fill(t) if i < at else t for i, t in enumerate(items)]


def _qualify(items: list) -> list:
    at = find(items, "QUALIFY")
    if at < 0:
        return items
    begin = max(i for i in range(at) if up(items[i]) == "SELECT")
    frm = find(items, "FROM", start=begin)
    end = next((i for i in range(at + 1, len(items)) if up(items[i]) in ("WINDOW", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT") or items[i] in ("|>", ";")), len(items))
    inner = Group("(", [*items[begin:frm], ",", Group("(", items[at + 1 : end]), "AS", "__qualify", *items[frm:at]])
    return [*items[:begin], "SELECT", "*", "EXCEPT", Group("(", ["__qualify"]), "FROM", inner, "WHERE", "__qualify", *items[end:]]


def _unnest(items: list) -> list:
    """UNNEST in a FROM clause, and IN UNNEST."""
    out: list = []
    i = 0
    while i < len(items):
        t = items[i]
        if up(t) == "UNNEST" and i + 1 < len(items) and isinstance(items[i + 1], Group):
            if len(out) > 2 and up(out[-1]) in ("ANY", "SOME", "ALL") and up(out[-2]) == "LIKE":
                every = up(out.pop()) == "ALL"
                out.pop()
                negated = up(out[-1]) == "NOT"
                if negated:
                    out.pop()
                left = [out.pop()]
                while out and (out[-1] == "." or (isinstance(left[0], Group) and is_name(out[-1])) or left[0] == "."):
                    left.insert(0, out.pop())
                test = [*left, *(["NOT"] if negated else []), "LIKE", "__p"]
                out += ["forall" if every else "exists", Group("(", [*items[i + 1], ",", "__p", "->", *test])]
                i += 2
                continue
            if out and up(out[-1]) == "IN":
                out.pop()
                negated = bool(out) and up(out[-1]) == "NOT"
                if negated:
                    out.pop()
                left = [out.pop()]
                while out and (out[-1] == "." or (isinstance(left[0], Group) and is_name(out[-1])) or left[0] == "."):
                    left.insert(0, out.pop())
                call = ["array_contains", Group("(", [*items[i + 1], ",", *left])]
                out += ["NOT", *call] if negated else call
                i += 2
                continue
            args, i = split_on(items[i + 1]), i + 2
            mode = next((up(text_of(x[2:])).strip("'\"") for x in args if len(x) > 2 and up(x[0]) == "MODE" and x[1] == "=>"), "PAD")
            args = [x for x in args if not (len(x) > 2 and up(x[0]) == "MODE" and x[1] == "=>")]
            if i < len(items) and up(items[i]) == "AS":
                i += 1
            alias = items[i] if i < len(items) and is_name(items[i]) else f"__u{next(_ids)}"
            i += 1 if i < len(items) and items[i] == alias else 0
            offset = None
            if i + 1 < len(items) and up(items[i]) == "WITH" and up(items[i + 1]) == "OFFSET":
                offset, i = "offset", i + 2
                if i < len(items) and up(items[i]) == "AS":
                    offset, i = items[i + 1], i + 2
                elif i < len(items) and is_name(items[i]):
                    offset, i = items[i], i + 1
            if len(args) > 1:
                out += [*(["LATERAL"] if out and up(out[-1]) != "FROM" else []), *_side_by_side(args, mode, offset, alias)]
                continue
            lateral = bool(out) and up(out[-1]) != "FROM"
            names = [offset, alias] if offset else [alias]
            call = Group("(", args[0])
            out += (["LATERAL"] if lateral else []) + ["posexplode" if offset else "explode", call, "AS", f"__t{next(_ids)}"]
            out.append(Group("(", [x for k, n in enumerate(names) for x in ([","] if k else []) + [n]]))
            continue
        out.append(t)
        i += 1
    return out


def _side_by_side(args: list[list], mode: str, offset: str | None, alias: str) -> list:
    """UNNEST of several arrays: one row for each place; ``mode`` settles unequal lengths."""
    names, arrays = [], []
    for k, x in enumerate(args):
        named = len(x) > 2 and up(x[-2]) == "AS"
        names.append(x[-1] if named else f"__u{next(_ids)}")
        arrays.append(text_of(x[:-2] if named else x))
    sizes = ", ".join(f"coalesce(size({a}), 0)" for a in arrays)
    if mode not in ("PAD", "TRUNCATE", "STRICT"):
        raise ValueError(f"UNNEST has no mode {mode}")
    n = f"least({sizes})" if mode == "TRUNCATE" else f"greatest({sizes})"
    if mode == "STRICT":
        n = f"case when least({sizes}) = {n} then {n} else cast(raise_error('arrays to unnest differ in length') as int) end"
    fields = ", ".join([*[f"'{c}', get({a}, __i)" for c, a in zip(names, arrays, strict=True)], *([f"'{offset}', __i"] if offset else [])])
    rows = f"transform(slice(sequence(0, {n}), 1, {n}), __i -> named_struct({fields}))"
    return [_raw(f"inline({rows})"), "AS", alias, Group("(", [t for c in [*names, *([offset] if offset else [])] for t in (",", c)][1:])]


def _expressions(items: list) -> list:
    out: list = []
    i = 0
    while i < len(items):
        t = items[i]
        nxt = items[i + 1] if i + 1 < len(items) else None
        if up(t) in ("SAFE", "NET", "HLL_COUNT", "KLL_QUANTILES") and nxt == "." and i + 3 < len(items) and isinstance(items[i + 3], Group):
            name, args = items[i + 2], items[i + 3]
            if up(t) == "SAFE":
                out.append(_raw(_safe(name, args)))
            else:
                got = expand(f"{t}.{name}", [text_of(a) for a in split_on(args)])
                out.append(_raw(got or f"{name}({text_of(args)})"))
            i += 4
        elif up(t) == "WITH" and isinstance(nxt, Group) and nxt.kind == "(":
            out.append(_raw(f"({_with_expression(nxt)})"))
            i += 2
        elif is_name(t) and isinstance(nxt, Group) and nxt.kind == "(" and i + 3 < len(items) and up(items[i + 2]) == "OVER" and (got := _over(up(t), nxt, items[i + 3])):
            out.append(_raw(got))
            i += 4
        elif is_name(t) and isinstance(nxt, Group) and nxt.kind == "(" and not (out and out[-1] == "."):
            out.append(_raw(_call(t, nxt)))
            i += 2
        elif up(t) == "OVER" and isinstance(nxt, Group):
            out += [t, nxt]
            i += 2
        elif up(t) in ("IF", "LEFT", "RIGHT") and isinstance(nxt, Group) and nxt.kind == "(":
            out.append(_raw(f"{t}({text_of(nxt)})"))
            i += 2
        elif isinstance(t, Group) and t.kind == "[" and out and _operand(out[-1]):
            base = [out.pop()]
            while out and (out[-1] == "." or base[0] == "."):
                base.insert(0, out.pop())
            shown = [b if isinstance(b, str) else f"array({text_of(b)})" if b.kind == "[" else f"({text_of(b)})" for b in base]
            out.append(_raw(_subscript("".join(shown), t)))
            i += 1
        elif up(t) in TYPES and not (out and out[-1] == ".") and not (nxt == "."):
            if up(t) == "DATETIME" and is_string(nxt):
                out.append("TIMESTAMP_NTZ")
            elif up(t) in ("NUMERIC", "BIGNUMERIC") and is_string(nxt):
                out.append(_raw(f"CAST({nxt} AS {TYPES[up(t)]})"))
                i += 1
            elif up(t) == "JSON" and is_string(nxt):
                pass
            else:
                out.append(TYPES[up(t)])
            i += 1
        elif isinstance(t, str) and re.match(r"[rR]?[bB][rR]?['\"]", t):
            out.append(_raw(f"CAST({re.sub('^[bB]|(?<=^[rR])[bB]', '', t)} AS BINARY)"))
            i += 1
        elif isinstance(t, str) and t.startswith("@"):
            out.append(":" + t.lstrip("@"))
            i += 1
        else:
            out.append(t)
            i += 1
    return out


def _with_expression(g: Group) -> str:
    """WITH(a AS e, ..., result): each name stands for its expression in what follows."""
    *named, result = split_on(g)
    known: dict[str, Group] = {}

    def put(items: list) -> list:
        out: list = []
        for t in items:
            if isinstance(t, Group):
                out.append(Group(t.kind, put(list(t))))
            else:
                out.append(known[up(t)] if up(t) in known and not (out and out[-1] == ".") else t)
        return out

    for n in named:
        known[up(n[0])] = Group("(", put(n[2:]))
    return text_of(put(result))


def _over(name: str, g: Group, window) -> str | None:
    """Calls over windows that Spark has under other names, or not at all."""
    inside = text_of(window) if isinstance(window, Group) else ""
    spec = f"({inside})" if isinstance(window, Group) else str(window)
    if name in ("IS_FIRST", "IS_LAST"):
        k = text_of(g)
        if name == "IS_FIRST":
            return f"(row_number() OVER {spec} <= {k})"
        if not isinstance(window, Group):
            return None
        at = find(list(window), "ORDER", "BY")
        whole = text_of(window[:at] if at >= 0 else window)
        return f"(count(1) OVER ({whole}) - row_number() OVER {spec} < {k})"
    if name in ("PERCENTILE_CONT", "PERCENTILE_DISC"):
        x, p = split_on(g)
        return f"{name.lower()}({text_of(p)}) WITHIN GROUP (ORDER BY {text_of(x)}) OVER {spec}"
    if g and up(g[0]) == "DISTINCT" and name in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
        x = text_of(g[1:])
        values = f"collect_set({x}) OVER {spec}"
        if name in ("MIN", "MAX"):
            return f"{name.lower()}({x}) OVER {spec}"
        total = f"aggregate({values}, get({values}, 0) * 0L, (__a, __v) -> __a + __v)"
        return {"COUNT": f"cast(size({values}) as bigint)", "SUM": total, "AVG": f"({total} / nullif(size({values}), 0))"}[name]
    return None


class _raw(str):
    """Text that is desugared already."""


def _operand(t) -> bool:
    return isinstance(t, _raw) or isinstance(t, Group) or is_name(t) or (isinstance(t, str) and t.startswith(":"))


def _subscript(base: str, g: Group) -> str:
    kind = up(g[0]) if g else ""
    if kind in ("OFFSET", "ORDINAL", "SAFE_OFFSET", "SAFE_ORDINAL") and len(g) == 2:
        i = text_of(g[1])
        return {
            "OFFSET": f"element_at({base}, cast({i} as int) + 1)",
            "ORDINAL": f"element_at({base}, cast({i} as int))",
            "SAFE_OFFSET": f"get({base}, cast({i} as int))",
            "SAFE_ORDINAL": f"get({base}, cast({i} as int) - 1)",
        }[kind]
    return f"{base}[{text_of(g)}]"


def _interval(arg: list) -> tuple[str, str] | None:
    return (text_of(arg[1:-1]), up(arg[-1])) if arg and up(arg[0]) == "INTERVAL" and len(arg) >= 3 else None


def _week(part: list) -> tuple[str, int | None]:
    """A date part and, for weeks, the day they begin with (0 Sunday)."""
    days = ["SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY"]
    p = up(part[0])
    if p == "ISOWEEK":
        return "WEEK", 1
    if p == "WEEK":
        return "WEEK", days.index(up(part[1][0])) if len(part) > 1 else 0
    return p, None


def _trunc(x: str, part: list, time: bool) -> str:
    p, first = _week(part)
    if first is not None:
        whole = f"date_add(cast({x} as date), -pmod(dayofweek({x}) - 1 - {first}, 7))"
        return f"cast({whole} as timestamp)" if time else whole
    if p == "ISOYEAR":
        return f"date_trunc('WEEK', make_date(extract(yearofweek from {x}), 1, 4))" if time else f"cast(date_trunc('WEEK', make_date(extract(yearofweek from {x}), 1, 4)) as date)"
    return f"date_trunc('{p}', {x})" if time else f"trunc({x}, '{p}')" if p != "DAY" else f"cast({x} as date)"


#: Format elements that Java's patterns spell alike for every value.
_JAVA = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "I": "hh", "p": "a"}


def _java_pattern(token) -> str | None:
    """A constant format as a pattern of date_format; None when it has other elements."""
    if not (is_string(token) and re.fullmatch(r"'[^'\\]*'", token)):
        return None
    out = []
    for literal, element in re.findall(r"([^%]+)|%(.?)", token[1:-1]):
        if element and element not in _JAVA:
            return None
        out.append(_JAVA[element] if element else "".join(f'"{c}"' if c.isalpha() else c for c in literal).replace('""', ""))
    return "'" + "".join(out).replace('"', "\\'") + "'"


def _date_call(name: str, args: list[list]) -> str | None:
    kind, _, what = name.partition("_")
    if kind == "FORMAT" and what in ("DATE", "DATETIME", "TIMESTAMP") and len(args) == 2 and len(args[0]) == 1 and (pattern := _java_pattern(args[0][0])):
        return f"date_format({text_of(args[1])}, {pattern})"
    if what in ("ADD", "SUB") and kind in ("DATE", "DATETIME", "TIMESTAMP", "TIME") and len(args) == 2 and (iv := _interval(args[1])):
        n, part = iv
        x = text_of(args[0])
        sign = "-" if what == "SUB" else ""
        if part in _PARTS:
            unit, k = _PARTS[part]
            if kind == "DATE":
                return f"date_add({x}, cast({sign}({n}) * {k} as int))" if unit == "day" else f"cast(add_months({x}, cast({sign}({n}) * {k} as int)) as date)"
            return f"timestampadd({unit.upper()}, cast({sign}({n}) * {k} as int), {x})"
        return f"timestampadd({part}, {sign}({n}), {x})"
    if what == "DIFF" and len(args) == 3:
        a, b = text_of(args[0]), text_of(args[1])
        p, first = _week(args[2])
        if kind in ("TIMESTAMP", "TIME"):
            return f"timestampdiff({p}, {b}, {a})"
        if first is not None:
            return f"cast(datediff({_trunc(a, args[2], False)}, {_trunc(b, args[2], False)}) / 7 as bigint)"
        if p == "DAY":
            return f"cast(datediff({a}, {b}) as bigint)"
        if p in ("MONTH", "QUARTER", "YEAR"):
            k = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[p]
            m = lambda x: f"(year({x}) * 12 + month({x}) - 1)"
            return f"cast(floor({m(a)} / {k}) - floor({m(b)} / {k}) as bigint)"
        return f"timestampdiff({p}, date_trunc('{p}', {b}), date_trunc('{p}', {a}))"
    if what == "TRUNC" and len(args) >= 2:
        return _trunc(text_of(args[0]), args[1], kind != "DATE")
    if what == "BUCKET" and (iv := _interval(args[1])):
        n, part = iv
        x = text_of(args[0])
        if kind == "DATE":
            o = text_of(args[2]) if len(args) > 2 else "DATE'1950-01-01'"
            if part in ("DAY", "WEEK"):
                k = f"({n} * {7 if part == 'WEEK' else 1})"
                return f"date_add({o}, cast(floor(datediff({x}, {o}) / {k}) * {k} as int))"
            k = f"({n} * {_PARTS[part][1]})"
            return f"cast(add_months({o}, cast(floor(months_between({x}, {o}) / {k}) * {k} as int)) as date)"
        o = text_of(args[2]) if len(args) > 2 else "TIMESTAMP'1950-01-01'"
        unit = {"MICROSECOND": 1, "MILLISECOND": 10**3, "SECOND": 10**6, "MINUTE": 6 * 10**7, "HOUR": 36 * 10**8, "DAY": 864 * 10**8}[part]
        k = f"({n} * {unit}L)"
        return f"timestamp_micros(unix_micros({o}) + cast(floor((unix_micros({x}) - unix_micros({o})) / {k}) as bigint) * {k})"
    if name == "LAST_DAY":
        x = text_of(args[0])
        p, first = _week(args[1]) if len(args) > 1 else ("MONTH", None)
        if p == "MONTH":
            return f"last_day({x})"
        start = _trunc(x, args[1], False)
        return f"date_add({start}, 6)" if first is not None else f"date_add(add_months({start}, {_PARTS[p][1]}), -1)"
    return None


_MICROS = {"MICROSECOND": 1, "MILLISECOND": 10**3, "SECOND": 10**6, "MINUTE": 6 * 10**7, "HOUR": 36 * 10**8, "DAY": 864 * 10**8, "WEEK": 7 * 864 * 10**8}


def _time_table(name: str, args: list[list]) -> str:
    """TUMBLE, HOP and RANGE_SESSIONIZE over TABLE t, as a derived table."""
    table = text_of(args[0][1:])
    column = args[1][-1].strip("'\"")
    if name == "RANGE_SESSIONIZE":
        keys = [t.strip("'\"") for t in args[2][-1] if t != ","]
        meets = len(args) < 4 or "MEETS" in "".join(t for t in args[3] if isinstance(t, str)).upper()
        over = f"PARTITION BY {', '.join(keys)} " if keys else ""
        low, high = f"coalesce(cast({column}.start as timestamp), timestamp'0001-01-01')", f"coalesce(cast({column}.end as timestamp), timestamp'9999-12-31')"
        fresh = f"coalesce({low} {'>' if meets else '>='} max({high}) OVER ({over}ORDER BY {low}, {high} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)"
        ids = f"(SELECT *, sum(int(__new)) OVER ({over}ORDER BY {low}, {high} ROWS UNBOUNDED PRECEDING) AS __id FROM (SELECT *, {fresh} AS __new FROM {table}))"
        whole = f"PARTITION BY {', '.join([*keys, '__id'])}"
        bounds = f"named_struct('start', CASE WHEN bool_and({column}.start IS NOT NULL) OVER ({whole}) THEN min({column}.start) OVER ({whole}) END, 'end', CASE WHEN bool_and({column}.end IS NOT NULL) OVER ({whole}) THEN max({column}.end) OVER ({whole}) END)"
        return f"(SELECT * EXCEPT (__new, __id), {bounds} AS session_range FROM {ids})"
    spans = []
    for a in args[2:]:
        a = a[next((i + 1 for i, t in enumerate(a) if t == "=>"), 0) :]
        if iv := _interval(a):
            spans.append(f"({iv[0]} * {_MICROS[iv[1]]}L)")
        else:
            spans.append(text_of(a))
    n = 1 if name == "TUMBLE" else 2
    origin = f"unix_micros(cast({spans[n]} as timestamp))" if len(spans) > n else "0L"
    ts = f"unix_micros(cast({column} as timestamp))"
    size, step = spans[0], spans[n - 1]
    last = f"({origin} + cast(floor(({ts} - {origin}) / {step}) as bigint) * {step})"
    old = [c for c in SparkSession.active().sql(f"SELECT * FROM {table} LIMIT 0").columns if c.lower() in ("window_start", "window_end")]
    if old:
        table = f"(SELECT * EXCEPT ({', '.join(old)}) FROM {table})"
    if name == "TUMBLE":
        return f"(SELECT *, timestamp_micros({last}) AS window_start, timestamp_micros({last} + {size}) AS window_end FROM {table})"
    starts = f"filter(sequence({last} - ({size} - 1) div {step} * {step}, {last}, {step}), __s -> __s > {ts} - {size})"
    return f"(SELECT * EXCEPT (__w), timestamp_micros(__w) AS window_start, timestamp_micros(__w + {size}) AS window_end FROM (SELECT *, explode({starts}) AS __w FROM {table}))"


def _extract(g: Group) -> str | None:
    at = find(g, "FROM")
    part, rest = g[:at], g[at + 1 :]
    zone = find(rest, "AT", "TIME", "ZONE")
    x = text_of(rest[:zone] if zone >= 0 else rest)
    if zone >= 0:
        x = f"from_utc_timestamp({x}, {text_of(rest[zone + 3 :])})"
    p = up(part[0])
    if p == "DATE":
        return f"cast({x} as date)"
    if p == "WEEK":
        first = _week(part)[1]
        return f"cast(floor((dayofyear({x}) + 6 - pmod(dayofweek({x}) - 1 - {first}, 7)) / 7) as int)"
    names = {"DAYOFWEEK": "dayofweek({})", "DAYOFYEAR": "dayofyear({})", "ISOWEEK": "weekofyear({})", "ISOYEAR": "extract(yearofweek from {})", "MICROSECOND": "cast(pmod(unix_micros(cast({} as timestamp)), 1000000) as int)", "MILLISECOND": "cast(pmod(unix_micros(cast({} as timestamp)), 1000000) div 1000 as int)", "SECOND": "second({})"}
    return f"cast({names[p].format(x)} as bigint)" if p in names else f"cast(extract({p} from {x}) as bigint)"


def _safe(name: str, args: Group) -> str:
    """SAFE.f(...): Spark's try_ form where there is one, else the error-free guard forms."""
    inner = [text_of(a) for a in split_on(args)]
    forms = {"DIV": "try_divide", "ADD": "try_add", "SUBTRACT": "try_subtract", "MULTIPLY": "try_multiply", "SUBSTR": "substring", "LN": "ln", "SQRT": None, "LOG": None, "PARSE_DATE": None}
    n = name.upper()
    if n == "SQRT":
        return f"(case when {inner[0]} >= 0 then sqrt({inner[0]}) end)"
    if n in ("LN", "LOG10"):
        return f"{n.lower()}({inner[0]})"
    if n == "LOG" and len(inner) == 1:
        return f"ln({inner[0]})"
    if n == "LOG":
        return f"log({inner[1]}, {inner[0]})"
    if n == "SUBSTR" and len(inner) == 3:
        return f"(case when {inner[2]} >= 0 then substring({', '.join(inner)}) end)"
    if n in forms and forms[n]:
        return f"{forms[n]}({', '.join(inner)})"
    if n in ("DATE", "MAKE_DATE") and len(inner) == 3:
        return f"cast(try_make_timestamp_ntz({', '.join(inner)}, 0, 0, 0) as date)"
    return _without_errors(_call(name, args))


def _without_errors(call: str) -> str:
    """A call's text with null where it would raise an error."""
    call = re.sub(r"(?i)\bmr_(?!safe_)", "mr_safe_", call)
    call = re.sub(r"(?i)\braise_error\((?:'[^']*'|[^()])*\)", "null", call)
    for word in ("cast", "element_at", "make_timestamp_ntz", "make_timestamp", "make_interval", "to_number", "to_binary", "parse_json", "url_decode", "date_add"):
        if word != "date_add":
            call = re.sub(rf"(?i)(?<![\w]){word}\(", f"try_{word}(", call)
    call = re.sub(r"(?i)(?<!\w)make_date\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"cast(try_make_timestamp_ntz(\1, 0, 0, 0) as date)", call)
    return call


def _ordered(name: str, g: Group) -> str | None:
    """ARRAY_AGG and STRING_AGG with DISTINCT, null treatment, ORDER BY and LIMIT."""
    items = list(g)
    distinct = bool(items) and up(items[0]) == "DISTINCT"
    items = items[1:] if distinct else items
    limit = order = None
    if (at := find(items, "LIMIT")) >= 0:
        limit, items = text_of(items[at + 1 :]), items[:at]
    if (at := find(items, "ORDER", "BY")) >= 0:
        order, items = items[at + 2 :], items[:at]
    ignore = name == "STRING_AGG"
    for word in ("IGNORE", "RESPECT"):
        if (at := find(items, word, "NULLS")) >= 0:
            ignore, items = word == "IGNORE", items[:at] + items[at + 2 :]
    where = None
    if (at := find(items, "WHERE")) >= 0:
        where, items = text_of(items[at + 1 :]), items[:at]
    args = split_on(items)
    value = text_of(args[0])
    keys, downs = [], []
    for k in split_on(order) if order else []:
        down = bool(k) and up(k[-1]) == "DESC"
        keys.append(text_of(k[:-1] if k and up(k[-1]) in ("ASC", "DESC") else k))
        downs.append(down)
    fields = ", ".join(f"'k{i}', {k}" for i, k in enumerate(keys))
    row = f"named_struct({fields + ', ' if fields else ''}'v', {value})"
    got = f"{'collect_set' if distinct else 'collect_list'}({row})"
    got += f" FILTER (WHERE {where})" if where else ""
    if keys:
        if all(downs) or not any(downs):
            got = f"sort_array({got}, {'false' if downs[0] else 'true'})"
        else:
            tests = " ".join(f"when __a.k{i} < __b.k{i} then {1 if d else -1} when __a.k{i} > __b.k{i} then {-1 if d else 1}" for i, d in enumerate(downs))
            got = f"array_sort({got}, (__a, __b) -> case {tests} else 0 end)"
    if ignore:
        got = f"filter({got}, __r -> __r.v is not null)"
    got = f"transform({got}, __r -> __r.v)"
    got = f"slice({got}, 1, {limit})" if limit else got
    if name == "STRING_AGG":
        return f"nullif(array_join({got}, {text_of(args[1]) if len(args) > 1 else repr(',')}), '')"
    return f"(case when size({got}) > 0 then {got} end)"


def _call(name: str, g: Group) -> str:
    n = name.upper().strip("`")
    if n == "ARRAY" and g and up(g[0]) in ("SELECT", "WITH", "FROM"):
        return f"(SELECT collect_list(__v) FROM ({text_of(g)}) AS __a(__v))"
    if n in ("ARRAY_AGG", "STRING_AGG"):
        return _ordered(n, g)
    if n in ("CAST", "SAFE_CAST"):
        at = find(g, "AS")
        body = f"{text_of(g[:at])} AS {_type(g[at + 1 :])}"
        return f"{'try_cast' if n == 'SAFE_CAST' else 'CAST'}({body})"
    if n == "EXTRACT":
        return _extract(g)
    if (where := find(g, "WHERE")) >= 0 and up(g[0]) != "SELECT":
        return f"{_call(name, Group('(', g[:where]))} FILTER (WHERE {text_of(g[where + 1 :])})"
    for word, f in (("MAX", "max_by"), ("MIN", "min_by")):
        if (at := find(g, "HAVING", word)) >= 0 and n == "ANY_VALUE":
            return f"{f}({text_of(g[:at])}, {text_of(g[at + 2 :])})"
    args = split_on(g) if g else []
    if n in ("TUMBLE", "HOP", "RANGE_SESSIONIZE") and args and up(args[0][0]) == "TABLE":
        return _time_table(n, args)
    if (got := _date_call(n, args)) is not None:
        return got
    if n in ("INT64", "FLOAT64", "BOOL", "INT32") and len(args) == 1:
        return f"CAST({text_of(args[0])} AS {TYPES[n]})"
    if n == "STRUCT" or n == "IF":
        return f"{name}({text_of(g)})"
    if g and up(g[0]) == "DISTINCT":
        inner = [f"DISTINCT {text_of(args[0][1:])}", *map(text_of, args[1:])]
    else:
        inner = [text_of(a) for a in args]
    return expand(n, inner) or f"{name}({', '.join(inner)})"


def _type(items: list) -> str:
    """A type's Spark name; ARRAY<...> and STRUCT<...> are rewritten inside."""
    if len(items) == 2 and isinstance(items[1], Group):
        base = up(items[0])
        if "NUMERIC" in base:
            return f"DECIMAL({text_of(items[1]) if ',' in items[1] else text_of(items[1]) + ',0'})"
        return TYPES.get(base, items[0]) if base in ("STRING", "BYTES") else f"{items[0]}({text_of(items[1])})"
    names = " ".join(TYPES.get(up(t), t) if isinstance(t, str) else f"({text_of(t)})" for t in items)
    return re.sub(r"\s*([<>,()])\s*", r"\1", names)


def desugar(sql: str) -> str:
    """The Spark SQL of a query or expression in the dialect."""
    return text_of(tokens(sql))


def expr(text: str) -> Column:
    """A Column from an expression in the dialect."""
    spark = SparkSession.active()
    register(spark)
    return F.expr(desugar(text))


#: Table functions that |> CALL and FROM may name: (DataFrame, *argument texts) -> DataFrame.
TABLE_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {}


def table_function(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Make a function of a DataFrame callable by name in pipes."""
    TABLE_FUNCTIONS[fn.__name__.upper()] = fn
    return fn


def _view(df: DataFrame) -> str:
    name = f"__pipe_{next(_ids)}"
    df.createOrReplaceTempView(name)
    return name


def _self():
    return sys.modules[__name__]


def _subpipe(spark: SparkSession, df: DataFrame, body: list, args) -> DataFrame:
    """Apply a parenthesised run of pipe operators."""
    for s in split_on([t for t in body if t != ";"], "|>"):
        df = _pipe(spark, df, s, args) if s else df
    return df


def _pipe_if(spark: SparkSession, df: DataFrame, step: list, args) -> DataFrame:
    """IF c THEN (..) [ELSEIF c THEN (..)]... [ELSE (..)]: the first that holds is applied; null doesn't hold."""
    at = 0
    while at < len(step) and up(step[at]) in ("IF", "ELSEIF"):
        then = find(step, "THEN", start=at)
        if then < 0 or then + 1 >= len(step) or not isinstance(step[then + 1], Group):
            raise ValueError("IF needs THEN and a parenthesised pipeline")
        cond = step[at + 1 : then]
        if spark.sql(f"SELECT {text_of(cond)} AS c", args).first()[0]:
            return _subpipe(spark, df, list(step[then + 1]), args)
        at = then + 2
    if at < len(step):
        if up(step[at]) != "ELSE" or at + 2 != len(step):
            raise ValueError("IF ends with ELSE and one parenthesised pipeline")
        return _subpipe(spark, df, list(step[at + 1]), args)
    return df


def _pipe(spark: SparkSession, df: DataFrame, step: list, args) -> DataFrame:
    word, rest = up(step[0]), step[1:]
    if word == "RENAME":
        pairs = [(p[0], p[-1]) for p in split_on(rest)]
        return df.withColumnsRenamed(dict(pairs))
    if word == "DISTINCT":
        return df.distinct()
    if word in ("DESCRIBE", "STATIC_DESCRIBE", "LOG"):
        rows = [(f.name, f.dataType.simpleString()) for f in df.schema]
        return spark.createDataFrame(rows, "column_name string, type string") if word == "DESCRIBE" else df
    if word == "ASSERT":
        cond, *message = split_on(rest)
        text = ", ".join(f"cast({text_of(m)} as string)" for m in message) or "''"
        check = f"case when {text_of(cond)} then true else cast(raise_error(concat('ASSERT failed: ', {text})) as boolean) end"
        return df.where(F.expr(check))
    if word == "WINDOW":
        return spark.sql(f"SELECT *, {text_of(rest)} FROM {_view(df)}", args)
    if word == "CALL":
        extra = [text_of(a) for a in split_on(rest[1])] if rest[1] else []
        out = TABLE_FUNCTIONS[up(rest[0])](df, *extra)
        return out
    if word == "IF":
        return _pipe_if(spark, df, step, args)
    if word == "TEE":
        for body in split_on(rest):
            _subpipe(spark, df, list(body[0]), args)
        return df
    if word == "WITH":
        for w in split_on(rest):
            statements.query(spark, list(w[2]), args, _self()).createOrReplaceTempView(w[0])
        return df
    if word == "CREATE":
        return statements.change(spark, [*step, "AS", "FROM", _view(df)], args, _self())
    if word == "INSERT":
        return statements.change(spark, [*step, "FROM", _view(df)], args, _self())
    if word == "MATCH_RECOGNIZE":
        return patterns.apply(spark, df, list(rest[0]), up, split_on, desugar)
    if word == "UNPIVOT":
        return spark.sql(f"SELECT * FROM {_view(df)} UNPIVOT {text_of(rest)}", args)
    if word in ("UNION", "INTERSECT", "EXCEPT"):
        at = next(i for i, t in enumerate(rest) if isinstance(t, Group))
        kind = text_of([step[0], *rest[:at]])
        for q in split_on(rest[at:]):
            df = spark.sql(f"SELECT * FROM {_view(df)} {kind} ({text_of(q[0])})", args)
        return df
    if word == "AGGREGATE" and (at := find(step, "GROUP", "AND", "ORDER", "BY")) >= 0:
        keys = text_of(step[at + 4 :])
        bare = ", ".join(re.sub(r"(?i)\s+(asc|desc)(\s+nulls\s+\w+)?$", "", k.strip()) for k in keys.split(","))
        df = spark.sql(f"FROM {_view(df)} |> AGGREGATE {text_of(step[1:at])} GROUP BY {bare}", args)
        return spark.sql(f"SELECT * FROM {_view(df)} ORDER BY {keys}", args)
    return spark.sql(f"FROM {_view(df)} |> {text_of(step)}", args)


def run(spark: SparkSession, text: str, args: dict | list | None = None) -> DataFrame:
    """Run one statement of the dialect; ``args`` are its @named or ? parameters."""
    register(spark)
    tree = list(tokens(text))
    while tree and tree[-1] == ";":
        tree.pop()
    return run_tokens(spark, tree, args)


def run_tokens(spark: SparkSession, tree: list, args=None) -> DataFrame:
    """Run a statement given as its token tree."""
    tree = _by_name(spark, _matched(spark, tree, args), args)
    if "|>" not in tree:
        for form in (statements.change, statements.recursion, statements.set_by_name):
            if (out := form(spark, tree, args, _self())) is not None:
                return out
        return spark.sql(text_of(tree), args)
    first, *steps = split_on(tree, "|>")
    if up(first[0]) == "FROM":
        first = ["SELECT", "*", *first]
    df = spark.sql(text_of(first), args)
    for s in steps:
        df = _pipe(spark, df, s, args)
    return df


def _by_name(spark: SparkSession, items: list, args) -> list:
    """Put a view in place of each parenthesised set operation by name."""
    out = []
    for t in items:
        if isinstance(t, Group):
            inner = _by_name(spark, list(t), args)
            named = t.kind == "(" and (find(inner, "BY", "NAME") >= 0 or find(inner, "CORRESPONDING") >= 0)
            got = statements.set_by_name(spark, inner, args, _self()) if named else None
            t = Group(t.kind, inner) if got is None else Group("(", ["SELECT", "*", "FROM", _view(got)])
        out.append(t)
    return out


def _matched(spark: SparkSession, items: list, args) -> list:
    """Run each MATCH_RECOGNIZE clause and put a view of its matches in its place."""
    out = [Group(t.kind, _matched(spark, list(t), args)) if isinstance(t, Group) and find(list(t), "MATCH_RECOGNIZE") >= 0 else t for t in items]
    at = 0
    while (at := find(out, "MATCH_RECOGNIZE", start=at)) >= 0:
        if out[at - 1] == "|>":  # a pipe operator: it runs in its turn
            at += 1
            continue
        begin = at - 1
        while begin >= 2 and out[begin - 1] == ".":
            begin -= 2
        df = spark.sql(f"SELECT * FROM {text_of(out[begin:at])}", args)
        out[begin : at + 2] = [_view(patterns.apply(spark, df, list(out[at + 1]), up, split_on, desugar))]
        at = begin + 1
    return out


def script(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame | None:
    """Run statements one after another; the last one's DataFrame is the result."""
    out = None
    for s in split_on(list(tokens(text)), ";"):
        if s:
            out = run(spark, _plain(s), args)
    return out


def _plain(items: list) -> str:
    return " ".join(t if isinstance(t, str) else f"{t.kind}{_plain(t)}{_NEST[t.kind]}" for t in items)
