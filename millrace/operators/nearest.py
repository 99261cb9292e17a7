"""The nearest rows of one task, for many queries at once, over Arrow batches.

Scores are matrix products in single precision. Rounding moves a score by less
than a bound, so no pair farther above a query's present limit can be among its
best; the pairs that are left are measured in double precision, component after
component as Catalyst's aggregates do, and only those distances count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Queries and rows scored in one product; components of one slab of rows, and of pairs measured at once.
QUERIES, ROWS, SLAB, EXACT = 1024, 1024, 1 << 21, 1 << 20
#: Components above it may overflow in single precision, lengths below lose all digits when divided by: such vectors are measured with all others.
LARGE, SMALL = 1e15, 1e-100
#: Catalyst's order: null first, then numbers, then NaN; last, places without a row.
NULL, NUMBER, NAN, EMPTY = range(4)


def _sum(terms: np.ndarray) -> np.ndarray:
    """Of each row, from left to right."""
    return np.add.accumulate(terms, axis=1)[:, -1] + 0.0 if terms.shape[1] else np.zeros(len(terms))


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt(_sum(x * x))


def measure(kind: str, a: np.ndarray, b: np.ndarray, ansi: bool) -> tuple[np.ndarray, np.ndarray]:
    """Class and distance of each row of ``a`` to that row of ``b``; ``ansi``: an error where lengths multiply to zero, else null."""
    with np.errstate(all="ignore"):
        if kind == "EUCLIDEAN":
            d = np.sqrt(_sum((a - b) * (a - b)))
        elif kind == "MANHATTAN":
            d = _sum(np.abs(a - b))
        elif kind == "DOT_PRODUCT":
            d = -_sum(a * b)
        else:
            below = _length(a) * _length(b)
            if ansi and (below == 0).any():
                raise ZeroDivisionError("a vector without length has no cosine distance")
            d = 1 - _sum(a * b) / below
    order = np.where(np.isnan(d), NAN, NUMBER).astype(np.int8)
    if kind == "COSINE":
        order[below == 0] = NULL
    return order, np.where(order == NUMBER, d, 0.0)


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the rows' places, their components, and which hold a null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == n)
        flat = column.take(pa.array(at)).flatten()
        void = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), n).any(axis=1)
        yield at, flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(len(at), n), void


def _firsts(x: np.ndarray, most: int) -> np.ndarray:
    """Marks all but the rows that ``most`` equal ones precede."""
    _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    by = np.argsort(group, kind="stable")
    keep = np.ones(len(x), bool)
    keep[by[most:]] = group[by[most:]] != group[by[:-most]]
    return keep


def _hits(s: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of scores within their row's limit, for few: only rows whose least score is are looked through."""
    some = np.flatnonzero(s.min(axis=1) <= limit)
    i, j = np.divmod(np.flatnonzero(s[some] <= limit[some, None]), s.shape[1])
    return some[i], j


def _unlike(kind: str, x: np.ndarray) -> np.ndarray:
    """Marks vectors whose scores have no bound."""
    with np.errstate(all="ignore"):
        odd = ~(np.abs(x).max(axis=1, initial=0) <= LARGE)
        return odd | (_length(x.astype(float)) < SMALL) if kind == "COSINE" else odd


@dataclass
class _Nearest:
    """The best ``k`` rows so far of each query of one length.

    ``x`` are the queries, equal ones once, and ``void`` marks those with a
    null; ``own`` orders the queries they stand for, which ``of`` leads back
    from and whose ids lie at ``places``.
    """

    kind: str
    k: int
    ansi: bool
    places: np.ndarray
    own: np.ndarray
    of: np.ndarray
    x: np.ndarray
    void: np.ndarray
    seen: int = 0
    voids: int = 0
    order: np.ndarray = field(init=False)
    d: np.ndarray = field(init=False)
    row: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        shape = (len(self.x), self.k)
        self.order, self.d, self.row = np.full(shape, EMPTY, np.int8), np.zeros(shape), np.full(shape, -1)
        n = self.x.shape[1]
        self.odd = _unlike(self.kind, self.x) & ~self.void
        even = ~(self.odd | self.void)
        self.even = np.flatnonzero(even)
        q = self.x[self.even].astype(float)
        self.centre = q.mean(axis=0) if self.kind == "EUCLIDEAN" and len(q) else np.zeros(n)
        q -= self.centre
        self.length = _length(q)
        if self.kind == "EUCLIDEAN":
            self.q = np.hstack([-2 * q, np.ones((len(q), 1))]).astype(np.float32)
        elif self.kind == "MANHATTAN":
            self.q = q
        else:
            self.q = (-q / self.length[:, None] if self.kind == "COSINE" else -q).astype(np.float32)

    def _merge(self, query: np.ndarray, order: np.ndarray, d: np.ndarray, row: np.ndarray) -> None:
        """Some pairs compete with what is held; of equals, the row that came first wins."""
        if not len(query):
            return
        at, query = np.unique(query, return_inverse=True)
        held = np.repeat(np.arange(len(at)), self.k)
        query, order = np.concatenate([held, query]), np.concatenate([self.order[at].ravel(), order])
        d, row = np.concatenate([self.d[at].ravel(), d]), np.concatenate([self.row[at].ravel(), row])
        by = np.lexsort((row, d, order, query))
        counts = np.bincount(query, minlength=len(at))
        best = by[(np.cumsum(counts) - counts)[:, None] + np.arange(self.k)]
        self.order[at], self.d[at], self.row[at] = order[best], d[best], row[best]

    def _measure(self, query: np.ndarray, x: np.ndarray, at: np.ndarray, row: np.ndarray) -> None:
        """Pairs of queries and rows of ``x`` are measured."""
        step = max(1, EXACT // max(1, x.shape[1]))
        for i in range(0, len(query), step):
            q, a = query[i : i + step], at[i : i + step]
            self._merge(q, *measure(self.kind, x[a].astype(float), self.x[q].astype(float), self.ansi), row[a])

    def _all(self, query: np.ndarray, x: np.ndarray, row: np.ndarray) -> None:
        step = max(1, EXACT // max(1, x.shape[1] * len(query)))
        for i in range(0, len(x), step) if len(query) else ():
            at = np.arange(i, min(i + step, len(x)))
            self._measure(np.repeat(query, len(at)), x, np.tile(at, len(query)), row)

    def add(self, x: np.ndarray, void: np.ndarray, row: np.ndarray) -> None:
        """Rows in their order; ``row`` numbers them."""
        some = row[: max(0, self.k - self.seen)]  # nulls tie: the first rows win
        self._nulls(np.flatnonzero(self.void), some)
        some = row[void][: max(0, self.k - self.voids)]
        self._nulls(np.flatnonzero(~self.void), some)
        self.seen, self.voids = self.seen + len(row), self.voids + int(void.sum())
        x, row = x[~void], row[~void]
        if len(x) and x.shape[1]:
            keep = _firsts(x, self.k)
            x, row = x[keep], row[keep]
        self._all(np.flatnonzero(self.odd), x, row)
        odd = _unlike(self.kind, x)
        self._all(self.even, x[odd], row[odd])
        if len(self.even) and not odd.all():
            self._scored(x[~odd], row[~odd])

    def _nulls(self, query: np.ndarray, row: np.ndarray) -> None:
        n = len(query) * len(row)
        self._merge(np.repeat(query, len(row)), np.full(n, NULL, np.int8), np.zeros(n), np.tile(row, len(query)))

    def _scored(self, x: np.ndarray, row: np.ndarray) -> None:
        a = x.astype(float) - self.centre
        n, length = a.shape[1], _length(a)
        reach, far = length.max(), _length(self.centre[None])[0]
        both = reach + self.length
        slack = both * ((n + 16) * 2.0**-23 * both + 2.0**-48 * (both + far)) + 1e-36 * (n + 1)
        if self.kind == "EUCLIDEAN":
            a = np.hstack([a, (length * length)[:, None]]).astype(np.float32)
        elif self.kind == "COSINE":
            a, slack = (a / length[:, None]).astype(np.float32), np.full(len(both), (n + 16) * 2.0**-21)
        elif self.kind == "DOT_PRODUCT":
            a = a.astype(np.float32)
        else:
            slack = np.zeros(len(both))
        for i in range(0, len(self.even), QUERIES):
            part = slice(i, i + QUERIES)
            query, at = self._candidates(a, part, slack[part])
            self._measure(self.even[part][query], x, at, row)

    def _limit(self, part: slice, slack: np.ndarray) -> np.ndarray:
        """The scores that the last rows held allow for."""
        order, d = self.order[self.even[part], -1], self.d[self.even[part], -1]
        if self.kind == "EUCLIDEAN":
            d = d * d - self.length[part] ** 2
        elif self.kind == "COSINE":
            d = d - 1
        return np.where(order == NUMBER, d + slack, np.where(order == NULL, -np.inf, np.inf))

    def _candidates(self, a: np.ndarray, part: slice, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be among the best, of some queries and all rows of ``a``."""
        q, limit = self.q[part], self._limit(part, slack)
        kind, queries, at, scores, new = a.dtype, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, a.dtype)], 0

        def tighten() -> None:
            """The k-th score found so far, and what rounding may have added to it and the next."""
            nonlocal queries, at, scores, limit, new
            i, j, s = map(np.concatenate, (queries, at, scores))
            by = np.lexsort((s, i))
            counts = np.bincount(i, minlength=len(q))
            full = np.flatnonzero(counts >= self.k)
            last = s[by[(np.cumsum(counts) - counts)[full] + self.k - 1]]
            limit[full] = np.fmin(limit[full], last + 2 * slack[full])
            keep = s <= limit[i].astype(kind)
            queries, at, scores, new = [i[keep]], [j[keep]], [s[keep]], 0

        for k in range(0, len(a), ROWS):
            some = a[k : k + ROWS]
            if self.kind == "MANHATTAN":
                s = np.zeros((len(q), len(some)))
                for c in range(a.shape[1]):
                    s += np.abs(q[:, c, None] - some[None, :, c])
            else:
                s = q @ some.T
            if np.isposinf(limit).any() and len(some) >= self.k:
                limit = np.fmin(limit, np.partition(s, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
            i, j = _hits(s, limit.astype(kind))
            if len(i):
                queries.append(i)
                at.append(j + k)
                scores.append(s[i, j])
                new += len(i)
                if new > 4 * self.k * len(q):
                    tighten()
        tighten()
        return queries[0], at[0]


def pack(queries: pa.Table) -> tuple[pa.Array, list[dict]]:
    """Ids, and the vectors of each length, equal ones once, with the queries they stand for."""
    ids, groups = queries.column(0).combine_chunks(), []
    for places, x, void in vectors_of(queries.column(1)):
        whole = np.hstack([x, void[:, None].astype(x.dtype)])
        _, first, of = np.unique(whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(of, kind="stable")
        groups.append({"places": places, "own": by, "of": of, "x": x[first], "void": void[first]})
    return ids, groups


def nearest(batches: Iterable[pa.RecordBatch], *, packed, kind: str, k: int, ansi: bool) -> Iterator[pa.RecordBatch]:
    """A task's best rows for each query; the last column of the batches is the vector, equal distances go to the earlier row."""
    ids, groups = packed.value
    tops = {g["x"].shape[1]: _Nearest(kind, k, ansi, **g) for g in groups}
    held, numbers, count, slab, weight, schema = None, np.zeros(0, np.int64), 0, [], 0, None

    def take(table: pa.Table) -> None:
        nonlocal held, numbers, count
        row = np.arange(count, count + len(table))
        count += len(table)
        for at, x, void in vectors_of(table.column(-1)):
            if x.shape[1] in tops:
                tops[x.shape[1]].add(x, void, row[at])
        rest = table.drop_columns([table.column_names[-1]])
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *(t.row[t.row >= 0] for t in tops.values())]))
        old, new = used[used < row[0]], used[used >= row[0]]
        rest = rest.take(pa.array(new - row[0]))
        held = rest if held is None else pa.concat_tables([held.take(pa.array(np.searchsorted(numbers, old))), rest]).combine_chunks()
        numbers = used

    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        slab.append(batch)
        weight += batch.num_rows + len(batch.column(batch.num_columns - 1).flatten())
        if weight >= SLAB:
            take(pa.Table.from_batches(slab))
            slab, weight = [], 0
    if slab:
        take(pa.Table.from_batches(slab))
    if schema is None:
        return
    for t in tops.values():
        step = max(1, (1 << 16) // k)
        for i in range(0, len(t.own), step):
            own = t.own[i : i + step]
            order, d, row = (x[t.of[own]].ravel() for x in (t.order, t.d, t.row))
            there = order != EMPTY
            order, d, row = order[there], np.where(order == NAN, np.nan, d)[there], row[there]
            place = np.repeat(t.places[own], k)[there]
            rest = held.take(pa.array(np.searchsorted(numbers, row))).combine_chunks()
            columns = [ids.take(pa.array(place)), *(c.combine_chunks() for c in rest.columns), pa.array(d, mask=order == NULL, from_pandas=False)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", *rest.column_names, "distance"])
