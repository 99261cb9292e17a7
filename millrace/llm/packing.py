"""Bounded-space online packing (operator 8).

Each input partition keeps ``windows`` open sequences. A document that is
longer than a sequence fills whole ones first; what is left goes into the open
sequence it fits best. When it fits none and no more may be opened, the fullest
is topped up with the document's head and emitted, and the rest is placed
again, so an emitted sequence has no padding. What is still open at the end of
a partition goes, ids and all, to a merge: groups of ``fan`` partitions are
packed the same way, level by level, until one group is left. Its last
sequences are cut to powers of two, which need no padding either.

Work is one pass over the texts; only the leftovers (at most ``windows``
sequences a partition) move, and no task sees more than ``fan`` partitions'.

Cases: a null text is empty and holds the end id alone; a text of any length is
packed whole, over as many sequences as it needs; a null or repeated
``doc_id`` is carried as it is, each row being a document of its own; an empty
table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder

_ROWS = (
    "kind int, place long, doc_id long, start long, length long, ids_crc32 long,"
    " doc_tokens long, sequence_id long, offset long, ids binary"
)
_NAMES = [x.split()[0] for x in _ROWS.split(",")]
_TYPES = [pa.int32(), *[pa.int64()] * 8, pa.binary()]


class Packer:
    """Places documents in open sequences; ``emit`` gets (pieces, length) of a closed one."""

    def __init__(self, capacity: int, windows: int) -> None:
        self.capacity, self.windows = capacity, windows
        self.open: list[tuple[int, int]] = []  # (space, key), by space
        self.held: dict[int, list[tuple]] = {}
        self.done: list[list[tuple]] = []
        self.keys = 0

    def add(self, doc: object, start: int, ids: np.ndarray, total: int) -> None:
        """Place ``ids``, which begin at ``start`` of a document of ``total`` ids."""
        while len(ids) >= self.capacity:
            self.done.append([(doc, start, ids[: self.capacity], total)])
            start, ids = start + self.capacity, ids[self.capacity :]
        while len(ids):
            n = len(ids)
            i = bisect_left(self.open, (n, -1))
            if i < len(self.open):  # the least space that holds it
                space, key = self.open.pop(i)
                self._put(key, space, (doc, start, ids, total), n)
                return
            if len(self.open) < self.windows:
                self.keys += 1
                self.held[self.keys] = []
                self._put(self.keys, self.capacity, (doc, start, ids, total), n)
                return
            space, key = self.open.pop(0)  # the fullest
            self._put(key, space, (doc, start, ids[:space], total), space)
            start, ids = start + space, ids[space:]

    def _put(self, key: int, space: int, piece: tuple, n: int) -> None:
        self.held[key].append(piece)
        if space == n:
            self.done.append(self.held.pop(key))
        else:
            insort(self.open, (space - n, key))

    def take_done(self) -> list[list[tuple]]:
        """The sequences closed since the last call."""
        out, self.done = self.done, []
        return out

    def leftovers(self) -> list[list[tuple]]:
        """The open sequences, the fullest first."""
        return [self.held[key] for _, key in self.open]


def _rows(kind: int, place: int, sequences: list[list[tuple]], first: int, keep: bool) -> pa.RecordBatch:
    out: list[list] = [[] for _ in _NAMES]
    for k, pieces in enumerate(sequences):
        at = 0
        for doc, start, ids, total in pieces:
            data = ids.astype("<u4").tobytes()
            row = (kind, place, doc, start, len(ids), zlib.crc32(data), total, first + k, at, data if keep else None)
            for column, x in zip(out, row, strict=True):
                column.append(x)
            at += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)], names=_NAMES)


def _pack(batches: Iterable[pa.RecordBatch], path: str, end: int, capacity: int, windows: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    tail = np.array([end], enc.dtype).tobytes()
    place = TaskContext.get().partitionId()
    packer = Packer(capacity, windows)
    first = place << 26
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids = np.frombuffer(enc.encode(text) + tail, enc.dtype)
                packer.add(doc, 0, ids, len(ids))
            done = packer.take_done()
            if done:
                yield _rows(0, place, done, first, False)
                first += len(done)
    yield _rows(1, place, packer.leftovers(), first, True)


def _merge(batches: Iterable[pa.RecordBatch], level: int, last: bool, capacity: int, windows: int) -> Iterator[pa.RecordBatch]:
    """Pack the leftovers of each group; rows come sorted by group, place and sequence."""
    place, packer, first = None, Packer(capacity, windows), 0

    def close() -> Iterator[pa.RecordBatch]:
        done = packer.take_done()
        rest = packer.leftovers()
        if not last:
            yield _rows(0, place, done, first, False)
            yield _rows(1, place, rest, first + len(done), True)
            return
        yield _rows(0, place, done + powers([p for pieces in rest for p in pieces], capacity), first, False)

    for batch in batches:
        for group, doc, start, total, data in zip(
            *(batch[c].to_pylist() for c in ("place", "doc_id", "start", "doc_tokens", "ids")), strict=True
        ):
            if group != place:
                if place is not None:
                    yield from close()
                place, packer = group, Packer(capacity, windows)
                first = (level << 58) + (group << 26)
            packer.add(doc, start, np.frombuffer(data, "<u4"), total)
    if place is not None:
        yield from close()


def powers(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    """The pieces, in order, as whole sequences and then ones of falling powers of two."""
    left = sum(len(p[2]) for p in pieces)
    out: list[list[tuple]] = []
    todo = list(reversed(pieces))
    while left:
        room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc, start, ids, total = todo.pop()
            out[-1].append((doc, start, ids[:room], total))
            if len(ids) > room:
                todo.append((doc, start + room, ids[room:], total))
            room -= min(room, len(ids))
    return out


def pack(
    docs: DataFrame, vocabulary: str, *, end: int = 2, capacity: int = 4096, windows: int = 8, fan: int = 64
) -> DataFrame:
    """Pack ``docs`` (doc_id, text): a row for each piece, see the module's text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    todo = materialize(
        rows.mapInArrow(partial(_pack, path=vocabulary, end=end, capacity=capacity, windows=windows), _ROWS),
        "packed",
    )
    done = todo.where("kind = 0").drop("kind", "place", "ids")
    level = 1
    while True:
        left = todo.where("kind = 1")
        places = left.agg(F.max("place")).first()[0]
        if places is None:
            return done
        groups = places // fan + 1
        left = left.withColumn("place", F.expr(f"place div {fan}"))
        left = left.repartition(groups, "place").sortWithinPartitions("place", "sequence_id", "offset")
        step = partial(_merge, level=level, last=groups == 1, capacity=capacity, windows=windows)
        todo = materialize(left.mapInArrow(step, _ROWS), "packed")
        done = done.unionByName(todo.where("kind = 0").drop("kind", "place", "ids"))
        if groups == 1:
            return done
        level += 1
