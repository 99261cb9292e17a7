"""Benchmark decontamination by a prefix-filtered set join (operator 1).

A benchmark item is cut into windows of ``size`` words (a shorter item is one
window). A document holds a window when all its words occur there in a row, so
all of the window's shingles of ``shingle`` words do; the overlap asked for is
the whole set, and its necessary prefix, under any total order of shingles, is
the one rarest of them. The order is how often a shingle occurs in the whole
corpus, then its hash, then its place.

* Each window is indexed under its prefix: the shingle and its place.
* Documents are read twice, whatever the size of the benchmark: once to count
  the shingles that windows have, once for the places at which a prefix stands,
  each with the few words around it that a window could reach. Both passes look
  at a bitmap of ``BITS`` bits, so what is broadcast never grows.
* Places and prefixes meet in a join. The positional bound gives the one start
  a place allows, the length bound drops starts that leave no room before or
  after, and the words there are compared with the window's. A prefix that is
  hot in the corpus is broadcast (:func:`common.lookup`).
* Verified windows are gathered by document and joined to the rows.

Cases: a null text has no words; a text of any length is read whole, and sends
only what stands around prefixes; shingles that tie in rarity are ordered by
hash and place; rows of the benchmark without an ``item_id`` or without words
are no items; rows that repeat an ``item_id`` add their windows to that item;
each document row, repeated ones too, gets its own result; empty tables give no
hits. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, materialize, mix64, window_hashes

#: Word bytes as the contract fixes them: 0-9, a-z (after lower-casing A-Z) and all beyond ASCII; others are blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bits of the bitmaps that are broadcast.
BITS = 1 << 22
#: Bytes of hits up to which they are broadcast to the documents.
BROADCAST_BYTES = 64 << 20
_SPAN = "array<struct<first:bigint,last:bigint>>"
#: Bytes whose words are hashed at once, and the odd base of the polynomial.
_BLOCK, _BASE = 1 << 14, 0x9E3779B97F4A7C15


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(_FOLD).split() if text else []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = (_powers(b, _BLOCK) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


class Words:
    """The words of a batch of texts: their hashes, and where those of each text begin (and the last end)."""

    def __init__(self, texts: pa.Array, hashed: bool = True) -> None:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = data[int(at[0]) : int(at[-1])].to_pybytes() if data else b""
        at = at - at[0]
        self.folded = np.frombuffer(raw.translate(_FOLD), np.uint8)
        letter = self.folded != 32
        begins, finish = letter.copy(), letter.copy()
        begins[1:] &= ~letter[:-1]
        finish[:-1] &= ~letter[1:]
        inner = at[(at > 0) & (at < len(raw))]  # a text's end ends a word
        begins[inner] |= letter[inner]
        finish[inner - 1] |= letter[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, at)
        self.hashes = self._hashed() if hashed else None

    def _hashed(self) -> np.ndarray:
        """A polynomial of each word's bytes, from running sums over blocks of whole words, mixed."""
        out, i = np.empty(len(self.starts), np.uint64), 0
        while i < len(out):
            begin = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, begin + _BLOCK, "right")))
            n = int(self.ends[j - 1]) - begin
            up, down = (_UP, _DOWN) if n <= _BLOCK else (_powers(b, n) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.folded[begin : begin + n] * up[:n], out=sums[1:])
            a, b = self.starts[i:j] - begin, self.ends[i:j] - begin
            out[i:j] = mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            i = j
        return out

    def shingles(self, n: int, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, text and hash of each run of ``n`` words in one text, whose bit is set if ``bits`` are given."""
        h = window_hashes(self.hashes, n)
        at = np.arange(len(h)) if bits is None else _held(bits, h)
        text = np.searchsorted(self.first, at, "right") - 1
        whole = at + n <= self.first[text + 1]
        at, text = at[whole], text[whole]
        return at, text, h[at]

    def around(self, low: int, high: int) -> bytes:
        """The words from one place to another, with a blank between."""
        return b" ".join(self.folded[self.starts[low] : self.ends[high - 1]].tobytes().split())


def _windows(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        out: list[tuple[bytes, int]] = []
        for item, text in zip(rb["item_id"].to_pylist(), rb["text"].to_pylist(), strict=True):
            w = words_of(text)
            if w:
                out += [(b" ".join(w[i : i + size]), item) for i in range(max(1, len(w) - size + 1))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in out], pa.binary()), pa.array([i for _, i in out], pa.int64())],
            names=["window", "item_id"],
        )


def windows(benchmark: DataFrame, size: int = 8) -> DataFrame:
    """The distinct (window, item_id) of a benchmark."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).where("item_id is not null")
    return rows.mapInArrow(partial(_windows, size=size), "window binary, item_id long").distinct()


def _tokens(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Each shingle of each window, with its place."""
    for rb in batches:
        words = Words(rb["window"])
        n = np.diff(words.first)
        for width in np.unique(np.minimum(n, shingle)).tolist():
            at, text, h = words.shingles(width)
            mine = np.minimum(n[text], shingle) == width
            at, text, h = at[mine], text[mine], h[mine]
            yield pa.RecordBatch.from_arrays(
                [rb["window"].take(pa.array(text)), pa.array(h.view(np.int64)), pa.array((at - words.first[text]).astype(np.int32)), pa.array(np.full(len(at), width, np.int32))],
                names=["window", "token", "place", "width"],
            )


def bitmap(tokens: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bit set for each ``token``; at most ``bits / 64`` rows reach the driver."""
    bit = F.expr(f"token & {bits - 1}L")
    rows = tokens.groupBy(F.shiftright(bit, 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(token & 63 as int)))").alias("v")).collect()
    words = np.zeros(bits // 64, np.int64)
    for r in rows:
        words[r.k] = r.v
    return words.view(np.uint64)


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where the bitmap has the hash's bit."""
    i = h & np.uint64(len(bits) * 64 - 1)
    return np.flatnonzero(bits[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63)) & np.uint64(1))


def _counts(batches: Iterable[pa.RecordBatch], known, widths: list[int]) -> Iterator[pa.RecordBatch]:
    """How often the task's documents hold each shingle whose bit is set."""
    some: list[np.ndarray] = []
    for rb in batches:
        for at in range(0, rb.num_rows, 256):
            words = Words(rb["text"].slice(at, 256))
            some += [words.shingles(n, known.value)[2] for n in widths]
        if sum(map(len, some)) > 1 << 18:
            yield _counted(some)
            some = []
    yield _counted(some)


def _counted(some: list[np.ndarray]) -> pa.RecordBatch:
    token, n = np.unique(np.concatenate(some) if some else np.empty(0, np.uint64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])


_PLACES = "id long, mark long, token long, at int, n_words int, before int, around binary"


def _places(batches: Iterable[pa.RecordBatch], prefixes, widths: list[int], size: int) -> Iterator[pa.RecordBatch]:
    """Where a prefix may stand in each document, and the words around that a window can reach."""
    for rb in batches:
        for begin in range(0, rb.num_rows, 256):
            part = rb.slice(begin, 256)
            out: list[tuple] = []
            words = Words(part["text"])
            ids, marks = part["id"].to_pylist(), part["mark"].to_pylist()
            for n in widths:
                for i, k, h in zip(*(x.tolist() for x in words.shingles(n, prefixes.value)), strict=True):
                    first, last = int(words.first[k]), int(words.first[k + 1])
                    low = max(first, i - size + n)
                    h = h - (1 << 64) if h >> 63 else h
                    out.append((ids[k], marks[k], h, i - first, last - first, i - low, words.around(low, min(last, i + size))))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PLACES.split(", ")])


def _identity(docs: DataFrame) -> dict[str, Column]:
    """What a row's hits go by: its id and its text's hash."""
    return {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), "mark": F.xxhash64(F.col("text").cast("string"))}


def found(docs: DataFrame, benchmark: DataFrame, *, size: int = 8, shingle: int = 5) -> DataFrame:
    """id, mark, spans and items of the documents that hold a window."""
    spark = docs.sparkSession
    rows = windows(benchmark, size).groupBy("window").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    rows = materialize(rows, "windows")
    tokens = rows.select("window").mapInArrow(partial(_tokens, shingle=shingle), "window binary, token long, place int, width int")
    tokens = materialize(tokens, "tokens")
    widths = sorted(r.width for r in tokens.select("width").distinct().collect())  # at most ``shingle`` of them
    texts = docs.select(*[c.alias(k) for k, c in _identity(docs).items()], F.col("text").cast("binary").alias("text"))
    known = spark.sparkContext.broadcast(bitmap(tokens))
    counts = texts.select("text").mapInArrow(partial(_counts, known=known, widths=widths), "token long, n long")
    counts = counts.groupBy("token").agg(F.sum("n").alias("n"))
    rarity = tokens.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rarity.groupBy("window").agg(F.min(F.struct("n", "token", "place")).alias("p"))
    prefixes = rarest.join(rows, "window").where("p.n > 0")  # a shingle that no document has rules its window out
    prefixes = materialize(prefixes.select("p.token", "p.n", F.struct(F.col("p.place").alias("place"), "window", "items").alias("w")), "prefixes")
    index = prefixes.groupBy("token").agg(F.max("n").alias("n"), F.collect_list("w").alias("windows"))
    wanted = spark.sparkContext.broadcast(bitmap(prefixes.select("token").distinct()))
    places = texts.mapInArrow(partial(_places, prefixes=wanted, widths=widths, size=size), _PLACES)
    total = index.agg(F.sum("n")).first()[0] or 0
    met = lookup(places, index, "token", "n", F.xxhash64("id", "mark", "at"), total=total)
    met = met.select("id", "mark", "at", "n_words", "before", F.split(F.col("around").cast("string"), " ").alias("around"), F.explode("windows").alias("w"))
    met = met.withColumn("window", F.col("w.window").cast("string")).withColumn("n", F.size(F.split("window", " ")))
    start = F.col("at") - F.col("w.place")
    fits = (F.col("before") >= F.col("w.place")) & (start + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice("around", F.greatest(F.lit(1), F.col("before") - F.col("w.place") + 1), F.col("n")), " ") == F.col("window")
    held = met.where(fits).where(same)
    span = F.struct(start.cast("long").alias("first"), (start + F.col("n")).cast("long").alias("last"))
    held = held.groupBy("id", "mark").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.flatten(F.collect_set("w.items")).alias("items"))
    held = materialize(held.withColumn("items", F.sort_array(F.array_distinct("items"))), "hits")
    discard(rows, tokens, prefixes)
    return held


def _n_words(texts: pa.Array) -> pa.Array:
    """How many words each text has."""
    parts = [np.diff(Words(texts.slice(at, 256), hashed=False).first) for at in range(0, len(texts), 256)]
    return pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())


def add_hits(docs: DataFrame, benchmark: DataFrame, *, size: int = 8, shingle: int = 5, hits: str = "hits") -> DataFrame:
    """``docs`` with a column ``hits``: n_words, spans of hit words (sorted; they may overlap), items found."""
    held = found(docs, benchmark, size=size, shingle=shingle)
    held = held.select(F.col("id").alias("__d_id"), F.col("mark").alias("__d_mark"), F.col("spans").alias("__d_spans"), F.col("items").alias("__d_items"))
    # Few documents hold an item: their hits are broadcast while they are small, and else joined in a shuffle.
    weight = held.agg(F.sum(64 + 16 * F.size("__d_spans") + 8 * F.size("__d_items"))).first()[0] or 0
    held = F.broadcast(held) if weight <= BROADCAST_BYTES else held.hint("shuffle_hash")
    keys = _identity(docs)
    met = docs.withColumn("__d_id", keys["id"]).withColumn("__d_mark", keys["mark"]).join(held, ["__d_id", "__d_mark"], "left")
    one = F.struct(
        F.arrow_udf(_n_words, "bigint")(F.col("text").cast("binary")).alias("n_words"),
        F.coalesce("__d_spans", F.array().cast(_SPAN)).alias("spans"),
        F.coalesce("__d_items", F.array().cast("array<bigint>")).alias("items"),
    )
    return met.withColumn(hits, one).drop("__d_id", "__d_mark", "__d_spans", "__d_items")


def hit_words(spans: Column) -> Column:
    """How many words the spans, sorted by their first, cover."""
    start = F.struct(F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(
            F.greatest(a["done"], s["last"]).alias("done"),
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["last"] - F.greatest(a["done"], s["first"]))).alias("n"),
        ),
        lambda a: a["n"],
    )


def contaminated(hits: str = "hits", least: int = 2) -> Column:
    """Whether a document holds windows of ``least`` items or more."""
    return F.size(F.col(f"{hits}.items")) >= least
