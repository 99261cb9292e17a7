"""Removal of repeated passages by De Bruijn compaction (operator 9).

Nodes are runs of ``size - 1`` words, edges runs of ``size`` (a window). An
edge walked twice or more is repeated; every walk but the earliest (smaller
``doc_id``, then earlier start) is to go.

* Edges are dealt out by minimizer, the least hash among a window's runs of
  ``seed`` words. Consecutive windows with one minimizer travel as one row;
  equal windows always meet, as they have equal minimizers. Before that, each
  batch of documents settles its own repeats, so a passage that a third of all
  documents hold sends one row a batch, not one a copy; the row says so.
* Where rows meet, the edges of a group are ordered by source coordinates. Runs
  of repeated edges leave as pieces: a walk (document, first and last start),
  the source it repeats (document, first start), and its first and last edge.
  A piece ends where its source does not go on with it, and where walks that
  share an edge go on to, or came from, different ones.
* A slot of over ``MOST_HELD`` bytes is not compared in one task: its windows
  are dealt again by their own hashes, so that a seed which many windows share
  is spread.
* A join of pieces that end where another begins gives the passages through
  nodes between them; counted, they are each node's in and out degree. Joined
  back, nodes of in and out degree one, at which the source goes on too, are
  compacted: their pieces become one path. A piece never hides a branch, since
  all walks of an edge meet where it is dealt to.
* Paths come home by document, and so do the source coordinates that they name.
  Both sides' words are read and digested; a path whose words are not its
  source's means that two different windows shared 120 hash bits (64 of the
  minimizer, 56 of the window), and all is done again with other hashes.

Cases: a null text has no words; documents of fewer than ``size`` words keep
all; a text of any length is read whole, its windows being dealt out in rows;
of rows that repeat a ``doc_id`` the one with the lesser text hash is the
earlier, and of identical rows one keeps its words; a null ``doc_id`` comes
before all others; an empty table gives no rows. Other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lookup, materialize, pair_hash, run_starts, window_hashes

_ROWS = "slot int, blob binary"
_PIECES = "doc long, sub long, first int, last int, s_doc long, s_sub long, s_first int, e_first long, e_last long"
_LOW56 = np.uint64((1 << 56) - 1)
#: A piece, or (slot and blob) rows of a slot that was too large, to be dealt again.
_MET = _PIECES + ", slot int, blob binary"
#: Bytes of a slot that a task holds to compare; the windows of a larger one are dealt again, one by one.
MOST_HELD = 64 << 20
#: Windows settled at once in a batch; bounds a task's memory.
BATCH_WINDOWS = 1_000_000


class _WordHashes(dict):
    """64-bit hashes of words under a salt, kept for the words seen of late."""

    def __init__(self, salt: int) -> None:
        self.salt = salt

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.salt)
        return h


_HASHES: dict[int, _WordHashes] = {}


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text; bytes.split() ends words at the same six characters."""
    return text.split()


def _minimizers(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The least seed hash inside each window."""
    low = window_hashes(words, seed)
    reach, width = size - seed + 1, 1
    while width * 2 <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < reach:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    return low


def _groups(h: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows in which equal ones are neighbours, ranked, and where each group begins."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (m[order[1:]] != m[order[:-1]])
    return order, np.flatnonzero(new)


class _Batch:
    """Documents whose windows are settled together."""

    def __init__(self) -> None:
        self.words: list[np.ndarray] = []
        self.docs: list[tuple[int, int]] = []
        self.seen: set[tuple[int, int]] = set()
        self.size = 0


_HEAD = np.dtype([("minimizer", "<u8"), ("doc", "<i8"), ("sub", "<i8"), ("start", "<i4"), ("n", "<i4")])
_PIECE = np.dtype([(x.split()[0], "<i8" if x.split()[1] == "long" else "<i4") for x in _PIECES.split(", ")])


def _sliced(x: np.ndarray) -> bytes:
    """A column as bytes, the lowest byte of every value first: what hardly changes stands together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def pack_rows(head: np.ndarray, hashes: np.ndarray) -> bytes:
    """Rows of one slot as bytes: the columns in turn, compressed, then 7 bytes a window."""
    low = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :7])
    columns = [np.diff(head[c], prepend=head[c].dtype.type(0)) if c == "doc" else np.ascontiguousarray(head[c]) for c in _HEAD.names]
    raw = pa.compress(b"".join(map(_sliced, columns)), codec="zstd", asbytes=True)
    return len(head).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw + low.tobytes() if len(head) else b""


def unpack_rows(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of :func:`pack_rows`."""
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8 : 8 + size], n * _HEAD.itemsize, codec="zstd", asbytes=True), np.uint8)
    head, at = np.empty(n, _HEAD), 0
    for c in _HEAD.names:
        kind = _HEAD[c]
        head[c] = np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(-1, n).T).view(kind).ravel()
        at += n * kind.itemsize
    head["doc"] = np.cumsum(head["doc"])
    low = np.frombuffer(blob, np.uint8, offset=8 + size).reshape(-1, 7)
    hashes = np.zeros((len(low), 8), np.uint8)
    hashes[:, :7] = low
    return head, hashes.view("<u8").ravel()


def _pieces(
    entries: np.ndarray, begins: np.ndarray, doc: np.ndarray, sub: np.ndarray, start: np.ndarray, src: np.ndarray, key: np.ndarray
) -> np.ndarray:
    """Runs of entries as pieces; ``begins`` marks the entries that open one."""
    at = np.flatnonzero(begins[entries])
    a, b = entries[at], entries[np.append(at[1:], len(entries)) - 1]
    out = np.empty(len(a), _PIECE)
    out["doc"], out["sub"], out["first"], out["last"] = doc[a], sub[a], start[a], start[b] + 1
    out["s_doc"], out["s_sub"], out["s_first"] = doc[src[a]], sub[src[a]], start[src[a]]
    out["e_first"], out["e_last"] = key[a].view(np.int64), key[b].view(np.int64)
    return out


def _settle(batch: _Batch, size: int, seed: int, slots: int) -> Iterator[tuple[int, bytes]]:
    """Send a batch's windows: first walks as rows to be compared, later ones as pieces with their source."""
    rank = sorted(range(len(batch.docs)), key=lambda i: batch.docs[i])
    docs = np.array([batch.docs[i] for i in rank], np.int64).reshape(-1, 2)
    hashes, minimizers, counts = [], [], []
    for i in rank:
        w = batch.words[i]
        hashes.append(window_hashes(w, size) & _LOW56)
        minimizers.append(_minimizers(w, size, seed))
        counts.append(len(hashes[-1]))
    if not counts:
        return
    h, m = np.concatenate(hashes), np.concatenate(minimizers)
    count = np.array(counts)
    doc = np.repeat(np.arange(len(counts)), count)
    start = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
    order, at = _groups(h, m)
    many = np.diff(np.append(at, len(h)))
    src = np.empty(len(h), np.int64)
    src[order] = np.repeat(order[at], many)
    later = src != np.arange(len(h))
    twice = np.zeros(len(h), bool)
    twice[order] = np.repeat(many > 1, many)
    apart = np.ones(len(h), bool)
    apart[1:] = doc[1:] != doc[:-1]
    if later.any():
        begins = apart.copy()
        begins[1:] |= (later[1:] != later[:-1]) | (src[1:] != src[:-1] + 1) | (doc[src[1:]] != doc[src[:-1]])
        known = np.flatnonzero(later)
        yield -1, _pieces(known, begins, docs[doc, 0], docs[doc, 1], start, src, pair_hash(m, h)).tobytes()
    # A row is a run of first walks of one document with one minimizer, all found again here (n is negative) or none.
    begins = apart
    begins[1:] |= (m[1:] != m[:-1]) | (later[1:] != later[:-1]) | (twice[1:] != twice[:-1])
    at = np.flatnonzero(begins)
    n = np.diff(np.append(at, len(h)))
    head = np.empty(len(at), _HEAD)
    head["minimizer"], head["start"], head["n"] = m[at], start[at], np.where(twice[at], -n, n)
    head["doc"], head["sub"] = docs[doc[at], 0], docs[doc[at], 1]
    slot = (head["minimizer"] >> np.uint64(20)) % np.uint64(slots)
    pick = np.flatnonzero(~later[at])
    pick = pick[np.argsort(slot[pick], kind="stable")]
    s = slot[pick]
    ends = np.append(run_starts(s), len(s))
    cum = np.concatenate(([0], np.cumsum(n[pick])))
    row = np.repeat(at[pick] - cum[:-1], n[pick]) + np.arange(cum[-1])
    flat, rows = h[row], head[pick]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield int(s[a]), pack_rows(rows[a:b], flat[cum[a] : cum[b]])


def _edges(batches: Iterable[pa.RecordBatch], size: int, seed: int, slots: int, salt: int) -> Iterator[pa.RecordBatch]:
    def send(batch: _Batch) -> Iterator[pa.RecordBatch]:
        got = list(_settle(batch, size, seed, slots))
        for i in range(0, len(got), 500):
            some = got[i : i + 500]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in some], pa.int32()), pa.array([b for _, b in some], pa.binary())],
                names=["slot", "blob"],
            )

    batch = _Batch()
    hashes = _HASHES.setdefault(salt, _WordHashes(salt)).__getitem__
    for rb in batches:
        for at in range(0, rb.num_rows, 256):
            part = rb.slice(at, 256)
            for doc, sub, text in zip(*(part[c].to_pylist() for c in ("doc", "sub", "text")), strict=True):
                w = words_of(text)
                if len(w) < size or (doc, sub) in batch.seen:
                    continue
                batch.seen.add((doc, sub))
                batch.words.append(np.fromiter(map(hashes, w), np.uint64, len(w)))
                batch.docs.append((doc, sub))
                batch.size += len(w)
                if batch.size >= BATCH_WINDOWS:
                    yield from send(batch)
                    batch = _Batch()
    yield from send(batch)


def _uneven(value: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks the entries of groups whose entries have more than one value."""
    many = np.diff(np.append(at, len(order)))
    v = value[order]
    other = np.logical_or.reduceat(v != np.repeat(v[at], many), at)
    out = np.zeros(len(value), bool)
    out[order] = np.repeat(other, many)
    return out


def _compared(got: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The pieces of repeated edges among the rows of a slot."""
    head, flat = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    n = np.abs(head["n"].astype(np.int64))
    begin = np.cumsum(n) - n
    # Only minimizers that came twice can hold a repeated window, besides those found by a batch.
    by = np.argsort(head["minimizer"], kind="stable")
    m = head["minimizer"][by]
    twice = np.zeros(len(m), bool)
    same = m[1:] == m[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    rows = by[twice | (head["n"][by] < 0)]
    if not len(rows):
        return np.empty(0, _PIECE)
    rows = rows[np.lexsort((head["start"][rows], head["sub"][rows], head["doc"][rows]))]
    rn = n[rows]
    total = np.cumsum(rn)
    window = np.repeat(begin[rows] - (total - rn), rn) + np.arange(total[-1])
    row = np.repeat(rows, rn)
    doc, sub, start = head["doc"][row], head["sub"][row], head["start"][row] + (window - begin[row])
    h, m = flat[window], head["minimizer"][row]
    order, at = _groups(h, m)
    many = np.diff(np.append(at, len(h)))
    src = np.empty(len(h), np.int64)
    src[order] = np.repeat(order[at], many)
    later = (doc != doc[src]) | (sub != sub[src]) | (start != start[src])
    repeated = np.zeros(len(h), bool)
    repeated[order] = np.repeat(np.logical_or.reduceat((later | (head["n"][row] < 0))[order], at), many)
    if not repeated.any():
        return np.empty(0, _PIECE)
    key = pair_hash(m, h)
    follows = np.zeros(len(h), bool)
    follows[1:] = row[1:] == row[:-1]
    after, before = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    after[:-1][follows[1:]] = key[1:][follows[1:]]
    before[1:][follows[1:]] = key[:-1][follows[1:]]
    begins = ~follows | _uneven(before, order, at)
    begins[1:] |= _uneven(after, order, at)[:-1] | (repeated[1:] != repeated[:-1]) | (later[1:] != later[:-1])
    begins[1:] |= (doc[src[1:]] != doc[src[:-1]]) | (sub[src[1:]] != sub[src[:-1]]) | (start[src[1:]] != start[src[:-1]] + 1)
    return _pieces(np.flatnonzero(repeated), begins, doc, sub, start, src, key)


def _apart(blob: bytes, slots: int) -> Iterator[tuple[int, bytes]]:
    """The rows of a slot as rows of one window each, dealt by the window's own hash."""
    head, flat = unpack_rows(blob)
    n = np.abs(head["n"].astype(np.int64))
    row = np.repeat(np.arange(len(head)), n)
    one = head[row]
    one["start"] += (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    one["n"] = np.where(head["n"][row] < 0, -1, 1)
    slot = pair_hash(flat, one["minimizer"].copy()) % np.uint64(slots)
    order = np.argsort(slot, kind="stable")
    ends = np.append(run_starts(slot[order]), len(order))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        at = order[a:b]
        yield int(slot[at[0]]), pack_rows(one[at], flat[at])


def _meet(batches: Iterable[pa.RecordBatch], most: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Compare the rows of each slot; slots come sorted, one at a time is held, of at most ``most`` bytes."""
    names = [x.split()[0] for x in _MET.split(", ")]
    held: list[bytes] = []
    slot, size = None, 0

    def sent(pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(pieces), 1 << 16):
            part = pieces[i : i + (1 << 16)]
            columns = [pa.array(np.ascontiguousarray(part[c])) for c in _PIECE.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary())], names=names)

    def again(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        for blob in blobs:
            got = list(_apart(blob, slots))
            none = [pa.nulls(len(got), pa.int32() if _PIECE[c].itemsize == 4 else pa.int64()) for c in _PIECE.names]
            yield pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=names)

    for batch in batches:
        for i, s in enumerate(batch["slot"].to_pylist()):
            blob = batch["blob"][i].as_py()
            if s < 0:
                yield from sent(np.frombuffer(blob, _PIECE))
                continue
            if s != slot:
                if held:
                    yield from sent(_compared([unpack_rows(b) for b in held]))
                slot, size, held = s, 0, []
            size += len(blob)
            held.append(blob)
            if size > most:  # this slot's rows are sent on, those that come yet too
                yield from again(held)
                held = []
    if held:
        yield from sent(_compared([unpack_rows(b) for b in held]))


def _sources(docs: DataFrame) -> DataFrame:
    """doc_id, its rank ``doc``, what tells rows with one rank apart (``sub``), and text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    if not rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return rows.withColumn("sub", F.lit(0).cast("long"))
    # 63 bits of the text's hash; below all others where there is no id.
    low = F.shiftrightunsigned(F.xxhash64("text"), 1)
    return rows.withColumn("sub", F.when(F.col("doc_id").isNull(), low - F.lit((1 << 63) - 1) - 1).otherwise(low))


def repeated_pieces(
    sources: DataFrame, *, size: int = 20, seed: int = 8, slots: int | None = None, salt: int = 7, most: int | None = None
) -> DataFrame:
    """All walks of repeated edges, the earliest too, as pieces (see the module's text), in a table."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = slots or 16 * parts
    rows = sources.where("text is not null").select("doc", "sub", F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(partial(_edges, size=size, seed=seed, slots=slots, salt=salt), _ROWS)
    # What a batch has found itself needs no partner: it is dealt out evenly.
    deal = F.when(F.col("slot") >= 0, F.col("slot")).otherwise(F.xxhash64("blob"))
    rows = rows.withColumn("deal", deal.cast("long")).repartition(parts, "deal").sortWithinPartitions("slot")
    meet = partial(_meet, most=most or MOST_HELD, slots=64 * parts)
    met = materialize(rows.select("slot", "blob").mapInArrow(meet, _MET), "pieces")
    pieces = met.where("slot is null").drop("slot", "blob")
    if met.where("slot is not null").limit(1).isEmpty():
        return pieces
    # A seed that very many windows share: dealt by their own hashes, only equal ones stay together.
    hot = met.where("slot is not null").select("slot", "blob").repartition(parts, "slot").sortWithinPartitions("slot")
    more = materialize(hot.mapInArrow(partial(meet, most=1 << 62), _MET), "pieces").drop("slot", "blob")
    return pieces.unionByName(more)


def nodes_of(pieces: DataFrame) -> DataFrame:
    """The passages between pieces: edge ``e``, the edge ``f`` after it, its walks, and the node's degrees."""
    ends = pieces.select("doc", "sub", F.col("last").alias("at"), F.col("e_last").alias("e"))
    heads = pieces.select("doc", "sub", F.col("first").alias("at"), F.col("e_first").alias("f"))
    passages = ends.join(heads, ["doc", "sub", "at"]).groupBy("e", "f").agg(F.count(F.lit(1)).alias("walks"))
    passages = materialize(passages, "passages")
    out_degree = passages.groupBy("e").agg(F.count(F.lit(1)).alias("out_degree"))
    in_degree = passages.groupBy("f").agg(F.count(F.lit(1)).alias("in_degree"))
    return passages.join(out_degree, "e").join(in_degree, "f")


def paths_of(pieces: DataFrame) -> DataFrame:
    """The later walks, compacted: doc, sub, first, last, s_doc, s_sub, s_first of every path."""
    plain = nodes_of(pieces).where("in_degree = 1 and out_degree = 1")
    plain = materialize(plain.select(F.xxhash64("e", "f").alias("node"), "walks", F.lit(True).alias("plain")), "nodes")
    total = plain.agg(F.sum("walks")).first()[0] or 0
    later = pieces.where("not (doc = s_doc and sub = s_sub and first = s_first)")
    along = Window.partitionBy("doc", "sub").orderBy("first")
    before = F.lag(F.struct("first", "last", "s_doc", "s_sub", "s_first", "e_last")).over(along)
    goes_on = (
        (F.col("p.last") == F.col("first"))
        & (F.col("p.s_doc") == F.col("s_doc"))
        & (F.col("p.s_sub") == F.col("s_sub"))
        & (F.col("p.s_first") + F.col("p.last") - F.col("p.first") == F.col("s_first"))
    )
    rows = later.withColumn("p", before).withColumn("node", F.when(goes_on, F.xxhash64("p.e_last", "e_first")))
    rows = rows.select("doc", "sub", "first", "last", "s_doc", "s_sub", "s_first", "node")
    met = lookup(rows, plain, "node", "walks", F.xxhash64("doc", "sub", "first"), total=total)
    path = F.sum(F.when(F.col("plain"), 0).otherwise(1)).over(along)
    met = met.withColumn("path", path).groupBy("doc", "sub", "path")
    source = F.min_by(F.struct("s_doc", "s_sub", "s_first"), "first").alias("s")
    return met.agg(F.min("first").alias("first"), F.max("last").alias("last"), source).select("doc", "sub", "first", "last", "s.*")


def _squeezed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their way: a length and the zstd bytes; null stays null."""
    for rb in batches:
        for at in range(0, rb.num_rows, 256):
            part = rb.slice(at, 256)
            out = [None if t is None else len(t).to_bytes(4, "little") + (pa.compress(t, codec="zstd", asbytes=True) if t else b"") for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in ("doc_id", "doc", "sub")), pa.array(out, pa.binary())], names=["doc_id", "doc", "sub", "text"])


def _text(data: bytes | None) -> bytes:
    n = int.from_bytes(data[:4], "little") if data else 0
    return pa.decompress(data[4:], n, codec="zstd", asbytes=True) if n else b""


#: A document's result, or (kind 1) the digest of the words that a path or its source holds.
_CUT = "kind int, doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, span long, digest long"


def _cut(batches: Iterable[pa.RecordBatch], size: int, texts: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _CUT.split(", ")]
    for rb in batches:
        for at in range(0, rb.num_rows, 256):
            part = rb.slice(at, 256)
            n_words, n_removed, kept, spans_, digests = [], [], [], [], []
            for data, spans, rank in zip(*(part[c].to_pylist() for c in ("text", "spans", "copy")), strict=True):
                w = words_of(_text(data))
                pairs = []
                for x in spans or ():
                    a, b = x["first"], x["last"] + size - 1
                    spans_.append(x["span"])
                    digests.append(int.from_bytes(hashlib.blake2b(b" ".join(w[a:b]), digest_size=8).digest(), "little", signed=True))
                    if x["own"]:
                        pairs.append((a, b))
                if rank and len(w) >= size:
                    pairs = [(0, len(w))]
                out: list[bytes] = []
                done = 0
                for a, b in sorted(pairs):
                    if a > done:
                        out += w[done:a]
                    done = max(done, b)
                out += w[done:]
                n_words.append(len(w))
                n_removed.append(len(w) - len(out))
                kept.append(b" ".join(out))
            k, d = len(kept), len(digests)
            columns = [
                pa.array([0] * k + [1] * d, pa.int32()),
                pa.concat_arrays([part["doc_id"], pa.nulls(d, pa.int64())]),
                pa.array(n_words + [None] * d, pa.int64()),
                pa.array(n_removed + [None] * d, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept] + [None] * d, pa.string()),
                pa.array([x.decode() for x in kept] + [None] * d if texts else [None] * (k + d), pa.string()),
                pa.array([None] * k + spans_, pa.int64()),
                pa.array([None] * k + digests, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _home(sources: DataFrame, paths: DataFrame, size: int, texts: bool) -> DataFrame:
    """Each document with what is cut from it, and digests of its own paths and of what others name it for."""
    span = F.xxhash64("s_doc", "s_sub", "s_first", F.col("last") - F.col("first")).alias("span")
    own = paths.select("doc", "sub", "first", "last", span, F.lit(True).alias("own"))
    end = (F.col("s_first") + F.col("last") - F.col("first")).alias("last")
    named = paths.select(F.col("s_doc").alias("doc"), F.col("s_sub").alias("sub"), F.col("s_first").alias("first"), end, span, F.lit(False).alias("own")).distinct()
    spans = own.unionByName(named).groupBy("doc", "sub").agg(F.collect_list(F.struct("first", "last", "span", "own")).alias("spans"))
    rows = sources.select("doc_id", "doc", "sub", F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(_squeezed, "doc_id long, doc long, sub long, text binary")
    # Identical rows are one source to their partners; among themselves, the first stays.
    same = Window.partitionBy("doc", "sub").orderBy(F.col("doc_id").asc_nulls_first())
    met = rows.join(spans, ["doc", "sub"], "left").withColumn("copy", F.row_number().over(same) - 1)
    return met.select("doc_id", "text", "spans", "copy").mapInArrow(partial(_cut, size=size, texts=texts), _CUT)


def remove_repeats(docs: DataFrame, *, size: int = 20, seed: int = 8, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every document."""
    sources = _sources(docs)
    for salt in (7, 107, 207):
        pieces = repeated_pieces(sources, size=size, seed=seed, salt=salt)
        paths = materialize(paths_of(pieces), "paths")
        out = materialize(_home(sources, paths, size, texts), "cut")
        discard(paths)
        differ = out.where("kind = 1").groupBy("span").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y")
        if not differ.limit(1).count():
            columns = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts
            return out.where("kind = 0").select(*columns)
        discard(out)
    raise RuntimeError("windows of different words share their hashes under three salts")
