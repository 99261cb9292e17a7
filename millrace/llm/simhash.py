"""SimHash near-duplicates by bit-sliced comparison (operator 4).

A fingerprint has bit i set when over half of a document's shingle hashes
have it set. Two fingerprints link at ``radius`` or fewer differing bits;
documents reachable from each other form a component, named by its smallest
``doc_id``.

* Copies share a fingerprint, so only distinct fingerprints are compared, each
  standing for all its documents (hot groups of copies shrink to one row).
* The 64 bits fall into ``radius + 2`` blocks. Fingerprints within the radius
  agree on two whole blocks at least, so each goes to one bucket for every
  pair of blocks, keyed by those 25 or 26 bits.
* Buckets, small and large, are compared in one way: a stretch of them is
  stored as vertical bit planes, one machine word holding one bit of 64
  fingerprints; the planes are laid over themselves at every distance that
  some bucket reaches; carry-save counters count the differing bits of 64
  pairs at once; a block of 64 pairs is abandoned as soon as all of them have
  passed the radius or stand in different buckets.
* No task compares a bucket of over ``HOT_BUCKET`` fingerprints: its rows are
  dealt again by two blocks of the bits it leaves open, as often as needed, so
  that the limit holds at every size of the corpus. Buckets with a thousandth
  of all rows are dealt again before they meet.
* A bucket yields links that span it (a forest, not all pairs), and components
  come from alternating large-star and small-star rounds over tables in the
  shared folder. Nothing that follows the corpus reaches the driver.

Cases: a null text, or one without words, has fingerprint zero and links like
any other; fewer words than a shingle make one shingle of all; a text of any
length is read whole, in one pass, with memory in proportion to it; a null
``doc_id`` gets a fingerprint, a null component, and links nothing; repeated
rows stay repeated; an empty table gives no rows. Other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, materialize, run_starts, shuffle_partitions

#: No bucket of more fingerprints is compared: it is dealt again.
HOT_BUCKET = 4096
#: A bucket that agrees on this many bits has 4096 fingerprints at most, and is compared.
_FIXED = 52
#: Rows laid into planes at once, and blocks of 64 pairs counted at once.
_STRETCH, _BLOCKS = 1 << 15, 1 << 14


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text, as an unsigned integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    low = b" ".join(words)
    # Shingles are slices of the joined words: each begins at a word and ends at one.
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    h = np.fromiter((digest(low[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, n)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, counted a byte column at a time."""
    n, counts = len(h), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = np.ascontiguousarray(h[i : i + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for at in range(0, rb.num_rows, 512):
            part = rb.slice(at, 512)
            out = np.array([fingerprint(t, shingle) for t in part["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint's bits as a long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


# --- bit-sliced comparison ---------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 planes: plane i holds bit i of all fingerprints, 64 lanes a word."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    lanes[:, : len(fps)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


class Counters:
    """Distances of many blocks of 64 pairs at once, counted by carry-save adders.

    They begin where the radius, and one more, make the last carry: a pair
    whose carry has come out is beyond the radius.
    """

    def __init__(self, blocks: int, radius: int) -> None:
        width = radius.bit_length()
        begin = (1 << width) - 1 - radius
        self.sums = [np.full(blocks, np.uint64(((1 << 64) - 1) * (begin >> k & 1))) for k in range(width)]
        self.over = np.zeros(blocks, np.uint64)

    def add(self, differ: np.ndarray) -> None:
        """One more bit position: a set bit where the two of a pair differ."""
        for k, s in enumerate(self.sums):
            self.sums[k], differ = s ^ differ, s & differ
        self.over |= differ

    def keep(self, at: np.ndarray) -> None:
        """Go on with the blocks at these places alone."""
        self.sums, self.over = [s[at] for s in self.sums], self.over[at]


def close_pairs(fps: np.ndarray, room: np.ndarray, radius: int, last: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All positions (i, j), i < j <= i + room[i], that differ in ``radius`` bits or fewer.

    ``room`` says how far each row's partners reach. The bits of the mask
    ``last`` are counted last, as the rows of a bucket agree on them.
    """
    n = len(fps)
    if not n or not room.any():
        return
    planes = bit_planes(fps)
    words = planes.shape[1]
    order = sorted(range(64), key=lambda i: last >> i & 1)
    reach = np.zeros(words * 64, np.int64)
    reach[:n] = room
    reach = reach.reshape(words, 64)
    deepest = reach.max(axis=1)
    for q in range(int(deepest.max()) // 64 + 1):
        # The planes moved by 64 q + s lanes; words beyond the end hold no lanes.
        shift = np.arange(64, dtype=np.uint64)
        far = 64 * q + np.arange(64)
        far[far == 0] = 1 << 40
        moved = np.zeros((64, words + 1), np.uint64)
        moved[:, : words - q] = planes[:, q:]
        active = np.flatnonzero(deepest >= max(1, 64 * q))
        for at in range(0, len(active), _BLOCKS // 64):
            some = active[at : at + _BLOCKS // 64]
            live = np.packbits(reach[some][None] >= far[:, None, None], axis=2, bitorder="little").view("<u8")[:, :, 0]
            s, w = np.nonzero(live)
            if not len(s):
                continue
            live, word, s = live[s, w], some[w], shift[s]
            counters = Counters(len(s), radius)
            for k, i in enumerate(order):
                plane, other = planes[i], moved[i]
                there = (other[word] >> s) | (other[word + 1] << (np.uint64(63) - s) << np.uint64(1))
                counters.add(plane[word] ^ there)
                if k % 6 == 5 or k == 63:  # abandon the blocks whose pairs are all too far
                    on = np.flatnonzero(live & ~counters.over)
                    if len(on) < len(s):
                        live, word, s = live[on], word[on], s[on]
                        counters.keep(on)
                    if not len(s):
                        break
            if len(s):
                near = (live & ~counters.over).view(np.uint8).reshape(-1, 8)
                block, lane = np.nonzero(np.unpackbits(near, axis=1, bitorder="little"))
                i = word[block] * 64 + lane
                yield i, i + 64 * q + s[block].astype(np.int64)


def spanning_links(fps: np.ndarray, room: np.ndarray, radius: int, last: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs within the radius that connect all that any pairs connect."""
    root = np.arange(len(fps))
    out_a: list[int] = []
    out_b: list[int] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in close_pairs(fps, room, radius, last):
        while not np.array_equal(flat := root[root], root):
            root[:] = flat
        # Of the pairs that would join the same two trees, one is enough.
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        new = np.flatnonzero(low != high)
        new = new[np.unique(low[new] * len(fps) + high[new], return_index=True)[1]]
        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                out_a.append(x)
                out_b.append(y)
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def _blocks(bits: list[int], k: int) -> list[int]:
    """``k`` masks of near-equal width that share out the given bits."""
    edges = [round(len(bits) * i / k) for i in range(k + 1)]
    return [sum(1 << bit for bit in bits[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _refined(mask: int, radius: int) -> list[int]:
    """The mask with each pair of the ``radius + 2`` blocks of the bits it leaves open."""
    left = [i for i in range(64) if not mask >> i & 1]
    return [mask | a | b for a, b in combinations(_blocks(left, radius + 2), 2)]


_DEALT = "mask long, bucket long, fp long, node long"
#: A link (kind 0: u and v) or a row to be dealt once more (kind 1).
_FOUND = "kind int, u long, v long, " + _DEALT


def _signed(mask: int) -> np.int64:
    return np.uint64(mask).view(np.int64)


def _rows(mask: int, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(fp), _signed(mask))), pa.array((fp & np.uint64(mask)).view(np.int64)), pa.array(fp.view(np.int64)), pa.array(node)],
        names=["mask", "bucket", "fp", "node"],
    )


def _deal(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """A row for each pair of blocks of each fingerprint."""
    masks = _refined(0, radius)
    for rb in batches:
        fp, node = rb["fp"].to_numpy().view(np.uint64), rb["node"].to_numpy()
        for mask in masks:
            yield _rows(mask, fp, node)


def _again(mask: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows of buckets that are too large, dealt by two blocks of their open bits as well."""
    for m in np.unique(mask).tolist():
        at = mask == m
        for finer in _refined(m & ((1 << 64) - 1), radius):
            yield _rows(finer, fp[at], node[at])


def _deal_again(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        hot = rb["hot"].to_numpy(zero_copy_only=False)
        yield rb.filter(pa.array(~hot)).drop_columns(["hot"])
        if hot.any():
            part = rb.filter(pa.array(hot))
            yield from _again(part["mask"].to_numpy(), part["fp"].to_numpy().view(np.uint64), part["node"].to_numpy(), radius)


def _linked(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(u), np.int32)), pa.array(u), pa.array(v), none, none, none, none], names=[x.split()[0] for x in _FOUND.split(", ")])


def _redealt(rb: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(rb.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.ones(rb.num_rows, np.int32)), none, none, *rb.columns], names=[x.split()[0] for x in _FOUND.split(", ")])


def _compare(batches: Iterable[pa.RecordBatch], radius: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets; rows come sorted by mask and bucket, and a bucket may cross batches.

    Holds a stretch of whole buckets, each of at most ``most`` rows; rows of
    larger ones are sent on as they come, to be dealt again.
    """
    rest = [np.empty(0, np.int64)] * 4
    hot: tuple[int, int] | None = None

    def settle(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        mask, bucket, fp, node = cols
        new = np.ones(len(mask), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(mask)))
        n, end = np.repeat(size, size), np.repeat(at + size, size)
        large = (n > most) & (np.bitwise_count(mask.view(np.uint64)) < _FIXED)
        if large.any():
            for rb in _again(mask[large], fp[large].view(np.uint64), node[large], radius):
                yield _redealt(rb)
        pick = np.flatnonzero((n > 1) & ~large)
        room = (end - 1 - np.arange(len(mask)))[pick]  # buckets are whole, so picked rows stay neighbours
        mask, fp, node = mask[pick], fp[pick].view(np.uint64), node[pick]
        ends = np.append(run_starts(mask), len(mask))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            x, y = spanning_links(fp[a:b], room[a:b], radius, int(mask[a]) & ((1 << 64) - 1))
            if len(x):
                yield _linked(node[a:b][x], node[a:b][y])

    for rb in batches:
        cols = [rb[c].to_numpy() for c in ("mask", "bucket", "fp", "node")]
        if hot is not None:  # what still belongs to a bucket known to be too large
            same = (cols[0] == hot[0]) & (cols[1] == hot[1])
            for part in _again(cols[0][same], cols[2][same].view(np.uint64), cols[3][same], radius):
                yield _redealt(part)
            cols = [c[~same] for c in cols]
        rest = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if len(rest[0]) < _STRETCH:
            continue
        open_ = (rest[0] == rest[0][-1]) & (rest[1] == rest[1][-1])
        start = len(open_) - int(open_.sum())
        hot = None
        if len(open_) - start > most and (int(rest[0][-1]) & ((1 << 64) - 1)).bit_count() < _FIXED:
            hot, start = (rest[0][-1], rest[1][-1]), len(open_)
        yield from settle([c[:start] for c in rest])
        rest = [c[start:] for c in rest]
    yield from settle(rest)


def links(nodes: DataFrame, radius: int = 3, *, most: int | None = None) -> DataFrame:
    """Links (u, v) among distinct fingerprints ``nodes`` (fp, node) that span their components."""
    if not 0 <= radius <= 8:
        raise ValueError("the fingerprints are cut for a radius of 0 to 8")
    most = most or HOT_BUCKET
    parts = shuffle_partitions(nodes.sparkSession)
    dealt = nodes.select("fp", "node").mapInArrow(partial(_deal, radius=radius), _DEALT)
    rows = nodes.count() * (radius + 2) * (radius + 1) // 2
    found = None
    while True:
        # At most a thousand buckets can hold a thousandth of the rows, so those are broadcast.
        hot = dealt.groupBy("mask", "bucket").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= max(most + 1, rows // 1000)) & (F.bit_count("mask") < _FIXED))
        hot = materialize(hot.select("mask", "bucket", F.lit(True).alias("hot")), "hot-buckets")
        dealt = dealt.join(F.broadcast(hot), ["mask", "bucket"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        dealt = dealt.mapInArrow(partial(_deal_again, radius=radius), _DEALT)
        dealt = dealt.repartition(parts, "mask", "bucket").sortWithinPartitions("mask", "bucket")
        step = materialize(dealt.mapInArrow(partial(_compare, radius=radius, most=most), _FOUND), "links")
        pairs = step.where("kind = 0").select("u", "v")
        found = pairs if found is None else found.unionByName(pairs)
        # Each time, two fifths of a bucket's open bits are fixed: a few rounds leave none too large.
        dealt = step.where("kind = 1").select("mask", "bucket", "fp", "node")
        rows = dealt.count()
        if not rows:
            return found.distinct()


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """node and ``root`` (its component's least node) of every node that has an edge.

    Alternates two stars. Large: a node's greater neighbours move to its least
    neighbour. Small: its lesser neighbours do. Each is an aggregation with
    map-side combine and a look-up in which hot nodes are broadcast; each
    round's edges are a table in the shared folder.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    spread = F.xxhash64("u", "v")
    for _ in range(rounds):
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = lookup(both, least, "u", "n", spread, total=2 * n)
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, before = materialize(large, "edges"), edges
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = lookup(large, least, "u", "n", spread, total=max(1, n))
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        kept = least.select("u", F.col("m").alias("v"))
        after = materialize(moved.unionByName(kept).distinct(), "edges")
        # Done when every edge points from a node to a root that points nowhere.
        heads = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        busy = after.join(heads.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        forked = heads.where("n > 1").limit(1).count()
        edges = after
        discard(before, large)
        if not busy and not forked:
            roots = edges.select("v").distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
            )
    raise RuntimeError(f"components haven't settled in {rounds} rounds")


def near_duplicates(docs: DataFrame, *, radius: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(
        rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")),
        "nodes",
    )
    known = components(links(nodes, radius))
    named = nodes.join(known, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("component"))
    total = rows.count()
    met = lookup(rows, named, "fp", "n", F.xxhash64("doc_id", "fp"), total=total)
    return met.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )
