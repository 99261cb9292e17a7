"""Near copies by SimHash, bit-sliced, verified by exact Jaccard similarity.

Operator 4 for texts that are alike in four fifths of their shingles. Two
documents link when the sets of their ``shingle``-word runs have a Jaccard
similarity of ``least`` or more; documents reachable from each other form a
component. A component is represented by its smallest ``doc_id``, and of rows
that share it by the text with the least hash.

* Equal sets are one node, so hot groups of exact copies shrink to one row.
* Each node has the 64-bit SimHash of its set. At a similarity of 0.8 about 10
  bits differ, too many for blocks of bits that two fingerprints share whole,
  so nodes meet in ``BANDS`` buckets by groups of ``ROWS`` min-hashes instead.
  A pair at similarity s is missed there with probability (1 - s^ROWS)^BANDS:
  3e-6 at 0.8, less above.
* In a bucket fingerprints are compared as operator 4 does it: vertical bit
  planes, carry-save counters, blocks abandoned once all of their pairs are
  more than ``RADIUS`` bits apart. Bits differ with probability 0.15 at a
  similarity of 0.8, 0.19 in sets of five or fewer: 28 or more with a chance
  below 2e-5. Rows stand in order of size, and planes are laid over each other
  only as far as sizes allow the similarity.
* A large bucket compares neighbours in two orders first, so no node is in many
  pairs; once the links found are contracted, it compares more, and at last all
  pairs that its components leave open: a pair goes unverified only when other
  links join it already, when its fingerprints are beyond the radius, or when
  an upper bound of its similarity, from how many hashes of each set fall into
  each of ``RANGES`` ranges, is below ``least``.
* Every pair that is left is verified by the exact similarity of its two sets.

Cases: a null text, or one without words, has the empty set and equals any
other such; fewer words than a shingle make one shingle of all; a text of any
length is read whole; rows without a ``doc_id`` are not looked at; repeated
rows and ids are allowed, each row links by its own text; an empty table gives
no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, run_starts, shuffle_partitions
from .simhash import close_pairs, components, majority

BANDS, ROWS = 32, 5
#: Buckets of no more nodes propose all their pairs at once.
SMALL = 16
#: Neighbours each node of a large bucket is paired with, round by round; None is all.
FANS = (1, 4, None)
RANGES = 256
#: Rows of whole buckets compared at once.
STRETCH = 1 << 14
#: Differing bits of 64 up to which a pair is verified.
RADIUS = 28
_SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix64(_SEEDS + np.uint64(7)) | np.uint64(1)


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, sorted."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    low, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(low, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(low[a:b], 42) for a, b in pairs), np.uint64, len(words) - size + 1))


def name(h: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 7)).view(np.int64))


def bands(h: np.ndarray) -> np.ndarray:
    """The bucket of each band of min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 2048):
        np.minimum(least, ((h[i : i + 2048, None] ^ _SEEDS) * _ODD).min(axis=0, initial=np.iinfo(np.uint64).max), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS])
    return key.view(np.int64)


def mark(text: bytes | None) -> int:
    """What tells texts of one id apart: Spark's xxhash64 of the text."""
    return 42 if text is None else int(np.uint64(xxhash.xxh64_intdigest(text, 42)).view(np.int64))


def profile(h: np.ndarray) -> np.ndarray:
    """How many hashes fall into each range."""
    return np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=RANGES).astype(np.uint32)


def _sets(batches: Iterable[pa.RecordBatch], shingle: int, what: str) -> Iterator[pa.RecordBatch]:
    """With ``what`` "bands", the buckets of each text's set, else the set itself."""
    for rb in batches:
        for at in range(0, rb.num_rows, 256):
            part = rb.slice(at, 256)
            found = [shingles(t, shingle) for t in part["text"].to_pylist()]
            nodes = pa.array([name(h) for h in found], pa.int64())
            sizes = pa.array([len(h) for h in found], pa.int32())
            prints = pa.array(np.array([majority(h) if what == "bands" and len(h) else 0 for h in found], np.uint64).view(np.int64))
            marks = pa.array([mark(t) for t in part["text"].to_pylist()], pa.int64())
            if what == "bands":
                last = pa.array([bands(h).tolist() if len(h) else [] for h in found], pa.list_(pa.int64()))
            elif what == "profile":
                last = pa.array([profile(h).tobytes() for h in found], pa.binary())
            else:
                last = pa.array([h.tobytes() for h in found], pa.binary())
            yield pa.RecordBatch.from_arrays([part["doc_id"], marks, nodes, sizes, prints, last], names=["doc_id", "mark", "node", "size", "fp", what])


def _proposed(
    bucket: np.ndarray, node: np.ndarray, size: np.ndarray, fp: np.ndarray, comp: np.ndarray, fan: int | None, least: float, prof: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in one bucket whose components differ and that may be as similar; many buckets at once."""
    rank = np.unique(bucket, return_inverse=True)[1]
    large = np.bincount(rank)[rank] > SMALL if fan is not None else np.zeros(len(rank), bool)
    by_size, by_hash = np.lexsort((node, size, rank)), np.lexsort((mix64(node.view(np.uint64)), rank))
    scale = int(size.max()) + 2
    for order in (by_size, by_hash[large[by_hash]]):
        r, s = rank[order], size[order].astype(np.int64)
        room = np.searchsorted(r, r, "right") - 1 - np.arange(len(r))
        near = large[order]
        if order is by_size:  # as far as sizes allow
            far = np.minimum(np.floor(s / least + 1e-9).astype(np.int64), scale - 1)
            bound = np.searchsorted(r * scale + s, r * scale + far, "right") - 1 - np.arange(len(r))
            room = np.where(near, room, np.minimum(room, bound))
        room = np.where(near, np.minimum(room, fan or 0), room)
        for a, b in close_pairs(fp[order].view(np.uint64), room, RADIUS):
            a, b = order[a], order[b]
            ok = (comp[a] != comp[b]) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9)
            a, b = a[ok], b[ok]
            for k in range(0, len(a), 4096):
                x, y = a[k : k + 4096], b[k : k + 4096]
                if prof is not None:
                    most = np.minimum(prof[x], prof[y]).sum(axis=1, dtype=np.int64)
                    ok = most * (1 + least) >= least * (size[x].astype(np.int64) + size[y]) - 1e-6
                    x, y = x[ok], y[ok]
                if len(x):
                    yield x, y


def _propose(batches: Iterable[pa.RecordBatch], fan: int | None, least: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each bucket; rows come sorted by bucket, which may cross batches."""

    def settle(bucket: np.ndarray, node: np.ndarray, size: np.ndarray, fp: np.ndarray, comp: np.ndarray, prof: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        at = run_starts(bucket)
        many = np.repeat(np.diff(np.append(at, len(bucket))), np.diff(np.append(at, len(bucket))))
        pick = many > 1
        if not pick.any():
            return
        if prof is not None:
            prof = np.frombuffer(b"".join(prof[pick].tolist()), np.uint32).reshape(-1, RANGES)
        node, rest = node[pick], (size[pick], fp[pick], comp[pick])
        for a, b in _proposed(bucket[pick], node, *rest, fan, least, prof):
            u, v = node[a], node[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    rest: list[np.ndarray] | None = None
    for rb in batches:
        cols = [rb[c].to_numpy(zero_copy_only=False) for c in rb.schema.names]
        rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if len(rest[0]) < STRETCH:
            continue
        start = int(run_starts(rest[0])[-1])
        yield from settle(*(c[:start] for c in rest))
        rest = [c[start:] for c in rest]
    if rest is not None:
        yield from settle(*rest)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _verify(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        sets = ([np.frombuffer(x, np.uint64) for x in rb[c].to_pylist()] for c in ("a", "b"))
        ok = [similarity(a, b) >= least for a, b in zip(*sets, strict=True)]
        yield rb.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def links(docs: DataFrame, nodes: DataFrame, buckets: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame | None:
    """node and root of the nodes (node, least_id) that links join; None when there are no links."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).where("doc_id is not null")
    open_ = buckets.select("bucket", "node", "size", "fp", F.col("node").alias("comp"))
    edges, known = None, None

    def of_nodes(need: DataFrame, what: str) -> DataFrame:
        """The set, or its profile, of each of the given nodes."""
        need = nodes.join(need.hint("shuffle_hash"), "node").select("node", F.col("least_id").alias("doc_id"))
        # An id may stand for several texts: the set's own name tells which one is meant.
        found = texts.join(need.select("doc_id").distinct().hint("shuffle_hash"), "doc_id")
        found = found.mapInArrow(partial(_sets, shingle=shingle, what=what), f"doc_id long, mark long, node long, size int, fp long, {what} binary")
        found = found.join(need.hint("shuffle_hash"), ["doc_id", "node"], "left_semi").dropDuplicates(["node"])
        return materialize(found.select("node", what), what)

    for fan in FANS:
        if fan is None:
            open_ = open_.join(of_nodes(open_.select("node").distinct(), "profile").hint("shuffle_hash"), "node").select("bucket", "node", "size", "fp", "comp", "profile")
        dealt = open_.repartition(parts, "bucket").sortWithinPartitions("bucket")
        pairs = dealt.mapInArrow(partial(_propose, fan=fan, least=least), "u long, v long").distinct()
        pairs = materialize(pairs, "pairs")
        need = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        sets = of_nodes(need, "set")
        a, b = (sets.select(F.col("node").alias(k), F.col("set").alias(c)) for k, c in (("u", "a"), ("v", "b")))
        met = pairs.join(a.hint("shuffle_hash"), "u").join(b.hint("shuffle_hash"), "v").select("u", "v", "a", "b")
        found = materialize(met.mapInArrow(partial(_verify, least=least), "u long, v long"), "links")
        discard(pairs, sets)
        edges = found if edges is None else edges.unionByName(found)
        if edges.limit(1).count():
            known = components(edges)
        if fan is None:
            break
        if fan == FANS[0]:
            large = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL).select("bucket")
            open_ = materialize(buckets.join(large.hint("shuffle_hash"), "bucket"), "large")
        else:
            open_ = open_.drop("comp")
        open_ = open_.withColumn("root", F.lit(None).cast("long")) if known is None else open_.join(known.hint("shuffle_hash"), "node", "left")
        open_ = open_.select("bucket", "node", "size", "fp", F.coalesce("root", "node").alias("comp"))
        split = open_.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
        open_ = materialize(open_.join(split.hint("shuffle_hash"), "bucket"), "open")
        if not open_.limit(1).count():
            break
    return known


def representatives(docs: DataFrame, *, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The smallest doc_id of each component (``rep``), and the mark of the text it stands for."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).where("doc_id is not null")
    signed = rows.mapInArrow(partial(_sets, shingle=shingle, what="bands"), "doc_id long, mark long, node long, size int, fp long, bands array<long>")
    signed = materialize(signed, "signed")
    # Equal sets have equal bands: aggregated map-side, so a group of copies sends a row a task.
    own = signed.groupBy("node").agg(
        F.min(F.struct("doc_id", "mark")).alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")
    )
    own = materialize(own, "nodes")
    nodes = own.select("node", "first", F.col("first.doc_id").alias("least_id"))
    buckets = materialize(own.select(F.explode("bands").alias("bucket"), "node", "size", "fp"), "buckets")
    known = links(docs, nodes.drop("first"), buckets, shingle, least)
    if known is None:
        firsts = nodes.select("first")
    else:
        named = nodes.join(known.hint("shuffle_hash"), "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
        firsts = named.groupBy("root").agg(F.min("first").alias("first"))
    firsts = firsts.select(F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark")).distinct()
    out = materialize(firsts, "representatives")
    discard(signed, own, buckets)
    return out
