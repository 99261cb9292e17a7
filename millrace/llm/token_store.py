"""Content-addressed token store (operator 7).

A document's ids, closed by an end id, are cut where a rolling hash of the
last ids says so, hence at the same places in every copy of a passage. Each
distinct chunk is stored once under its BLAKE2 address; a document is a recipe
of addresses; recipes lie in ascending ``doc_id`` order in range partitions;
Merkle trees (chunk address, recipe leaf, partition root, store root) tie them
together, and reading checks every chunk against its address and every recipe
against the roots before anything is returned.

Files below the store's folder:

``data/kind=0``  chunks: ``address``, ``n``, ``ids`` (little-endian, 2 bytes
    an id when the vocabulary allows, else 4)
``recipes``      ``doc_id``, ``pid``, ``rel_start`` (ids before it in its
    partition), ``n_tokens``, ``refs`` (address + 4-byte id count each), ``leaf``
``manifest``     per partition ``pid``, ``n_docs``, ``n_tokens``, ``root``
``root``         one row: the root over all partitions' roots

Cases: a null text is an empty one (its stream is the end id alone); a text of
any length is one stream, cut into chunks of bounded length; a null ``doc_id`` sorts first; rows that repeat a ``doc_id`` keep a stream each, in
order of their contents; an empty table gives an empty store. Other columns of
the input are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_shift, lookup, new_path, shuffle_partitions
from .tokens import encoder

#: Chunk lengths in ids: none is cut shorter, about this many on average, none is longer.
LEAST, MEAN, MOST, WINDOW = 64, 512, 4096, 16
_ENC = "kind int, slot int, address binary, n long, ids binary, doc_id long, refs binary"
#: Addresses that a task remembers, so as not to send a chunk twice.
_REMEMBERED = 1_000_000
_RECIPES = "doc_id long, pid int, rel_start long, n_tokens long, refs binary, leaf binary"


def address(data: bytes) -> bytes:
    """The 16-byte address of a chunk or node."""
    return hashlib.blake2b(data, digest_size=16).digest()


def boundaries(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last ``WINDOW`` ids asks for a cut: ends, rising."""
    if len(ids) < WINDOW:
        return np.empty(0, np.int64)
    h = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    width = 1
    while width < WINDOW:
        h = h[:-width] * np.uint32(0x85EBCA6B) + h[width:]
        width *= 2
    h ^= h >> np.uint32(16)
    h *= np.uint32(0xC2B2AE35)
    return np.flatnonzero(h < np.uint32((1 << 32) // (MEAN - LEAST))) + WINDOW


def cuts(n: int, asked: list[int]) -> list[int]:
    """The ends of the chunks of a stream of ``n`` ids, given where cuts are asked for."""
    out: list[int] = []
    last = 0
    for p in [*asked, n]:
        while p - last > MOST:
            last += MOST
            out.append(last)
        if p == n or (p - last >= LEAST and p < n):
            out.append(p)
            last = p
            if p == n:
                break
    return out


def _encode(batches: Iterable[pa.RecordBatch], path: str, end: int, slots: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    size, width = enc.dtype.itemsize, enc.dtype
    tail = np.array([end], width).tobytes()
    seen: set[bytes] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            chunks: list[tuple[bytes, int, bytes]] = []
            docs: list[bytes] = []
            lengths: list[int] = []
            streams = [ids + tail for ids in enc.encode_all(part["text"].to_pylist())]
            sizes = np.array([len(d) // size for d in streams], np.int64)
            ends = np.cumsum(sizes)
            asked = boundaries(np.frombuffer(b"".join(streams), width))
            owner = np.searchsorted(ends, asked, "left")
            inner = asked - (ends - sizes)[owner]
            whole = inner >= WINDOW  # a hash that reaches into the stream before doesn't count
            asked, owner = inner[whole].tolist(), np.searchsorted(owner[whole], np.arange(len(streams) + 1)).tolist()
            for k, data in enumerate(streams):
                refs, last = [], 0
                for e in cuts(len(data) // size, asked[owner[k] : owner[k + 1]]):
                    piece = data[last * size : e * size]
                    a = address(piece)
                    refs.append(a + (e - last).to_bytes(4, "little"))
                    if a not in seen:
                        if len(seen) >= _REMEMBERED:
                            seen.clear()
                        seen.add(a)
                        chunks.append((a, e - last, piece))
                    last = e
                docs.append(b"".join(refs))
                lengths.append(last)
            k, d = len(chunks), len(docs)
            ids = part["doc_id"].cast(pa.int64()).to_pylist()
            slot = [int.from_bytes(a[:4], "little") % slots for a, _, _ in chunks]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * k + [1] * d, pa.int32()),
                    pa.array(slot + [(i or 0) % slots for i in ids], pa.int32()),
                    pa.array([a for a, _, _ in chunks] + [None] * d, pa.binary()),
                    pa.array([n for _, n, _ in chunks] + lengths, pa.int64()),
                    pa.array([p for _, _, p in chunks] + [None] * d, pa.binary()),
                    pa.array([None] * k + ids, pa.int64()),
                    pa.array([None] * k + docs, pa.binary()),
                ],
                names=["kind", "slot", "address", "n", "ids", "doc_id", "refs"],
            )


def _once(rows: DataFrame) -> DataFrame:
    """Of chunks with one address keep one; recipes have none, and all stay."""
    before = F.lag("address").over(Window.partitionBy("kind", "slot").orderBy("address"))
    rows = rows.withColumn("before", before)
    return rows.where(F.col("address").isNull() | ~F.col("address").eqNullSafe(F.col("before"))).drop("before")


def leaf_of(doc_id: int | None, refs: bytes) -> bytes:
    """The leaf of a recipe."""
    return address(repr(doc_id).encode() + b"|" + refs)


class Tree:
    """A Merkle tree over leaves as they come; holds one node a level."""

    def __init__(self) -> None:
        self.left: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        """Append a leaf: two nodes of a level become one of the next."""
        for k, other in enumerate(self.left):
            if other is None:
                self.left[k] = node
                return
            self.left[k], node = None, address(b"\x01" + other + node)
        self.left.append(node)

    def root(self) -> bytes:
        """The root of what has come; what is left over at a level moves up as it is."""
        node = b""
        for other in self.left:
            if other is not None:
                node = address(b"\x01" + other + node) if node else other
        return node or address(b"")


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running starts within a partition and the recipes' leaves."""
    start = 0
    for batch in batches:
        n = batch["n"].to_numpy(zero_copy_only=False)
        ends = start + np.cumsum(n)
        refs = batch["refs"].to_pylist()
        ids = batch["doc_id"].to_pylist()
        leaves = list(map(leaf_of, ids, refs))
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["pid"],
                pa.array(ends - n, pa.int64()),
                batch["n"],
                batch["refs"],
                pa.array(leaves, pa.binary()),
            ],
            names=["doc_id", "pid", "rel_start", "n_tokens", "refs", "leaf"],
        )
        if len(ends):
            start = int(ends[-1])


def _recipe_parts(spark) -> int:
    """Partitions for recipes: a third of those that hold the chunks, since recipes are short."""
    return -(-shuffle_partitions(spark) // 3)


def write(docs: DataFrame, vocabulary: str, *, end: int = 0, path: str | None = None) -> str:
    """Encode ``docs`` (doc_id, text) into a new store and return its folder."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.mapInArrow(partial(_encode, path=vocabulary, end=end, slots=64 * parts), _ENC)
    rows = _once(rows.repartition(parts, "kind", "slot"))
    rows.drop("slot").write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/data")

    data = spark.read.schema(_ENC.replace("slot int, ", "")).parquet(f"{path}/data")
    recipes = data.where("kind = 1").select("doc_id", "n", "refs")
    recipes = recipes.repartitionByRange(_recipe_parts(spark), "doc_id", "refs").sortWithinPartitions("doc_id", "refs")
    recipes = recipes.withColumn("pid", F.spark_partition_id()).mapInArrow(_number, _RECIPES)
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")

    roots = _roots(spark.read.schema(_RECIPES).parquet(f"{path}/recipes"))
    roots.write.parquet(f"{path}/manifest")
    spark.createDataFrame([(_store_root(spark, path),)], "root binary").coalesce(1).write.parquet(f"{path}/root")
    return path


def _trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root over each partition's recipes, which come in order; leaves are made anew."""
    pid, tree, docs, tokens = None, Tree(), 0, 0
    out: list[tuple] = []
    for batch in batches:
        for p, i, n, refs in zip(*(batch[c].to_pylist() for c in ("pid", "doc_id", "n_tokens", "refs")), strict=True):
            if p != pid:
                if pid is not None:
                    out.append((pid, docs, tokens, tree.root()))
                pid, tree, docs, tokens = p, Tree(), 0, 0
            tree.add(leaf_of(i, refs))
            docs, tokens = docs + 1, tokens + n
    if pid is not None:
        out.append((pid, docs, tokens, tree.root()))
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
    yield pa.RecordBatch.from_arrays(columns, names=["pid", "n_docs", "n_tokens", "root"])


def _roots(recipes: DataFrame) -> DataFrame:
    """The manifest: each partition's counts and the root over its recipes in order."""
    rows = recipes.select("pid", "rel_start", "doc_id", "n_tokens", "refs")
    rows = rows.repartition(_recipe_parts(recipes.sparkSession), "pid").sortWithinPartitions("pid", "rel_start")
    return rows.mapInArrow(_trees, "pid int, n_docs long, n_tokens long, root binary")


def _store_root(spark, path: str) -> bytes:
    """The root over the manifest's partitions, of which there are fewer than shuffle partitions."""
    tree = Tree()
    for r in spark.read.parquet(f"{path}/manifest").orderBy("pid").collect():
        tree.add(address(f"{r.pid}|{r.n_docs}|{r.n_tokens}|".encode() + bytes(r.root)))
    return tree.root()


def broken(spark, path: str) -> DataFrame:
    """The partitions whose recipes no longer give the manifest's root; empty for a sound store."""
    now = _roots(spark.read.schema(_RECIPES).parquet(f"{path}/recipes"))
    now = now.select("pid", F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens"), F.col("root").alias("now"))
    kept = spark.read.parquet(f"{path}/manifest")
    return kept.join(now, "pid", "full").where("not (root <=> now and n_docs <=> docs and n_tokens <=> tokens)")


def check(spark, path: str) -> None:
    """Fail when a recipe or a root isn't what was written."""
    if bytes(spark.read.parquet(f"{path}/root").first()[0]) != _store_root(spark, path):
        raise ValueError(f"the manifest of {path} doesn't give its store root")
    bad = broken(spark, path).select("pid").limit(5).collect()
    if bad:
        raise ValueError(f"recipes of {path} don't give their roots: partitions {[r.pid for r in bad]}")


def offsets(spark, path: str) -> DataFrame:
    """``pid`` and the ids in all partitions before it; one row a partition."""
    rows = spark.read.parquet(f"{path}/manifest").select("pid", "n_tokens").orderBy("pid").collect()
    before, out = 0, []
    for r in rows:
        out.append((r.pid, before))
        before += r.n_tokens
    return spark.createDataFrame(out, "pid int, base long")


def _inspect(batches: Iterable[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    """Check each chunk against its address and take the CRC of its ids at 4 bytes each."""
    for batch in batches:
        crcs = []
        for a, data in zip(batch["address"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if address(data) != a:
                raise ValueError(f"chunk {a.hex()} doesn't match its address")
            crcs.append(zlib.crc32(np.frombuffer(data, width).astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch["address"], pa.array(crcs, pa.int64())], names=["address", "crc"])


def _spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe, with the bytes that follow it in its document."""
    for batch in batches:
        refs = batch["refs"].to_pylist()
        count = [len(r) // 20 for r in refs]
        flat = np.frombuffer(b"".join(refs), np.dtype([("address", "V16"), ("n", "<u4")]))
        n = flat["n"].astype(np.int64)
        row = np.repeat(np.arange(len(refs)), count)
        ends = np.cumsum(n)
        offsets = pa.py_buffer((16 * np.arange(len(flat) + 1, dtype=np.int32)).tobytes())
        addresses = pa.Array.from_buffers(pa.binary(), len(flat), [None, offsets, pa.py_buffer(flat["address"].tobytes())])
        total = np.array([0, *ends])[np.cumsum([0, *count])][1:]
        yield pa.RecordBatch.from_arrays(
            [
                batch["pid"].take(pa.array(row)),
                batch["rel_start"].take(pa.array(row)),
                addresses,
                pa.array(total[row] - ends if len(row) else n, pa.int64()),
                pa.array(n),
            ],
            names=["pid", "rel_start", "address", "after", "n"],
        )


def _join_crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = batch["crc"]
        if crc.null_count:
            raise ValueError("a recipe names a chunk that the store lacks")
        out = crc_shift(crc.to_numpy(), 4 * batch["after"].to_numpy())
        yield pa.RecordBatch.from_arrays(
            [batch["pid"], batch["rel_start"], batch["n"], pa.array(out.astype(np.int64))],
            names=["pid", "rel_start", "n", "part"],
        )


def digest(spark, path: str, *, wide: bool = False) -> DataFrame:
    """Read a store back: doc_id, start, n_tokens, ids_crc32 of every document.

    Roots are checked first, whole. Chunks are read, verified and reduced to
    CRCs where they lie; only
    addresses and CRCs move. A document's CRC is the XOR of its chunks' CRCs
    shifted by what follows them, which Spark aggregates in any order.
    """
    check(spark, path)
    data = spark.read.schema(_ENC.replace("slot int, ", "")).parquet(f"{path}/data").where("kind = 0")
    chunks = data.select("address", "ids").mapInArrow(partial(_inspect, width="<u4" if wide else "<u2"), "address binary, crc long")
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    refs = recipes.select("pid", "rel_start", "refs").mapInArrow(
        _spread, "pid int, rel_start long, address binary, after long, n long"
    )
    # The chunk of an empty text may stand in a third of all recipes: such ones are broadcast.
    uses = refs.groupBy("address").agg(F.count(F.lit(1)).alias("uses"))
    facts = chunks.join(uses, "address", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    total = recipes.agg(F.sum(F.length("refs")) / 20).first()[0] or 0
    apart = F.concat_ws(":", "pid", "rel_start", "after").cast("binary")
    met = lookup(refs, facts, "address", "uses", apart, total=int(total))
    parts = met.select("pid", "rel_start", "after", "n", "crc").mapInArrow(
        _join_crc, "pid int, rel_start long, n long, part long"
    )
    sums = parts.groupBy("pid", "rel_start").agg(F.bit_xor("part").alias("ids_crc32"), F.sum("n").alias("seen"))
    heads = recipes.select("doc_id", "pid", "rel_start", "n_tokens").join(
        F.broadcast(offsets(spark, path)), "pid"
    )
    out = heads.join(sums, ["pid", "rel_start"])
    whole = F.when(F.col("seen") == F.col("n_tokens"), F.col("n_tokens")).otherwise(
        F.raise_error(F.lit("a document's chunks don't add up to its length")).cast("long")
    )
    return out.select(
        "doc_id", (F.col("base") + F.col("rel_start")).alias("start"), whole.alias("n_tokens"), "ids_crc32"
    )


def read_ids(spark, path: str, *, wide: bool = False) -> DataFrame:
    """doc_id, start and ``ids`` (little-endian bytes) of every document, put together from its chunks."""
    data = spark.read.schema(_ENC.replace("slot int, ", "")).parquet(f"{path}/data")
    chunks = data.where("kind = 0").select("address", "ids")
    width = 4 if wide else 2
    at = F.explode(F.sequence(F.lit(0), (F.length("refs") / 20).cast("int") - 1))
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes").select("doc_id", "pid", "rel_start", "refs", at.alias("k"))
    recipes = recipes.withColumn("address", F.expr("substring(refs, k * 20 + 1, 16)")).drop("refs")
    grouped = recipes.join(chunks, "address").groupBy("doc_id", "pid", "rel_start").agg(
        F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts")
    )
    data_col = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    out = grouped.join(F.broadcast(offsets(spark, path)), "pid")
    out = out.select("doc_id", (F.col("base") + F.col("rel_start")).alias("start"), data_col.alias("ids"))
    return out.withColumn("n_tokens", (F.length("ids") / width).cast("long"))
