"""Language identification by nearest centroid (operator 10).

A text becomes a vector of the byte trigrams of its lower-cased words, hashed into ``dims``
buckets, weighted log(1 + tf) * idf and scaled to length one. Each language has
several centroids, found by spherical k-means over a bounded sample of its
rows. A text goes to the language of the centroid nearest by cosine; ``score``
is that cosine, and ``rejected`` marks a text farther from every centroid than
any learned one allows.

Document frequencies cover every row that may be learned from. The sample for
the centroids holds at most ``sample`` rows in all, a documented parameter; it
is picked by a hash of the row, so it is the same on every run.

Cases: a null text, or one without a letter, is ``und`` with score 0; a text of
any length is counted whole, into one vector; with no
row to learn from every text is ``und``; a null ``doc_id`` is never held out
nor learned from; a row with a null ``lang`` is only predicted; repeated rows
count as often as they occur; an empty table gives no rows. Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters is no sign of a language: blanks, which then run together.
_BLANKED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def buckets(text: str, dims: int) -> np.ndarray:
    """How often each hashed trigram of letters and word ends occurs in the whole text."""
    plain = b" ".join(text.lower().encode().translate(_BLANKED).split())
    b = np.frombuffer(b" " + plain + b" ", np.uint8).astype(np.uint32)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    key *= np.uint32(2654435761)
    key >>= np.uint32(32 - (dims.bit_length() - 1))
    return np.bincount(key, minlength=dims)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of texts, a row each."""
    x = np.empty((len(texts), len(idf)), np.float32)
    for i, t in enumerate(texts):
        x[i] = buckets(t, len(idf))
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


def _document_frequencies(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(dims, np.int64), 0
    for rb in batches:
        for at in range(0, rb.num_rows, 256):
            for t in rb["text"].slice(at, 256).to_pylist():
                df += buckets(t, dims) > 0
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.append(n, df))], names=["bucket", "n"])


def _vectors(batches: Iterable[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for at in range(0, rb.num_rows, 64):
            part = rb.slice(at, 64)
            x = vectors(part["text"].to_pylist(), idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [part["lang"], part["pick"], pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "pick", "vector"]
            )


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows; seeds are each the row farthest from those before."""
    seeds = [x.mean(axis=0)]
    best = x @ seeds[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int(best.argmin())])
        best = np.maximum(best, x @ seeds[-1])
    c = np.stack(seeds)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


class Model:
    """idf, centroids (a row each), their languages and the least cosine learned."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], floor: float) -> None:
        self.idf, self.centroids, self.langs, self.floor = idf, centroids, langs, floor


def may_learn(doc_id: Column) -> Column:
    """Not held out: crc32 of the id as text isn't 2 modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(rows: DataFrame, *, dims: int = 4096, clusters: int = 4, sample: int = 4000) -> Model | None:
    """Learn from ``rows`` (doc_id, text, lang); at most ``sample`` of them shape the centroids."""
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    got = rows.select("text").mapInArrow(partial(_document_frequencies, dims=dims), "bucket long, n long")
    df = dict(got.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    n = df.pop(-1, 0)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(dims)]))).astype(np.float32) + np.float32(1)
    # An even share for each language: the fraction that its rows are picked with.
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    counts = {r.lang: r.n for r in per.collect()}
    share = sample / len(counts)
    pick = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 40)) / float(1 << 40)
    rates = rows.sparkSession.createDataFrame([(k, min(1.0, share / v)) for k, v in counts.items()], "lang string, rate double")
    some = rows.withColumn("pick", pick).join(F.broadcast(rates), "lang").where("pick < rate")
    some = some.select("lang", "text", "pick").mapInArrow(partial(_vectors, idf=idf), "lang string, pick double, vector binary")
    got = some.orderBy("pick", "lang", "vector").limit(sample).collect()
    by: dict[str, list[bytes]] = {}
    for r in got:
        by.setdefault(r.lang, []).append(r.vector)
    centroids, langs, floor = [], [], 1.0
    for lang in sorted(by):
        x = np.frombuffer(b"".join(by[lang]), np.float16).reshape(-1, dims).astype(np.float32)
        c = spherical_kmeans(x, clusters)
        floor = min(floor, float(np.quantile((x @ c.T).max(axis=1), 0.01)))
        centroids.append(c)
        langs += [lang] * len(c)
    return Model(idf, np.concatenate(centroids), langs, floor / 2) if langs else None


def _predict(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for rb in batches:
        for at in range(0, rb.num_rows, 64):
            part = rb.slice(at, 64)
            texts = part["text"].to_pylist()
            lang: list[str] = [UNKNOWN] * len(texts)
            score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
            rows = [i for i, t in enumerate(texts) if m is not None and t is not None and _LETTER.search(t)]
            if rows:
                cos = vectors([texts[i] for i in rows], m.idf) @ m.centroids.T
                near = cos.argmax(axis=1)
                score[rows] = np.clip(cos.max(axis=1), 0, 1)
                rejected[rows] = score[rows] < m.floor
                for i, j in zip(rows, near.tolist(), strict=True):
                    lang[i] = m.langs[j]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["held_out"], pa.array(lang), pa.array(score), pa.array(rejected)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )


def identify(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of ``docs`` (doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = rows.sparkSession.sparkContext.broadcast(fit(rows.where(may_learn(F.col("doc_id"))), **how))
    rows = rows.withColumn("held_out", F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)))
    return rows.select("doc_id", "text", "held_out").mapInArrow(
        partial(_predict, model=model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    )
