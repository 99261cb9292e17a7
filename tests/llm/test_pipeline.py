"""The pipeline, stage by stage, against plain versions of its decisions."""

import random

import brute
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from millrace.llm import common, nearcopies, pii, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        steps[name] = (docs, out)
        docs = out
    assert all(out.columns == names for n, (_, out) in steps.items() if n != "packing")
    text = lambda df: dict(df.select("doc_id", "text").collect())
    before, after = map(text, steps["quality rules"])
    assert not any(brute.quality(t)[-1] for t in after.values()) and set(after) < set(before)
    before, after = map(text, steps["near duplicates"])
    assert set(after) == set(exact_components(before).values())
    before, after = map(text, steps["decontamination"])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.decontaminate(list(before.values()), items)
    assert set(after) == {i for i, (_, _, found) in zip(before, hits) if not found}
    before, after = map(text, steps["personal data"])
    keys = pii.Pseudonyms(pii.session_key(spark))
    assert after == {i: pii.replace(t, keys)[0] for i, t in before.items()}
    packed = steps["packing"][1]
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == set(after)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_the_quality_stage_counts_every_label(spark, tmp_path):
    """More labelled rows than any fixed number of them: the stage's threshold is the percentile of all."""
    rng = random.Random(6)
    texts = [(i, " ".join(f"{'good' if rng.random() < (i % 7) / 6 else 'bad'}{rng.randrange(100)}" for _ in range(50))) for i in range(8000)]
    good = {i: int(rng.random() < (i % 7) / 6) for i, _ in texts}
    spark.createDataFrame(list(good.items()), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    scores = [g for g in quality.judge(docs, labels, without=("text",)).collect() if not g.base_failed]
    low, high = (np.quantile([g.score for g in scores if good[g.doc_id] == q], share) for q, share in ((1, 0.01), (0, 0.99)))
    assert low < high
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert {r[0] for r in kept.select("doc_id").collect()} == {g.doc_id for g in scores if g.score >= low} == {g.doc_id for g in scores if g.kept}


def test_toxic_rows_that_are_bad_count(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0), (5, 1, None), (6, 0, None), (7, 1, 0), (7, 0, 1), (8, None, 1), (None, 0, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert dict(quality._labelled(labels).collect()) == {1: True, 3: False, 4: False, 5: True, 6: False, 7: False}


def test_the_run_deletes_the_figures(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, SF).count()
    left = [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()]
    assert "personal-data" in left and not {"figures", "scores", "ratios", "quality-rules"} & set(left)


def test_empty_and_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
    assert docs.count() == 0
    one = spark.read.parquet(f"{SF}/documents.parquet").limit(3)
    odd = one.unionByName(one).unionByName(one.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(one.limit(1).withColumn("text", F.lit(None).cast("string")))
    kept = corpus_pipeline.near_duplicates(spark, odd.withColumn("fp", F.lit(1)).withColumn("n", F.lit(2)), SF)
    assert kept.where("doc_id is not null").count() == kept.select("doc_id", "text").where("doc_id is not null").distinct().count()
    assert kept.where("doc_id is null").count() == 1


def test_texts_that_share_an_id_are_judged_apart(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "w"), (2, a, "z"), (3, b + " more", "v"), (None, a, "u")]
    for order in (rows, rows[::-1]):
        kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(order, "doc_id long, text string, mark string").repartition(3), SF)
        assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(1, a, "x"), (1, b, "w"), (None, a, "u")]))


def test_one_planted_item_is_enough(spark):
    items = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").orderBy("item_id").collect()]
    clean = "nothing in this text was ever part of a test set"
    texts = [clean, f"{clean} {items[0]} {clean}", clean, items[1], f"{items[0]} {clean} {items[1]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.decontamination(spark, docs, SF)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [0, 2]


def exact_components(texts, least=0.8):
    """doc_id -> smallest reachable by 5-word Jaccard similarity, over all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_near_copies_at_four_fifths(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(40):  # an original and copies with more and more words replaced, apart
        w = [word() for _ in range(200)]
        texts.append(w)
        for n in (1, 2, 3, 4, 5, 8):
            copy = list(w)
            for k in range(n):
                copy[10 + 20 * k] = word()
            texts.append(copy)
    family = [word() for _ in range(120)]  # more copies of one text than a bucket compares at once
    for n in range(60):
        copy = list(family)
        for at in rng.sample(range(120), n % 4):
            copy[at] = word()
        texts.append(copy)
    texts = {i: " ".join(t) for i, t in enumerate([*texts, texts[3], [], [], ["one"], ["one"], ["two"]])}
    rows = [(i, t) for i, t in texts.items()]
    rng.shuffle(rows)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    want = exact_components(texts)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def test_every_pair_that_is_open_is_proposed(monkeypatch):
    rng = np.random.default_rng(3)
    node, size = rng.integers(1, 1 << 60, 50), rng.integers(50, 90, 50).astype(np.int32)
    comp = rng.integers(0, 5, 50)
    monkeypatch.setattr(nearcopies, "RADIUS", 63)
    fp = rng.integers(0, 1 << 62, 50)
    got = {frozenset(p) for a, b in nearcopies._proposed(node * 0, node, size, fp, comp, None, 0.8) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {frozenset((i, j)) for i in range(50) for j in range(i) if comp[i] != comp[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])}
    assert got == want


def test_the_bound_keeps_every_near_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate((base[: 300 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)))) for k in range(0, 200, 4)]
    node, size = np.arange(len(sets)), np.array([len(h) for h in sets], np.int32)
    prof = np.stack([nearcopies.profile(h) for h in sets])
    fp = np.array([simhash.majority(h) for h in sets], np.uint64).view(np.int64)
    got = {frozenset(p) for a, b in nearcopies._proposed(node * 0, node, size, fp, node, None, 0.8, prof) for p in zip(a.tolist(), b.tolist(), strict=True)}
    near = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if nearcopies.similarity(sets[i], sets[j]) >= 0.8}
    assert near and near <= got and len(got) < len(sets) * (len(sets) - 1) // 2
