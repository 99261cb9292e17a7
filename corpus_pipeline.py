"""The corpus pipeline: quality rules, near-dedup, decontamination, PII, packing.

Each stage is a function of (session, documents, folder of the other tables)
and works on all that the stage before it kept; its result is written as
Parquet and read again. The first four return the columns of ``documents``,
the last the packed pieces.

Cases, beside those of the operators: null, empty and very long texts, null and
repeated ids, repeated rows and extra columns of any name go through every
stage but those that the quality rules reject (a null or empty text is one);
an empty table gives no rows, stage by stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, nearcopies, packing, pii, quality
from millrace.llm.common import discard, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rules or the likelihood ratio reject."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), prefix="__q_")
    kept = judged.where("__q_kept").select(*docs.columns)
    kept.stored_at = judged.stored_at
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component, the one with the smallest id.

    Operator 4, SimHash by bit-sliced comparison, for texts of five-word
    shingles with a Jaccard similarity of 0.8 or more. A row without an id
    links nothing and stays; of rows that repeat the smallest id each text is
    judged by itself, and of identical ones the least row stays, so the result
    is the same on every run.
    """
    keep = nearcopies.representatives(docs, shingle=5, least=0.8)
    keep = keep.withColumnsRenamed({"rep": "__rep", "mark": "__mark"})
    found = (F.col("doc_id") == F.col("__rep")) & (F.xxhash64("text") == F.col("__mark"))
    # Shuffled at every size: what is kept grows with the input.
    kept = docs.where("doc_id is not null").join(keep.hint("shuffle_hash"), found)
    twice = kept.groupBy("__rep", "__mark").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").limit(1)
    if twice.count():
        kept = kept.groupBy("__rep", "__mark").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of any benchmark item."""
    found = decontaminate.add_hits(docs, table(spark, sf_dir, "benchmark"), size=8, hits="__hits")
    return found.where(~decontaminate.contaminated("__hits", 1)).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms in place of personal data; n_chars follows the new text."""
    new = docs.withColumn("__new", pii.pseudonymise(F.col("text"), pii.session_key(spark))).withColumn("text", F.col("__new.text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return new.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, in sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packed),
]

#: Hashes and fingerprints of the stages have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each over what the last one wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        before, docs = docs, materialize(made, name.replace(" ", "-"))
        discard(before, made)
    return STAGES[-1][1](spark, docs, sf_dir)
