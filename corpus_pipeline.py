"""The corpus pipeline: toxicity, near-dedup, source mixing, BPE round trip.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first
two filter: documents that the toxicity model rejects go, and of each group of near-duplicates
the document with the smallest id stays (one row of it); groups are first those of op7's
SimHash and then, of what is left, those of five-word shingle sets alike in eight tenths.
Mixing keeps every document at least once, counts that towards the target weights and repeats
rows where it leaves a leaf short; the row in which a leaf's budget ends is cut at that token,
and its ``n_chars`` follows. The last stage returns ids and decoded text as digests, one row per
row of its input.

Null ids: such rows pass the filters on their own texts; in a group of null ids alone one row
stays. Null and empty texts are alike: one such row stays. Very long texts go through whole. Of
repeated rows one stays. Extra columns go through to the third stage's result, whatever their
names; a null language or source is a leaf of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrakin.llm import bpe, mixing, queries, simhash, toxicity
from terrakin.llm.common import materialize, scratch

#: Every document once, and four tenths of the corpus's tokens more towards the target weights.
TARGETS = mixing.Targets(lang={"en": 5, "de": 2, "fr": 2, "es": 1}, budget_permille=400, max_epochs=4, floor_epochs=1)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay. The model learns from the same rows as
    the toxicity query."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels").filter(~queries.held_out(5, 0)))
    return toxicity.rejected(docs, model)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id, and of rows
    that share it the one with the smallest hash of all columns."""
    return simhash.representatives(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What ``simhash_stage`` keeps, without texts whose sets of five-word shingles are alike
    in eight tenths or more; the one that stays is chosen in the same way."""
    return simhash.unlike(materialize(simhash_stage(spark, docs, sf_dir), "simhash_kept"), words=5, permille=800)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the target weights ask for."""
    return mixing.mixed(docs, TARGETS, queries.domain(), length_col="n_chars" if "n_chars" in docs.columns else None)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    return bpe.round_trip(docs, queries.vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity_stage), ("simhash_near_dedup", near_dedup_stage), ("source_mixing", mixing_stage), ("bpe_round_trip", bpe_stage)]

#: The trained model, XXH64 fingerprints and the tokenizer have no SQL form; the tests hold
#: each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
