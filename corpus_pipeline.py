"""A corpus pipeline over `documents`: language, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of `docs`; extra columns are carried along.

- language: documents without a letter, or unlike every learned language, go.
- near_duplicates: one document of each class of 5-word-shingle Jaccard 0.8 stays, the one with the smallest id.
- passages: words in passages of 35 words that occur twice go from the text (n_chars follows); rows stay.
- benchmark: documents that hold 80 % of a benchmark item's shingles go.
- packing: pieces of at most 1024 tokens (see `qaloom.llm.packing`).

Null or blank texts go at the first stage; rows without an id stay; repeated ids are one document from the second stage on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from qaloom.llm import contamination, jaccard_join, language_id, packing, suffix_tree
from qaloom.llm.common import stored
from qaloom.session import table

MIN_LANGUAGE_SCORE = 0.2
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    found = language_id.identify(docs, language_id.learn_profiles(docs), keep=keep)
    found = found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return found.select(*[F.col(n).alias(c) for n, c in zip(keep, docs.columns, strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_tree.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("benchmark", benchmark), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
