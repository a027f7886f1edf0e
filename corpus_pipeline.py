"""The corpus pipeline: from documents to token ids, in stages that each call one operator of ``shelfmark.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Each works on all rows the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, decontaminate, near_dups, pii, toxicity
from shelfmark.llm.common import collecting, delete, table, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more, smallest doc_id."""
    return near_dups.one_of_each(docs, size=5, percent=80)


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised; n_chars follows the text."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and whether decoding gives the text back: doc_id, lang, source, n_tokens, ids_le, round_trip."""
    kept = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("want"), "text")
    ids = bpe.encode(kept, RANKS, public_tokenizers.PATTERN).drop("text")
    back = bpe.decode(ids, RANKS).withColumn("round_trip", F.sha2("decoded", 256) == F.col("want"))
    return back.select("doc_id", "lang", "source", (F.octet_length("ids_le") / 4).cast("bigint").alias("n_tokens"), "ids_le", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("min_max_hashing", drop_near_duplicates),
    ("decontamination", drop_benchmark_overlaps),
    ("personal_data", mask_personal_data),
    ("byte_level_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. A stage's input and scratch tables go as soon as its output is written."""
    docs, spent = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with collecting() as made:
            docs = stage(spark, docs, sf_dir)
        if stage is STAGES[-1][1]:
            return docs
        with collecting() as kept:
            docs = written(docs)
        delete(spark, spent + made)
        spent = kept
    return docs


#: No stage before the last can be put in SQL (a trained classifier, min-max hashing): tests compare with plain versions.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
