"""Corpus pipeline: language ID, toxicity, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All but the last return the columns of the documents table they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.functions.names import free_name
from facsimile.llm import decontam, langid, packing, simhash, toxicity
from facsimile.llm.common import is_fold, written
from facsimile.llm.queries import CAPACITY, WINDOW, WORD_BPE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model accepts; learned outside the fold crc32 mod 4 = 2."""
    model = langid.fit(docs.where(~is_fold(F.col("doc_id"), 4, 2)))
    _, _, rejected = own = tuple(free_name(n, docs.columns) for n in ("lang_pred", "similarity", "rejected"))
    got = langid.predict(docs, model, names=own)
    return got.where(~F.col(rejected)).select(*[F.col(f"`{c}`") for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; learned outside the fold crc32 mod 5 = 0."""
    trained = ~is_fold(F.col("doc_id"), 5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(trained)
    model = toxicity.fit(docs.where(trained), labels)
    score = free_name("toxicity", docs.columns)
    got = toxicity.predict(docs, model, name=score)
    return got.where(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest id, of each SimHash class.

    Rows have a written number, so rows without an id or with a repeated one are told
    apart.  A null id comes after all others; of rows with one id the one with the
    smallest hash of its text stays.
    """
    row = free_name("row", docs.columns)
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), F.col(row).alias("row"))
    got = simhash.near_duplicates(docs.select(key.alias("key"), "text"), id_col="key", words=3, max_bits=2)
    gone = written(got.where("key.row <> component_id.row").select(F.col("key.row").alias("gone")), "gone")
    return docs.join(gone, docs[row] == gone["gone"], "left_anti").drop(row)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no window of a benchmark item; the text alone says so, whatever the row's id."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    digest = F.unhex(F.md5("text"))
    got = decontam.contamination(docs.select(digest.alias("digest"), "text"), bench, WINDOW, id_col="digest")
    mark = free_name("gone", docs.columns)
    gone = written(got.where("contaminated").select(F.col("digest").alias(mark)).distinct(), "gone")
    return docs.join(gone, digest == F.col(mark), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in training sequences."""
    got = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path(WORD_BPE), end_id=1, capacity=CAPACITY)
    return got.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                      "sequence_id", "offset")


STAGES = [("language_id", language_id), ("toxicity", toxic), ("simhash_near_dedup", near_dedup),
          ("benchmark_decontamination", decontaminate), ("best_fit_packing", pack)]

#: SQL can say neither the models nor the fingerprints; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
