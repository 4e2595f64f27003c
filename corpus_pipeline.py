"""A training-data pipeline: reject poor documents, keep one of each group of near copies, drop documents that hold
benchmark texts, redact secrets, pack what is left into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, line_crf, ngram_join, packing, secret_scan
from quillspark.llm.common import discard, fold, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = fold("doc_id", 4) != 2
    model = line_crf.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return line_crf.accepted(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    base, spans = f"base_{uuid.uuid4().hex}", f"spans_{uuid.uuid4().hex}"  # whatever columns docs has
    found = secret_scan.scan(docs, base=base, spans=spans)
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col(spans)))
    return clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("secret scans", secrets),
    ("packing", packed),
]
#: Trained and token-level stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
