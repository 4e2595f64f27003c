"""Readers; every one has an explicit schema or takes it from the files' footers, and an index where order matters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import types as T_

from ..functions.image import size_of
from . import saved_datasets

PREDICTION = "i long, ref string, hyp string"
SUMMARY = "map<string, struct<cer: double, wer: double, n: long, teds: double, teds_n: long>>"
ANNOTATION = "struct<objects: array<struct<tags: array<struct<name: string, value: string>>, points: struct<exterior: array<array<double>>>>>>"
#: Domain by category of a file's name; the default.
CATEGORY_DOMAINS = {
    "HandwrittenText": "line_real",
    "Newspaper": "newspaper",
    "Receipt": "line_real",
    "Invoice": "line_real",
    "Label": "line_real",
    "BusinessCard": "line_real",
    "AdminForm": "doc_markdown",
    "OfficialDocument": "doc_markdown",
    "Book": "doc_markdown",
    "Magazine": "doc_markdown",
    "Map": "line_real",
    "Comics": "line_real",
}
DEFAULT_DOMAIN = "line_real"


def indexed(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of the parquet files under a path or glob, with `file` and `idx`, their position from 0 in the order of file
    names and of rows in a file; of a saved dataset's folder the rows with `idx`, in the order of its state file. Only
    counts of rows meet in one place, one a file, and go to the tasks; the driver lists the files anyway."""
    if not re.search(r"[*?\[{]", path) and saved_datasets.exists(path):
        return saved_datasets.read(spark, path, columns)
    df = spark.read.parquet(path)
    at = df.select(*(columns or df.columns), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("_row"))
    sizes = at.groupBy("_path").agg(F.count("*").alias("_n"))
    ahead = W.orderBy("_path").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("_path", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(before), "_path").withColumn("idx", F.col("_before") + F.col("_row")).drop("_path", "_row", "_before")


def splits(spark: SparkSession, folder: str, names: list[str], columns: list[str] | None = None) -> DataFrame:
    """The named splits of a dataset, folders of parquet files, with `split`, and `idx` counting on in the order given.
    Others are not opened."""
    out, start = None, 0
    for name in names:
        part = indexed(spark, f"{folder}/{name}", columns).withColumns({"split": F.lit(name), "idx": F.col("idx") + F.lit(start)})
        start += spark.read.parquet(f"{folder}/{name}").count()  # from the files' footers
        out = part if out is None else out.unionByName(part)
    return out


#: Evaluation suites and their text columns; those that are single files instead of splits.
SUITES = {
    "arocrbench_arabicocr": "text",
    "arocrbench_hindawi": "text",
    "arocrbench_historyar": "text",
    "arocrbench_khattparagraph": "answer",
    "arocrbench_patsocr": "answer",
    "arocrbench_isippt": "text",
    "arocrbench_synthesizear": "text",
    "sedra_handwritten": "text",
    "misraj_dococr": "markdown",
    "nakba_test": "text",
}
SINGLE = ["misraj_dococr", "nakba_test"]


def suite(spark: SparkSession, folder: str, name: str, limit: int | None = None) -> DataFrame:
    """suite, i, ref of an evaluation suite in a folder: of the first split alone, by name, where it has splits. limit
    takes the first rows in stored order."""
    path = folder
    if name not in SINGLE:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = sorted(s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if s.isDirectory() and s.getPath().getName()[0] not in "._")
        path = f"{folder}/{found[0]}" if found else folder
    rows = indexed(spark, path, [SUITES[name]]).select(F.lit(name).alias("suite"), F.col("idx").alias("i"), F.col(SUITES[name]).alias("ref"))
    return rows if limit is None else rows.where(F.col("i") < limit)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_*.parquet of a folder; an error if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/chunk_*.parquet")
    if not (p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []):
        raise ValueError(f"no chunk_*.parquet in {folder}")
    return spark.read.parquet(f"{folder}/chunk_*.parquet")


def tensors(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """Cells (shard, module, i, j, v) of the tensors that an index file maps to shards: {"weight_map": {tensor: shard}}.
    Shards are parquet files of coordinates named by tensor; a tensor elsewhere than the index says does not count."""
    kind = "struct<weight_map: map<string, string>>"
    where = spark.read.text(index, wholetext=True).select(F.explode(F.from_json("value", kind)["weight_map"]).alias("module", "shard"))
    cells = spark.read.parquet(f"{folder}/*.parquet").select("module", "i", "j", "v", F.col("_metadata.file_name").alias("shard"))
    return cells.join(where, ["module", "shard"])


def csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, with `run` and `suite` where the folders are partitioned by them."""
    return spark.read.schema(PREDICTION).json(path)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON objects as rows: file, suite, cer, wer, n, teds, teds_n."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", SUMMARY).alias("m"))
    return text.select("file", F.explode("m").alias("suite", "s")).select("file", "suite", "s.*")


def image_text_pairs(spark: SparkSession, images: str, texts: str, charset: str = "windows-1256") -> DataFrame:
    """stem, image (its path), w, h and text of image files and the text files of the same stem; images without a text and
    empty ones are left out. Only paths and sizes of images are shuffled with the texts."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    a = read.load(images).where("length > 0").select(stem.alias("stem"), F.col("path").alias("image"), size_of("content").alias("s")).select("stem", "image", "s.w", "s.h")
    b = read.load(texts).select(stem.alias("stem"), decoded(charset)("content").alias("text"))
    return a.join(b, "stem")


def decoded(charset: str):
    @F.pandas_udf(T_.StringType())
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else bytes(b).decode(charset, errors="replace"))

    return decode


def category(file):
    return F.split(file, "-0000")[0]


def category_domain(cat):
    pairs = [F.lit(x) for kv in CATEGORY_DOMAINS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), cat), F.lit(DEFAULT_DOMAIN))


def regions(df: DataFrame, annotation: str = "annotation") -> DataFrame:
    """A row for each object with a transcription: `region`, its place, `transcription`, and `points`, its polygon. An
    annotation that cannot be parsed has none."""
    a = df.select("*", F.posexplode(F.from_json(annotation, ANNOTATION)["objects"]).alias("region", "_o"))
    named = F.filter("_o.tags", lambda t: (t["name"] == "Transcription") & (F.coalesce(t["value"], F.lit("")) != ""))
    return a.withColumns({"transcription": F.get(named, F.lit(0))["value"], "points": F.col("_o.points.exterior")}).where("transcription is not null").drop("_o")
