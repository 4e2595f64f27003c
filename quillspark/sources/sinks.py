"""Sinks: shards that are skipped when complete, corpus and holdout, predictions, summaries in versions, adapters."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, metrics
from .scratch import stored


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def complete(df_or_spark, path: str) -> bool:
    fs, p = _path(getattr(df_or_spark, "sparkSession", df_or_spark), f"{path}/_SUCCESS")
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, by way of the cluster's file system."""
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(body))
    out.close()


def save_shard(df: DataFrame, path: str, force: bool = False, counts: Observation | None = None) -> int | None:
    """Rows written, or None if the shard was complete already. counts: what the builder counted meanwhile, kept beside."""
    if complete(df, path) and not force:
        return None
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
    if counts is not None:
        write_text(df.sparkSession, f"{path}/{COUNTS}", json.dumps(counts.get))
    return seen.get["n"]


COUNTS = "_counts.json"


def dropped(spark: SparkSession, folder: str) -> dict[str, dict]:
    """What the builders counted, by shard."""
    names = [n for n in shard_names(spark, folder) if exists(spark, f"{folder}/{n}/{COUNTS}")]
    return {n: json.loads(read_text(spark, f"{folder}/{n}/{COUNTS}")) for n in names}


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, by way of the cluster's file system."""
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """All complete shards of a folder, with `shard`, their name, and `id`, unique to the row: its key (of older shards:
    idx) in its shard. The order of names, not of the file system, decides nothing: the later shuffle is by id."""
    out = None
    for name in shard_names(spark, folder):
        part = spark.read.parquet(f"{folder}/{name}")
        part = part.withColumns({"shard": F.lit(name), "id": F.concat_ws(":", F.lit(name), "key" if "key" in part.columns else "idx")})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no complete shard in {folder}")
    return out


def shard_names(spark: SparkSession, folder: str) -> list[str]:
    """The complete shards of a folder, sorted."""
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and complete(spark, f"{folder}/{s.getPath().getName()}"))


def save_corpus(rows: DataFrame, folder: str, key: str = "id", holdout: int = corpus.HOLDOUT, seed: int = 42, dropped: dict | None = None) -> dict:
    """Split off the holdout, write `unified` and `val`, each in seeded order, and STATS.md, and return the counts. Both
    are written at once, by split, and then get their names. An error where the holdout is not exact, that is where rows
    share a key."""
    spark = rows.sparkSession
    split = corpus.with_holdout(rows, "domain", key, seed, holdout)
    corpus.in_order(split, seed, key, ["split"]).write.mode("overwrite").partitionBy("split").parquet(f"{folder}/split")
    fs, at = _path(spark, folder)
    written = spark.read.schema(f"{split.select(key, 'source', 'domain').schema.toDDL()}, split string").parquet(f"{folder}/split")
    counted = stored(written.groupBy("split", "source", "domain").agg(F.count("*").alias("n")), "counts")  # a row for each source and domain
    body = stats(counted) | ({"dropped": dropped} if dropped else {})
    taken = counted.groupBy("domain").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("split") == "val", F.col("n"))), F.lit(0)).alias("val"))
    wrong = taken.where(F.col("val") != F.least("n", F.lit(holdout))).limit(5).collect()
    if wrong:
        raise ValueError(f"rows share their {key}: {', '.join(f'{r.val} of {r.n} rows of {r.domain} held out' for r in wrong)}")
    for name, to in (("train", "unified"), ("val", "val")):
        made, final = spark._jvm.org.apache.hadoop.fs.Path(at, f"split/split={name}"), spark._jvm.org.apache.hadoop.fs.Path(at, to)
        fs.delete(final, True)
        if fs.exists(made):
            fs.rename(made, final)
        else:  # no row
            rows.limit(0).write.parquet(f"{folder}/{to}")
    write_text(spark, f"{folder}/STATS.md", stats_document(body))
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at, "split"), True)
    return body


def stats(counted: DataFrame) -> dict:
    """Rows of split, source, domain and n as one object; a row for each source and domain."""
    body: dict = {"total_train": 0, "total_val": 0, "by_source": {}, "by_domain": {}}
    for r in sorted(counted.collect(), key=str):
        body[f"total_{r['split']}"] += r["n"]
        for kind in ("source", "domain"):
            if r["split"] == "train" and r[kind] is not None:
                body[f"by_{kind}"][r[kind]] = body[f"by_{kind}"].get(r[kind], 0) + r["n"]
    return body


def stats_document(body: dict) -> str:
    return "# Corpus\n\n```json\n" + json.dumps(body, ensure_ascii=False, indent=2, sort_keys=True) + "\n```\n"


def save_predictions(df: DataFrame, path: str) -> None:
    """JSON lines by run and suite, each suite's rows in order of `i`; a long suite has several files, by name in this order.
    Ranges are sampled, so no task holds more than its share of a suite."""
    order = ["run", "suite", "i"]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("run", "suite").json(path)


def save_json(spark: SparkSession, path: str, body: dict) -> None:
    """A small object, such as the record of a development run."""
    write_text(spark, path, json.dumps(body, ensure_ascii=False, indent=2))


# a table that is rewritten: each version is a folder, and the last complete one counts


def versions(spark: SparkSession, path: str, whole: bool = False) -> int:
    """The largest number of a version, of a complete one if `whole`; -1 if there is none."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return -1
    found = [re.fullmatch(r"v(\d+)", s.getPath().getName()) for s in fs.listStatus(p)]
    return max((int(m[1]) for m in found if m and (not whole or complete(spark, f"{path}/{m[0]}"))), default=-1)


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last complete version; -1 if there is none."""
    return versions(spark, path, whole=True)


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    n = latest(spark, path)
    return None if n < 0 else spark.read.parquet(f"{path}/v{n}")


def publish(df: DataFrame, path: str, number: int) -> bool:
    """Write df as version `number`; False, and nothing stays, if another writer was first. The folder gets its name when
    it is whole, by a rename that fails where the name is taken."""
    spark = df.sparkSession
    at = f"{path}/_writing-{uuid.uuid4().hex}"
    df.write.parquet(at)
    java = spark._jvm.org.apache.hadoop.fs
    files = java.FileContext.getFileContext(_path(spark, path)[1].toUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(java, "Options$Rename")
    how = spark._sc._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        files.rename(java.Path(at), java.Path(f"{path}/v{number}"), how)
    except Exception as e:  # by name: what is thrown has no class of its own here
        files.delete(java.Path(at), True)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def upsert(new: DataFrame, path: str, key: list[str]) -> None:
    """Rows of new replace those of the same key; the others stay. Of two writers at once one publishes its version and
    the other merges again on it, so neither's rows are lost. A crash midway leaves the last version in force; versions
    before the last two are removed."""
    spark = new.sparkSession
    while True:
        number, last = versions(spark, path), latest(spark, path)
        old = None if last < 0 else spark.read.parquet(f"{path}/v{last}")
        if publish(new if old is None else metrics.upsert(old, new, key), path, number + 1):
            break
    fs, p = _path(spark, path)
    for s in fs.listStatus(p):
        m = re.fullmatch(r"v(\d+)", s.getPath().getName())
        if m and int(m[1]) < last:
            fs.delete(s.getPath(), True)


def save_adapter(factors: DataFrame, config: DataFrame, path: str) -> None:
    """Coordinates by module, and the config row beside them."""
    factors.repartition("module").write.mode("overwrite").partitionBy("module").parquet(f"{path}/factors")
    config.write.mode("overwrite").json(f"{path}/config")


def save_merged(merged: DataFrame, index: DataFrame, path: str) -> int | None:
    """A merged model's cells by the shard that the index (module, shard) names; None if it was complete already."""
    if complete(merged, path):
        return None
    seen = Observation()
    rows = merged.join(index, "module").observe(seen, F.count("*").alias("n"))
    rows.repartition("shard", "module").write.mode("overwrite").partitionBy("shard").parquet(path)
    return seen.get["n"]
