"""Commands over folders: build shards, merge them into a corpus, write mixtures, score predictions, runs and sweeps, make
preference pairs, combine adapters and merge them into models."""

from __future__ import annotations

import argparse
import json
import math
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import linalg, metrics, mix, pairs, tiles
from ..operators.corpus import with_counter
from ..operators.tables import md_tables_to_html
from ..sources import builders, readers, saved_datasets, sinks, tensor_files
from ..sources.scratch import discard, stored


def source(spark: SparkSession, name: str, folder: str, benchmark: str | None = None, counts: Observation | None = None) -> DataFrame:
    """A source's corpus rows from its folder: parquet files, with splits as folders, images as files, lines as CSV."""
    at = f"{folder}/{name}"
    if name == "namaa":
        files = spark.read.format("binaryFile").load(f"{at}/images").select(F.substring_index("path", "/", -1).alias("name"), "length", F.col("content").alias("image"))
        files = builders.sized(files).drop("image")
        return builders.namaa([readers.indexed(spark, f"{at}/{s}", ["image", "text"]) for s in ("train", "validation")], files, counts)
    if name in ("khatt_para", "khatt_lines"):
        probes = spark.read.parquet(benchmark).select("text")
        if name == "khatt_para":
            pairs = readers.image_text_pairs(spark, f"{at}/proc_images", f"{at}/proc_text")
            return builders.paragraphs(with_counter(pairs, "image", "_n").withColumn("idx", F.col("_n") - 1).drop("image"), probes, counts)
        rows = files = None
        for k, split in enumerate(("train", "validation", "test")):
            # ids rise along a file, and by 2 ** 56 from split to split
            part = readers.csv(spark, f"{at}/{split}/metadata.csv", "file_name string, text string").select("file_name", "text", F.lit(split).alias("split"), (F.monotonically_increasing_id() + (k << 56)).alias("idx"))
            image = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(f"{at}/{split}").select(F.lit(split).alias("split"), F.substring_index("path", "/", -1).alias("file_name"), F.col("content").alias("image"))
            rows, files = (part, image) if rows is None else (rows.unionByName(part), files.unionByName(image))
        return builders.lines(rows, probes, builders.sized(files).drop("image"), counts)
    stored_rows = readers.indexed(spark, at if saved_datasets.exists(at) else f"{at}/*.parquet")
    return builders.BUILDERS[name](stored_rows, counts=counts)


def build(spark: SparkSession, names: list[str], sources: str, out: str, benchmark: str | None = None, force: bool = False) -> dict[str, int | None]:
    """Rows of each shard; None where it was complete already."""
    made = {}
    for name in names or builders.DEFAULT:
        path = f"{out}/shards/{name}"
        if sinks.complete(spark, path) and not force:
            made[name] = None
            continue
        counts = Observation()
        made[name] = sinks.save_shard(source(spark, name, sources, benchmark, counts), path, force, counts)
    return made


def merge(spark: SparkSession, out: str) -> dict:
    """The corpus of all shards; its stats have what the builders dropped, too."""
    return sinks.save_corpus(sinks.shards(spark, f"{out}/shards"), out, dropped=sinks.dropped(spark, f"{out}/shards"))


def suites(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """suite, i, ref of the suites that the folder has, by their names."""
    found = [name for name in readers.SUITES if sinks.exists(spark, f"{folder}/{name}")]
    if not found:
        raise ValueError(f"no suite in {folder}")
    return reduce(DataFrame.unionByName, [readers.suite(spark, f"{folder}/{name}", name, limit) for name in found])


def scored(spark: SparkSession, predictions: str, references: str | None = None, tables: bool = False) -> DataFrame:
    """run, suite, i, ref, hyp of predictions. references: a folder of suites whose rows, met by suite and index, give the
    references instead of the copies in the predictions; rows that were not predicted have an empty hypothesis.
    tables: pipe tables of a hypothesis become HTML first."""
    rows = readers.predictions(spark, predictions)
    if references:
        runs = rows.select("run", "suite").distinct()  # a row a run and suite
        wanted = suites(spark, references).join(runs, "suite")
        rows = wanted.join(rows.select("run", "suite", "i", "hyp"), ["run", "suite", "i"], "left")
    rows = rows.withColumn("hyp", F.coalesce("hyp", F.lit("")))
    return rows.withColumn("hyp", md_tables_to_html(F.col("hyp"))) if tables else rows


def evaluate(spark: SparkSession, predictions: str, summary: str, references: str | None = None, tables: bool = False) -> None:
    """Score all suites of all runs at once into the summary; rows of others stay. A suite without any reference has n 0."""
    rows = scored(spark, predictions, references, tables)
    normed = rows.withColumns({"ref": T.eval_norm(F.col("ref")), "hyp": T.eval_norm(F.col("hyp"))})
    made = metrics.summary(normed, rows, ["run", "suite"])
    every = rows.select("run", "suite").distinct().join(made, ["run", "suite"], "left").fillna(0, ["n"])
    sinks.upsert(every, summary, ["run", "suite"])


def mixture(spark: SparkSession, corpus: str, recipe: str, out: str, smoke: bool = False) -> int:
    """The recipe's mixture of a corpus folder, in its seeded order; of 2,000 rows if `smoke`. Rows written."""
    rows = spark.read.parquet(f"{corpus}/unified")
    made = mix.mix(rows, mix.RECIPES[recipe], "id", T.has_md_table(F.col("response")))
    if smoke:
        made = mix.smoke(made.withColumn("_copy", F.concat_ws(":", "id", "copy")), "_copy", mix.RECIPES[recipe].seed).drop("_copy")
    mix.save(made, out, mix.RECIPES[recipe], "id")
    return spark.read.parquet(out).count()


def preferences(spark: SparkSession, predictions: str, out: str, limit: int, references: str | None = None, seed: int = 42) -> int:
    """Preference pairs of a run: the reference is chosen, what was predicted rejected; with their messages, as JSON lines."""
    rows = scored(spark, predictions, references).withColumn("key", F.concat_ws(":", "run", "suite", "i"))
    made = pairs.preference_pairs(rows.select("key", "i", F.col("ref").alias("chosen"), F.col("hyp").alias("rejected")), "key", limit, seed)
    said = made.select("key", pairs.messages(T.prompt(F.col("i")), F.col("chosen")).alias("chosen"), pairs.messages(T.prompt(F.col("i")), F.col("rejected")).alias("rejected"))
    said.write.mode("overwrite").json(out)
    return spark.read.json(out, schema="key string").count()


def devrun(spark: SparkSession, predictions: str, out: str, baseline: str | None = None, references: str | None = None) -> dict:
    """The record of a development run over the slices whose suites were predicted, the canary first; ended there if it is
    far worse than the baseline's record, else than the absolute limit."""
    rows = scored(spark, predictions, references)
    normed = rows.withColumns({"ref": T.eval_norm(F.col("ref")), "hyp": T.eval_norm(F.col("hyp"))})
    there = {r["suite"] for r in rows.select("suite").distinct().collect()}  # a row a suite
    taken = lambda spec: F.col("i") < spec if isinstance(spec, int) else F.col("i").isin(spec)
    slices = [(label, normed.where((F.col("suite") == suite) & taken(spec))) for label, suite, spec in metrics.SLICES if suite in there]
    base = None
    if baseline:
        record = json.loads(spark.read.text(baseline, wholetext=True).first()[0])
        base = {label: x["cer"] for label, x in record["suites"].items() if x["cer"] is not None}
    record = metrics.dev_run(predictions, slices, base)
    sinks.save_json(spark, out, record)
    return record


def sweep(spark: SparkSession, predictions: str, out: str, references: str | None = None) -> list[dict]:
    """Mean rates of each run (a configuration) by bucket of length ratio, raw texts, as a JSON list."""
    rows = scored(spark, predictions, references)
    each = metrics.sweep(rows.withColumn("bucket", metrics.bucket(T.length_ratio(F.col("ref"), F.col("hyp")))), ["run", "bucket"])
    body = [r.asDict() for r in each.orderBy("run", "bucket").collect()]  # three rows a configuration
    sinks.write_text(spark, out, json.dumps(body, indent=2))
    return body


def basemerge(spark: SparkSession, base: str, adapter: str, out: str, scale: float | None = None) -> dict:
    """An adapter's tensor files merged into a model's, tile by tile, in the model's shards and types; the report. The
    model's other files are copied. The scale is alpha / r of the adapter's config."""
    if sinks.exists(spark, f"{out}/{tensor_files.INDEX}"):
        raise ValueError(f"{out} has a model already")
    if scale is None:
        config = json.loads(spark.read.text(f"{adapter}/adapter_config.json", wholetext=True).first()[0])
        scale = config["lora_alpha"] / (math.sqrt(config["r"]) if config.get("use_rslora") else config["r"])
    named = tensor_files.read(spark, adapter).withColumns({"factor": F.regexp_extract("module", r"\.lora_([AB])\.weight$", 1), "module": T.tensor_name(F.col("module"))})
    factors = named.where("factor <> ''").select("module", "factor", "bi", "bj", "rows", "cols", "dtype", "data", F.lit(1).alias("part"), F.lit(1.0).alias("coeff"))
    merged = stored(tiles.merge(tensor_files.read(spark, base), factors, scale), "merged")
    report = tiles.merge_report(merged, factors).first().asDict()
    if not report["applied"] or not report["max_change"]:
        raise ValueError(f"the adapter was not applied: {report}")
    tensor_files.save(merged, out, sidecars=base)
    discard(merged)
    return report


def soup(spark: SparkSession, mix: list[str], out: str) -> dict:
    """Adapters `folder:coefficient`, each with factors and config as sinks.save_adapter writes them."""
    factors = config = None
    for spec in mix:
        name, _, coeff = spec.rpartition(":")
        f = spark.read.parquet(f"{name}/factors").select(F.lit(name).alias("adapter"), F.col("module").cast("string").alias("module"), "factor", "i", "j", "v")
        c = spark.read.json(f"{name}/config").withColumns({"adapter": F.lit(name), "coeff": F.lit(float(coeff))})
        factors, config = (f, c) if factors is None else (factors.unionByName(f), config.unionByName(c, allowMissingColumns=True))
    combined, merged = linalg.soup(factors, config)
    sinks.save_adapter(combined, merged, out)
    return merged.first().asDict()


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="write the shards of sources")
    b.add_argument("names", nargs="*", help=f"of {', '.join(sorted(builders.BUILDERS))}; default: {', '.join(builders.DEFAULT)}")
    b.add_argument("--sources", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--benchmark")
    b.add_argument("--force", action="store_true", help="build shards again that are complete")
    m = sub.add_parser("merge", help="make the corpus and its holdout of all shards")
    m.add_argument("--out", required=True)
    e = sub.add_parser("evaluate", help="score predictions into a summary")
    e.add_argument("--predictions", required=True)
    e.add_argument("--summary", required=True)
    e.add_argument("--references", help="folder of suites, for the references")
    e.add_argument("--tables", action="store_true", help="pipe tables of hypotheses become HTML first")
    s = sub.add_parser("soup", help="combine adapters")
    s.add_argument("--mix", action="append", required=True, metavar="FOLDER:COEFFICIENT")
    s.add_argument("--out", required=True)
    x = sub.add_parser("mixture", help="write a recipe's mixture of a corpus")
    x.add_argument("--corpus", required=True)
    x.add_argument("--recipe", required=True, choices=sorted(mix.RECIPES))
    x.add_argument("--out", required=True)
    x.add_argument("--smoke", action="store_true", help="2,000 rows of it")
    for name, said in (("preferences", "pairs of references and predictions"), ("devrun", "score slices, and stop at a bad canary"), ("sweep", "mean rates of configurations by bucket")):
        c = sub.add_parser(name, help=said)
        c.add_argument("--predictions", required=True)
        c.add_argument("--references", help="folder of suites, for the references")
        c.add_argument("--out", required=True)
        if name == "preferences":
            c.add_argument("--limit", type=int, required=True)
            c.add_argument("--seed", type=int, default=42)
        if name == "devrun":
            c.add_argument("--baseline", help="record of an earlier run")
    g = sub.add_parser("basemerge", help="merge an adapter's tensor files into a model's")
    g.add_argument("--base", required=True)
    g.add_argument("--adapter", required=True)
    g.add_argument("--out", required=True)
    g.add_argument("--scale", type=float)
    a = vars(p.parse_args(argv))
    command = {f.__name__: f for f in (build, merge, evaluate, soup, mixture, preferences, devrun, sweep, basemerge)}[a.pop("command")]
    return command(spark or SparkSession.builder.getOrCreate(), **a)


if __name__ == "__main__":
    print(main())
