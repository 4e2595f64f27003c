"""Registered queries over what the readers and sinks do: the driver's tables are written in the formats of sources and
results, then read back by the readers, commands and scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, tables
from ..sources import builders, readers, scratch, sinks
from . import run
from .catalog import COLLAPSED, NORMED, PAIRS_SQL, PROMPT_SQL, ROW_OK, _order, _summary_sql, docs, query, read, run_summary, turn_pairs


def fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch.folder(spark)}/{name}-{uuid.uuid4().hex}"


def in_stored_order(df: DataFrame, key: str, path: str) -> None:
    df.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_scan(spark, d):
    at = fresh(spark, "csv")
    read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(at, header=True)
    return readers.csv(spark, at, "c_custkey long, c_name string, c_acctbal double")


@query("""SELECT 'arocrbench_hindawi' AS suite, row_number() OVER (ORDER BY doc_id) - 1 AS i, text AS ref FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'nakba_test', row_number() OVER (ORDER BY doc_id) - 1, text FROM documents""")
def suite_rows(spark, d):
    """A suite with splits, of which the first by name counts, and one of single files."""
    at, rows = fresh(spark, "suites"), docs(spark, d).select("doc_id", "text")
    in_stored_order(rows.where("doc_id % 3 = 0"), "doc_id", f"{at}/arocrbench_hindawi/test")
    in_stored_order(rows.where("doc_id % 3 = 1"), "doc_id", f"{at}/arocrbench_hindawi/validation")
    in_stored_order(rows, "doc_id", f"{at}/nakba_test")
    return run.suites(spark, at)


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, coalesce(text, '') AS ref FROM documents)
SELECT 'r' AS run, 'nakba_test' AS suite, i, ref, CASE WHEN i % 7 = 3 THEN '' ELSE replace(ref, '.', '') END AS hyp FROM s""")
def predictions_of_a_suite(spark, d):
    """Predictions as JSON lines, every seventh missing and with stale references, met with their suite by index."""
    at = fresh(spark, "predictions")
    in_stored_order(docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", f"{at}/suites/nakba_test")
    rows = readers.suite(spark, f"{at}/suites/nakba_test", "nakba_test").where("i % 7 <> 3")
    sinks.save_predictions(rows.select(F.lit("r").alias("run"), "suite", "i", F.lit("stale").alias("ref"), F.replace("ref", F.lit("."), F.lit("")).alias("hyp")), f"{at}/said")
    return run.scored(spark, f"{at}/said", f"{at}/suites").select("run", "suite", "i", "ref", "hyp")


@query(f"SELECT suite, cer, n FROM {_summary_sql(0)}")
def summary_files(spark, d):
    """A run's summary as one JSON object."""
    at = fresh(spark, "summary")
    entry = F.struct("suite", F.struct("cer", F.col("n").cast("long").alias("n")))
    run_summary(spark, d, 0).agg(F.to_json(F.map_from_entries(F.collect_list(entry)))).write.text(at)  # a row a language
    return readers.summaries(spark, at).select("suite", "cer", "n")


@query("SELECT doc_id, source FROM documents")
def chunk_scan(spark, d):
    """The table in files chunk_*.parquet, beside one of another name."""
    at = fresh(spark, "chunks")
    docs(spark, d).select("doc_id", "source").repartition(3, "doc_id").write.parquet(f"{at}/made")
    fs, folder = sinks._path(spark, f"{at}/made")
    java = spark._jvm.org.apache.hadoop.fs.Path
    for k, f in enumerate(sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".parquet"))):
        fs.rename(java(f"{at}/made/{f}"), java(f"{at}/chunk_{k:05d}.parquet"))
    spark.range(5).select(F.col("id").alias("doc_id"), F.lit("no chunk").alias("source")).write.parquet(f"{at}/other.parquet")
    return readers.chunks(spark, at)


@query("SELECT 'first' AS step, count(*) AS n FROM documents UNION ALL SELECT 'again', NULL FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'forced', count(*) FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'a,b', 2 FROM region WHERE r_regionkey = 0")
def shard_resume(spark, d):
    """Rows written by a shard, by one that is there already, and by a forced one; then the shards' names and number."""
    at, rows = fresh(spark, "resume"), docs(spark, d).select("doc_id")
    steps = [("first", sinks.save_shard(rows, f"{at}/b")), ("again", sinks.save_shard(rows, f"{at}/b")), ("forced", sinks.save_shard(rows.where("doc_id % 2 = 0"), f"{at}/b", force=True))]
    sinks.save_shard(rows, f"{at}/a")
    names = sinks.shard_names(spark, at)
    return spark.createDataFrame([*steps, (",".join(names), len(names))], "step string, n long")


@query(f"""WITH k AS (SELECT source, lang AS domain, row_number() OVER (PARTITION BY lang ORDER BY {_order(42)}) <= 7 AS val FROM documents)
SELECT 'source' AS kind, source AS name, count(*) AS n FROM k WHERE NOT val AND source IS NOT NULL GROUP BY source UNION ALL SELECT 'domain', domain, count(*) FROM k WHERE NOT val AND domain IS NOT NULL GROUP BY domain
UNION ALL SELECT 'total', 'train', count(*) FILTER (NOT val) FROM k UNION ALL SELECT 'total', 'val', count(*) FILTER (val) FROM k""")
def stats_file(spark, d):
    """The counts as the stats document of a corpus states them."""
    at = fresh(spark, "stats")
    sinks.save_corpus(docs(spark, d).select("doc_id", "source", F.col("lang").alias("domain")), at, "doc_id", 7)
    body = F.from_json(F.split(sinks_text(spark, f"{at}/STATS.md"), "```")[1].substr(F.lit(5), F.lit(1 << 30)), "total_train long, total_val long, by_source map<string, long>, by_domain map<string, long>")
    row = spark.range(1).select(body.alias("b"))
    parts = [row.select(F.lit(kind).alias("kind"), F.explode(f"b.by_{kind}").alias("name", "n")) for kind in ("source", "domain")]
    totals = row.select(F.lit("total").alias("kind"), F.explode(F.create_map(F.lit("train"), F.col("b.total_train"), F.lit("val"), F.col("b.total_val"))).alias("name", "n"))
    return parts[0].unionByName(parts[1]).unionByName(totals)


def sinks_text(spark, path):
    return F.lit(sinks.read_text(spark, path))


@query("SELECT p_partkey, coalesce(try_cast(['12', 'x', '', NULL, '-3'][p_partkey % 5 + 1] AS int), 1) AS n FROM part")
def safe_numbers(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("12", "x", "", None, "-3")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", T.safe_int(said).alias("n"))


NAMES = [*T.SUITE_LABELS, "other"]


@query(f"SELECT p_partkey, [{', '.join(repr(T.SUITE_LABELS[n]) if n in T.SUITE_LABELS else 'NULL' for n in NAMES)}][p_partkey % {len(NAMES)} + 1] AS label FROM part")
def suite_labels(spark, d):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", T.suite_label(name).alias("label"))


@query(f"WITH {PAIRS_SQL} SELECT suite, sum(CASE WHEN turn % 4 = 0 THEN length(ref) ELSE edits END)::bigint AS char_edits, sum(length(ref))::bigint AS chars, count(*) AS n FROM e GROUP BY suite")
def failed_predictions(spark, d):
    """Rates where a page's prediction failed, which counts as an empty one."""
    p = turn_pairs(spark, d).withColumn("hyp", F.when(F.col("turn") % 4 != 0, F.col("hyp")))
    return metrics.corpus_rates(p, ["suite"], word_rate=False).select("suite", "char_edits", "chars", "n")


def table_pages(spark, d):
    """For each nation a table of its suppliers, and the same without its last row, with a name changed, unchanged, or no
    table at all, by the nation's number."""
    row = lambda x, more="": F.concat(F.lit("<tr><td>"), x["s_suppkey"].cast("string"), F.lit("</td><td>"), x["s_name"], F.lit(more), F.lit("</td></tr>"))
    page = lambda rows: F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))
    s = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("r"))
    kind, rows = F.col("s_nationkey") % 4, F.transform("r", lambda x: row(x))
    changed = F.transform("r", lambda x, i: F.when(i == 0, row(x, "x")).otherwise(row(x)))
    hyp = F.when(kind == 0, page(F.slice(rows, 1, F.size("r") - 1))).when(kind == 1, page(changed)).when(kind == 2, page(rows)).otherwise("no table")
    return s.select("s_nationkey", F.concat(F.lit("s"), (F.col("s_nationkey") % 3).cast("string")).alias("suite"), page(rows).alias("ref"), hyp.alias("hyp"))


#: Removing a row costs its three nodes, a changed text its share of edits: sizes differ by no more, and no fewer labels.
SCORES_SQL = """t AS (SELECT s_nationkey, count(*) AS r, length(min_by(s_name, s_suppkey)) AS len FROM supplier GROUP BY s_nationkey),
sc AS (SELECT s_nationkey, 's' || (s_nationkey % 3) AS suite, CASE s_nationkey % 4 WHEN 0 THEN 1 - 3.0::double / (1 + 3 * r) WHEN 1 THEN 1 - (1.0::double / (len + 1)) / (1 + 3 * r) WHEN 2 THEN 1.0::double ELSE 0.0::double END AS score FROM t)"""


@query(f"WITH {SCORES_SQL} SELECT s_nationkey, round(score, 12) AS score FROM sc")
def table_scores(spark, d):
    """Similarity of differing tables."""
    return table_pages(spark, d).select("s_nationkey", F.round(tables.table_similarity("hyp", "ref"), 12).alias("score"))


@query(f"WITH {SCORES_SQL} SELECT suite, round(100 * avg(score), 2) AS teds, count(*) AS teds_n FROM sc GROUP BY suite")
def table_summary(spark, d):
    """Mean similarity of each suite, with pages without any table left out, which half of the pages are here."""
    pages = table_pages(spark, d).select("suite", "ref", "hyp")
    plain = pages.select("suite", F.lit("text").alias("ref"), F.lit("other").alias("hyp"))
    p = scratch.stored(pages.unionByName(plain), "tables")
    return metrics.summary(p, p, ["suite"]).select("suite", "teds", "teds_n")


@query(f"""WITH b AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, {COLLAPSED} AS ref FROM documents WHERE lang IN ('en', 'fr')),
h AS (SELECT lang, i, length(ref) AS size, length(trim(regexp_replace(replace(ref, '.', ''), ' +', ' ', 'g'))) AS left_over FROM b WHERE ref <> ''),
l AS (SELECT * FROM (VALUES ('en', 'arocrbench_arabicocr', 0), ('fr', 'misraj_dococr[norm]', 1), ('fr', 'misraj_dococr[loop]', 2)) v(lang, label, kind))
SELECT label, round(sum(size - left_over)::double / sum(size), 4) AS cer, count(*) AS n, 1.0::double AS ratio FROM h JOIN l USING (lang)
WHERE CASE kind WHEN 0 THEN i < 20 WHEN 1 THEN i < 30 ELSE i IN ({", ".join(map(str, metrics.LOOP_PAGES))}) END GROUP BY label""")
def dev_run_record(spark, d):
    """The record of a development run, as its JSON says, against a baseline's that is the run's own. Hypotheses lack
    the full stops; the slices take the first rows of a suite, and listed ones."""
    at = fresh(spark, "dev")
    rows = metrics.first_rows(docs(spark, d).where("lang in ('en', 'fr')"), "lang", "doc_id", max(metrics.LOOP_PAGES) + 1).withColumn("i", F.col("i").cast("long"))
    said = T.collapse(F.coalesce("text", F.lit("")))
    suite = F.when(F.col("lang") == "en", "arocrbench_arabicocr").otherwise("misraj_dococr")
    sinks.save_predictions(rows.select(F.lit("r").alias("run"), suite.alias("suite"), "i", said.alias("ref"), F.replace(said, F.lit("."), F.lit("")).alias("hyp")), f"{at}/said")
    run.devrun(spark, f"{at}/said", f"{at}/first.json")
    run.devrun(spark, f"{at}/said", f"{at}/second.json", f"{at}/first.json")
    record = spark.read.text(f"{at}/second.json", wholetext=True).select(F.from_json("value", "suites map<string, struct<cer: double, wer: double, n: long, ratio: double>>").alias("r"))
    each = record.select(F.explode("r.suites").alias("label", "s")).where("s.n > 0")  # a suite may be too short for a slice
    return each.select("label", "s.cer", "s.n", F.round("s.ratio", 1).alias("ratio"))


@query(f"""WITH s AS (SELECT doc_id AS idx, {NORMED} AS response, (doc_id % 50 + 8)::int AS w, (doc_id % 31 + 10)::int AS h FROM documents WHERE doc_id % 7 <> 3)
SELECT idx, {PROMPT_SQL}[idx % 5 + 1] AS prompt, response, 'nakba_chosen' AS source, 'newspaper' AS domain, w, h FROM s WHERE {ROW_OK}""")
def builder_image_bytes(spark, d):
    """Images as bytes within a struct, whose headers are read; every seventh is cut off within its header."""
    size = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), size(F.col("doc_id") % 50 + 8), size(F.col("doc_id") % 31 + 10), F.unhex(F.lit("0802000000")))
    image = F.when(F.col("doc_id") % 7 == 3, F.substring(png, 1, 19)).otherwise(png)
    at = fresh(spark, "images")
    in_stored_order(docs(spark, d).select("doc_id", F.col("text").alias("chosen"), F.struct(image.alias("bytes"), F.lit(None).cast("string").alias("path")).alias("images")), "doc_id", at)
    rows = readers.indexed(spark, f"{at}/*.parquet").withColumn("idx", F.col("doc_id"))
    return builders.BUILDERS["nakba"](rows).drop("key")


@query("SELECT 'n' || n_nationkey AS stem, n_nationkey + 20 AS w, 30 AS h, n_name || ' كتاب' AS text FROM nation WHERE n_nationkey % 5 <> 0")
def image_text_files(spark, d):
    """Image files and texts in a legacy charset, one of each a nation; every fifth image is empty."""
    at = fresh(spark, "pairs")
    for r in read(spark, d, "nation").select("n_nationkey", "n_name").collect():  # the table of nations is fixed
        png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (r["n_nationkey"] + 20).to_bytes(4, "big") + (30).to_bytes(4, "big")
        for path, body in ((f"images/n{r['n_nationkey']}.png", png if r["n_nationkey"] % 5 else b""), (f"texts/n{r['n_nationkey']}.txt", f"{r['n_name']} كتاب".encode("windows-1256"))):
            sinks.write_bytes(spark, f"{at}/{path}", body)
    return readers.image_text_pairs(spark, f"{at}/images", f"{at}/texts").select("stem", "w", "h", "text")


@query(f"""WITH c AS (SELECT {NORMED} AS response FROM documents), v AS (SELECT count(*) AS n FROM c WHERE length(response) >= 2)
SELECT 'train' AS kind, greatest(n - 400, 0) * 2 AS n FROM v UNION ALL SELECT 'val', least(n, 400) * 2 FROM v UNION ALL SELECT 'read', count(*) * 2 FROM c UNION ALL SELECT 'invalid', 2 * count(*) FROM c WHERE length(response) < 2""")
def command_corpus(spark, d):
    """The commands that build two shards of files and merge them, and what their stats say."""
    at = fresh(spark, "command")
    for name, column in (("yousefmd", "text"), ("omar", "markdown")):
        in_stored_order(docs(spark, d).select("doc_id", F.col("text").alias(column)), "doc_id", f"{at}/sources/{name}")
    run.main(["build", "yousefmd", "omar", "--sources", f"{at}/sources", "--out", f"{at}/out"], spark)
    body = run.main(["merge", "--out", f"{at}/out"], spark)
    total = lambda rule: sum(x[rule] for x in body["dropped"].values())
    return spark.createDataFrame([("train", body["total_train"]), ("val", body["total_val"]), ("read", total("n")), ("invalid", total("invalid"))], "kind string, n long")
