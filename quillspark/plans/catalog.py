"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can state it.

`documents` stands for the corpus (lang for domain), `benchmark` for evaluation texts, consecutive user and assistant
turns of `conversations` for reference and hypothesis, slices of `embeddings` for low-rank factors; pipe tables are
rendered from `nation` and `region`. Every query reads its whole tables; rows are left out only where the operator itself
takes some (the first of a suite, every 72nd, listed pages).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import image as I
from ..functions import text as T
from ..operators import corpus, linalg, metrics, mix, pairs, tables, temporal, tiles
from ..sources import builders, readers, saved_datasets, scratch, sinks, tensor_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d):
    return read(spark, d, "documents")


def as_rows(spark, d):
    return docs(spark, d).select("doc_id", F.col("text").alias("response"), "source", F.col("lang").alias("domain"))


WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x1c-\x1f\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
COLLAPSED = rf"regexp_replace(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def flagship(spark: SparkSession, d: str, holdout: int = corpus.HOLDOUT) -> DataFrame:
    """Repair, validity, decontamination, holdout, then counts by source and domain of the training rows. One pass over
    the texts writes the clean rows' keys, which is all that the rest needs."""
    rows = as_rows(spark, d).withColumn("response", T.source_norm(F.col("response"))).where(corpus.valid(F.col("response")))
    clean = corpus.decontaminate(rows, read(spark, d, "benchmark"), "response").select("doc_id", "source", "domain")
    clean = scratch.stored(clean, "clean")
    return corpus.counts(corpus.with_holdout(clean, "domain", "doc_id", rows=holdout).where("split = 'train'"))


@query(rf"SELECT doc_id, {COLLAPSED} AS body FROM documents")
def text_normalize(spark, d):
    return docs(spark, d).select("doc_id", T.eval_norm(F.col("text")).alias("body"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '<b>(.*?)</b>', '**\1**', 'gs'), '<i>(.*?)</i>', '*\1*', 'gs'), '</?u>', '', 'g'), '</p>\s*<p>', chr(10) || chr(10), 'g'), '</?p>', '', 'g'), '^\s+|\s+$', '', 'g') AS md FROM pages""")
def html_markup_to_md(spark, d):
    return read(spark, d, "pages").select("page_id", T.html_to_md(F.col("html")).alias("md"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace('![a](b.png)' || replace(text, chr(10), chr(10) || chr(10) || chr(10)), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS body FROM documents")
def strip_refs_squeeze(spark, d):
    c = F.concat(F.lit("![a](b.png)"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n\n")))
    return docs(spark, d).select("doc_id", T.squeeze_blank_lines(T.drop_images(c)).alias("body"))


@query(rf"SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') ELSE text END AS body FROM documents")
def unwrap_fence(spark, d):
    fenced = F.when(F.length("text") % 2 == 0, F.concat(F.lit("```markdown\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", T.unwrap_fence(fenced).alias("body"))


@query("SELECT doc_id, array_to_string(list_reverse(string_split(text, '')), '') AS body FROM documents")
def reverse_text(spark, d):
    return docs(spark, d).select("doc_id", F.reverse("text").alias("body"))


PROMPT_SQL = "[" + ", ".join(f"'{p}'" for p in T.PROMPTS) + "]"


@query(f"SELECT doc_id, {PROMPT_SQL}[doc_id % 5 + 1] AS prompt FROM documents WHERE length(text) >= 2")
def assign_prompts_pre(spark, d):
    return docs(spark, d).where(corpus.valid(F.col("text"))).select("doc_id", T.prompt(F.col("doc_id")).alias("prompt"))


@query(f"SELECT doc_id, {PROMPT_SQL}[row_number() OVER (ORDER BY doc_id) % 5 + 1] AS prompt FROM documents WHERE length(text) >= 2 AND contains(text, '.')")
def assign_prompts_post(spark, d):
    rows = docs(spark, d).where(corpus.valid(F.col("text")) & F.contains("text", F.lit("."))).select("doc_id")
    return corpus.with_counter(rows, "doc_id").select("doc_id", T.prompt(F.col("i")).alias("prompt"))


@query("SELECT doc_id, source FROM documents WHERE text IS NOT NULL AND length(text) >= 2 AND NOT contains(coalesce(source, ''), 'src1')")
def valid_rows(spark, d):
    return docs(spark, d).where(corpus.valid(F.col("text")) & ~F.contains(F.coalesce("source", F.lit("")), F.lit("src1"))).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE doc_id % 72 = 0")
def every_kth(spark, d):
    """The operator itself is the sampling of every 72nd row."""
    return corpus.nth(docs(spark, d), "doc_id").select("doc_id")


@query("""SELECT p_partkey, coalesce(map {'Newspaper': 'newspaper', 'Book': 'doc_markdown', 'Map': 'line_real'}[c], 'line_real') AS domain
FROM (SELECT p_partkey, ['Newspaper', 'Book', 'Map', 'Other'][p_size % 4 + 1] AS c FROM part)""")
def category_domain_lookup(spark, d):
    name = F.concat(F.element_at(F.array(*map(F.lit, ["Newspaper", "Book", "Map", "Other"])), F.col("p_size") % 4 + 1), F.lit("-00001-of-00002.parquet"))
    return read(spark, d, "part").select("p_partkey", readers.category_domain(readers.category(name)).alias("domain"))


@query("""SELECT p_partkey, CASE WHEN a > b THEN greatest(28, trunc(w * sqrt(b::double / a::double))::int) ELSE w END AS w,
 CASE WHEN a > b THEN greatest(28, trunc(h * sqrt(b::double / a::double))::int) ELSE h END AS h
FROM (SELECT p_partkey, w, h, w::bigint * h::bigint AS a, CASE WHEN p_size % 2 = 0 THEN 1003520 ELSE 501760 END AS b
      FROM (SELECT p_partkey, p_size, (p_partkey % 3000 + 20)::int AS w, (p_size * 60)::int AS h FROM part))""")
def pixel_budget(spark, d):
    p = read(spark, d, "part").withColumns({"w": (F.col("p_partkey") % 3000 + 20).cast("int"), "h": (F.col("p_size") * 60).cast("int")})
    domain = F.when(F.col("p_size") % 2 == 0, "manuscript").otherwise("newspaper")
    return p.select("p_partkey", I.fit(F.col("w"), F.col("h"), I.budget(domain)).alias("s")).select("p_partkey", "s.w", "s.h")


@query("""SELECT l_orderkey, l_linenumber, greatest(0.0, least(l_quantity - 10, l_tax * 100))::double AS x0, greatest(0.0, least(l_discount * 100, l_quantity))::double AS y0,
 least(40.0, greatest(l_quantity - 10, l_tax * 100))::double AS x1, least(30.0, greatest(l_discount * 100, l_quantity))::double AS y1 FROM lineitem""")
def bbox_clamp(spark, d):
    pts = F.array(F.array(F.col("l_quantity") - 10, F.col("l_discount") * 100), F.array(F.col("l_tax") * 100, F.col("l_quantity")))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", I.box(pts, F.lit(40.0), F.lit(30.0)).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("SELECT n_nationkey, n_name AS transcription, least(n_nationkey, 3)::double AS x0 FROM nation WHERE n_name <> ''")
def annotation_extract(spark, d):
    tag = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    pts = F.struct(F.array(F.array(F.col("n_nationkey").cast("double"), F.lit(1.0)), F.array(F.lit(3.0), F.lit(2.0))).alias("exterior"))
    obj = F.struct(F.array(tag("Kind", F.lit("x")), tag("Transcription", F.col("n_name"))).alias("tags"), pts.alias("points"))
    none = F.struct(F.array(tag("Kind", F.lit("y"))).alias("tags"), pts.alias("points"))
    a = read(spark, d, "nation").withColumn("annotation", F.to_json(F.struct(F.array(obj, none).alias("objects"))))
    return readers.regions(a).select("n_nationkey", "transcription", I.box(F.col("points"), F.lit(50.0), F.lit(50.0))["x0"].alias("x0"))


PROBES = rf"SELECT DISTINCT left({COLLAPSED}, 40) AS probe FROM benchmark"
DIRTY = rf"EXISTS (SELECT 1 FROM ({PROBES}) p WHERE probe <> '' AND contains(body, probe))"


@query(rf"SELECT id FROM (SELECT CASE WHEN copy = 1 THEN doc_id END AS id, {COLLAPSED} AS body FROM documents, range(2) r(copy)) WHERE NOT {DIRTY}")
def decontaminate_rows(spark, d):
    """Every document twice, once without its id: rows are judged by their texts."""
    twice = docs(spark, d).select(F.explode(F.array(F.lit(None).cast("long"), F.col("doc_id"))).alias("id"), "text")
    return corpus.decontaminate(twice, read(spark, d, "benchmark"), "text").select("id")


#: Probes of every document: what follows its first PLACE characters. Texts are met by heads, as positions of both sides.
LONG = 48


@query(rf"""WITH b AS (SELECT doc_id, {COLLAPSED} AS body FROM documents), p AS (SELECT DISTINCT substr(body, 1 + {LONG}, 40) AS probe FROM b WHERE length(body) >= {LONG} + 40),
w AS (SELECT doc_id, body, unnest(range(1, length(body) - 38)) AS pos FROM b WHERE length(body) >= 40)
SELECT doc_id, count(DISTINCT probe) > 0 AS dirty FROM b LEFT JOIN (SELECT w.doc_id, probe FROM w JOIN p ON substr(w.body, pos, 40) = probe) USING (doc_id) GROUP BY doc_id""")
def probe_filter(spark, d):
    """Which documents hold the 40 characters from the 49th on of any document: a probe list as long as the corpus."""
    rows = docs(spark, d).select("doc_id", T.collapse(F.coalesce("text", F.lit(""))).alias("body"))
    own = rows.where(F.length("body") >= LONG + corpus.PROBE).select(F.substring("body", 1 + LONG, corpus.PROBE).alias("probe")).distinct()
    return corpus.flagged(rows.select("doc_id", "body"), own, "body").select("doc_id", "dirty")


@query(rf"SELECT doc_id FROM (SELECT doc_id, {COLLAPSED} AS body FROM documents) WHERE NOT {DIRTY}")
def decontaminate_shingles(spark, d):
    return corpus.decontaminate(docs(spark, d).select("doc_id", "text"), read(spark, d, "benchmark"), "text").select("doc_id")


@query(rf"""WITH g AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id),
bad AS (SELECT conv_id FROM (SELECT conv_id, {COLLAPSED} AS body FROM g) WHERE {DIRTY})
SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM bad)""")
def decontaminate_groups(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "text")
    return corpus.decontaminate_groups(c, read(spark, d, "benchmark"), "conv_id", "turn", "text").select("conv_id", "turn")


def _order(seed):
    return f"md5('{seed}:' || doc_id), doc_id"


@query(f"SELECT doc_id, lang AS domain, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_order(42)}) <= 400 THEN 'val' ELSE 'train' END AS split FROM documents")
def stratified_holdout(spark, d):
    return corpus.with_holdout(as_rows(spark, d).select("doc_id", "domain"), "domain", "doc_id")


@query("SELECT source, domain, n FROM (SELECT source, lang AS domain, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang), ()))")
def corpus_stats(spark, d):
    return corpus.counts(as_rows(spark, d))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_order(42)}) AS place FROM documents")
def seeded_shuffle(spark, d):
    keyed = docs(spark, d).select("doc_id", corpus.seeded(42, F.col("doc_id")).alias("h"))
    return corpus.with_counter(keyed, ["h", "doc_id"], "place").select("doc_id", "place")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_order(42)}) AS r, count(*) OVER () AS n FROM documents) WHERE r <= trunc(n * 0.29::double)")
def exact_sample(spark, d):
    return corpus.exact_sample(docs(spark, d).select("doc_id"), 0.29, "doc_id")


@query(f"SELECT doc_id FROM documents ORDER BY {_order(42)} LIMIT 2000")
def smoke_subset(spark, d):
    """The operator itself takes 2,000 rows."""
    return mix.smoke(docs(spark, d).select("doc_id"), "doc_id")


def _mix_sql(weights, seed, group="lang", table="documents"):
    cases = " ".join(f"WHEN '{k}' THEN {v}::double" for k, v in weights.items())
    return f"""WITH w AS (SELECT *, CASE {group} {cases} END AS wt, {group} AS part FROM {table}),
r AS (SELECT *, count(*) OVER (PARTITION BY part) AS n, row_number() OVER (PARTITION BY part ORDER BY {_order(seed)}) AS r FROM w WHERE wt > 0),
k AS (SELECT *, floor(wt)::bigint + CASE WHEN r <= floor(n * (wt - floor(wt))) THEN 1 ELSE 0 END AS k FROM r)
SELECT doc_id, unnest(range(1, k + 1))::int AS copy FROM k WHERE k > 0"""


@query(_mix_sql({"en": 2.5, "fr": 2.5, "de": 2.5, "es": 2.5}, 42))
def oversample(spark, d):
    return mix.weighted(docs(spark, d).select("doc_id", "lang"), F.lit(2.5), "lang", "doc_id", 42).select("doc_id", "copy")


DOMAIN_OF = {"en": "doc_markdown", "fr": "newspaper", "de": "line_real", "es": "line_synth"}
DOMAIN_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DOMAIN_OF.items()) + " END"


def domains(spark, d):
    c = F.col("lang")
    m = F.create_map(*[F.lit(x) for kv in DOMAIN_OF.items() for x in kv])
    return docs(spark, d).select("doc_id", F.when(F.col("source") == "src3", "img2md").otherwise(F.col("source")).alias("source"), F.try_element_at(m, c).alias("domain"), "text")


@query(_mix_sql(mix.RECIPES["1"].domains, 42, "domain", f"(SELECT doc_id, {DOMAIN_SQL} AS domain FROM documents)"))
def domain_mix(spark, d):
    return mix.mix(domains(spark, d), mix.RECIPES["1"], "doc_id").select("doc_id", "copy")


@query(_mix_sql(mix.RECIPES["5"].domains | {"s:img2md": 1.0}, 45, "domain", f"(SELECT doc_id, CASE WHEN source = 'src3' THEN 's:img2md' ELSE {DOMAIN_SQL} END AS domain FROM documents)"))
def source_override_mix(spark, d):
    return mix.mix(domains(spark, d), mix.RECIPES["5"], "doc_id").select("doc_id", "copy")


def pipe_tables(spark, d):
    """A page for each region with a pipe table of its nations."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("| "), x["n_nationkey"].cast("string"), F.lit(" | "), x["n_name"], F.lit(" |")))
    page = F.concat(F.lit("Table of "), "r_name", F.lit("\n| id | nation |\n| --- | --- |\n"), F.array_join(rows, "\n"), F.lit("\nend | of table"))
    return n.groupBy("r_regionkey", "r_name").agg(page.alias("text"))


PIPE_SQL = """SELECT r_regionkey, r_name, 'Table of ' || r_name || chr(10) || '| id | nation |' || chr(10) || '| --- | --- |' || chr(10) ||
 string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) || 'end | of table' AS text
 FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"""
HTML_SQL = """'<table>' || chr(10) || '<tr><td>id</td><td>nation</td></tr>' || chr(10) ||
 string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', chr(10) ORDER BY n_nationkey) || chr(10) || '</table>'"""


@query(_mix_sql({"t": 2.0} | mix.RECIPES["6"].domains, 48, "domain", f"(SELECT doc_id, {DOMAIN_SQL} AS domain FROM documents UNION ALL SELECT r_regionkey - 100 AS doc_id, 't' AS domain FROM region)"))
def table_mix(spark, d):
    pages = pipe_tables(spark, d).select((F.col("r_regionkey").cast("long") - 100).alias("doc_id"), F.lit("tables").alias("source"), F.lit("none").alias("domain"), "text")
    rows = domains(spark, d).unionByName(pages)
    return mix.mix(rows, mix.RECIPES["6"], "doc_id", T.has_md_table(F.col("text"))).select("doc_id", "copy")


#: A group's size is 3 to 6 by a hash of its number; starts are the running sums.
STACK_SQL = """sz AS (SELECT g AS grp, 3 + ('0x' || substr(md5('42:' || g), 1, 15))::bigint % 4 AS want FROM range((SELECT count(*) FROM src)) r(g)),
st AS (SELECT grp, want, coalesce(sum(want) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM sz),
pl AS (SELECT grp, want, unnest(range(start, start + want)) AS nr FROM st),
ln AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS nr FROM src),
sk AS (SELECT grp, count(*) AS n, string_agg(text, chr(10) ORDER BY id) AS text, max(w) AS widest, list(w ORDER BY id) AS ws, list(h ORDER BY id) AS hs FROM ln JOIN pl USING (nr) GROUP BY grp, want HAVING count(*) = want),
ss AS (SELECT grp, n, text, (widest + 20)::bigint AS w, (list_sum([greatest(1, floor(hs[k] * widest / ws[k]))::bigint for k in range(1, n + 1)]) + 10 * (n + 1))::bigint AS h FROM sk)"""


@query(f"WITH src AS (SELECT doc_id AS id, text, (doc_id % 70 + 30)::int AS w, (doc_id % 9 + 1)::int AS h FROM documents), {STACK_SQL} SELECT grp, n, text, w, h FROM ss")
def stacked_groups(spark, d):
    rows = docs(spark, d).select("doc_id", "text", (F.col("doc_id") % 70 + 30).cast("int").alias("w"), (F.col("doc_id") % 9 + 1).cast("int").alias("h"))
    return corpus.stacks(rows, "doc_id", "text").select("grp", "n", "text", I.stack(F.col("widths"), F.col("heights")).alias("s")).select("grp", "n", "text", "s.w", "s.h")


def turn_pairs(spark, d):
    """Reference: a user turn; hypothesis: the assistant turn after it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = read(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "next": F.lead("text").over(w)})
    c = c.where("role = 'user' and next_role = 'assistant'")
    return c.select("conv_id", "turn", F.concat(F.lit("s"), (F.col("conv_id") % 5).cast("string")).alias("suite"), T.eval_norm(F.col("text")).alias("ref"), T.eval_norm(F.col("next")).alias("hyp"))


#: DuckDB counts bytes; letters beyond ASCII are mapped one to one on unused single bytes.
ODD = "éèêçàâîôûùëïüöäßñáíóúÉÈÊÇÀÂÎÔÛÙËÏÜÖÄÑÁÍÓÚ"
SPARE = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32), *map(ord, "~`^{}[]\\<>@_;+")][: len(ODD)])
PAIRS_SQL = f"""p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn, 's' || (conv_id % 5) AS suite, {COLLAPSED} AS ref, {COLLAPSED.replace("text", "next")} AS hyp FROM p WHERE role = 'user' AND next_role = 'assistant'),
e AS (SELECT *, levenshtein(translate(ref, '{ODD}', {SPARE}), translate(hyp, '{ODD}', {SPARE})) AS edits FROM q WHERE ref <> '')"""


@query(f"WITH {PAIRS_SQL} SELECT suite, sum(edits)::bigint AS char_edits, sum(length(ref))::bigint AS chars, count(*) AS n FROM e GROUP BY suite")
def corpus_cer(spark, d):
    return metrics.corpus_rates(turn_pairs(spark, d), ["suite"], word_rate=False).select("suite", "char_edits", "chars", "n")


#: Word edits row by row of the table of distances: what comes from above and from the diagonal, then insertions as a
#: running minimum along the row.
WORDS_SQL = f"""{PAIRS_SQL}, tw AS (SELECT conv_id * 1000 + turn AS id, suite, string_split(ref, ' ') AS r, CASE WHEN hyp = '' THEN [] ELSE string_split(hyp, ' ') END AS h FROM q WHERE ref <> ''),
ed AS (SELECT id, 0 AS i, j, j AS v FROM tw, unnest(range(0, len(h) + 1)) u(j)
 UNION ALL SELECT id, i + 1, j, j + min(t - j) OVER (PARTITION BY id ORDER BY j) FROM (
  SELECT ed.id, ed.i, ed.j, CASE WHEN ed.j = 0 THEN ed.v + 1 ELSE least(ed.v + 1, lag(ed.v) OVER (PARTITION BY ed.id ORDER BY ed.j) + (tw.r[ed.i + 1] <> tw.h[ed.j])::int) END AS t
  FROM ed JOIN tw ON ed.id = tw.id WHERE ed.i < len(tw.r)) s),
we AS (SELECT tw.suite, ed.v, len(tw.r) AS words FROM ed JOIN tw ON ed.id = tw.id AND ed.i = len(tw.r) AND ed.j = len(tw.h))"""


@query(f"WITH RECURSIVE {WORDS_SQL} SELECT suite, sum(v)::bigint AS word_edits, sum(words)::bigint AS words, count(*) AS n FROM we GROUP BY suite")
def corpus_wer(spark, d):
    return metrics.corpus_rates(turn_pairs(spark, d), ["suite"]).select("suite", "word_edits", "words", "n")


@query(f"""WITH RECURSIVE {WORDS_SQL}, c AS (SELECT suite, round(sum(edits)::double / sum(length(ref)), 4) AS cer, count(*) AS n FROM e GROUP BY suite)
SELECT suite, cer, (SELECT round(sum(v)::double / sum(words), 4) FROM we WHERE we.suite = c.suite) AS wer, n, NULL::double AS teds, NULL::bigint AS teds_n FROM c""")
def suite_summary(spark, d):
    """Rates, and table similarity where a page has a table (none here)."""
    p = scratch.stored(turn_pairs(spark, d), "pairs")
    return metrics.summary(p, p, ["suite"])


RATIO = "length(hyp)::double / greatest(length(ref), 1)"


@query(f"WITH {PAIRS_SQL} SELECT CASE WHEN {RATIO} > 2 THEN 'looper' WHEN {RATIO} BETWEEN 0.8 AND 1.2 THEN 'good' END AS bucket, count(*) AS n, sum(floor(1e6 * edits / greatest(length(ref), 1)))::bigint AS cer_ppm FROM e GROUP BY 1")
def mean_cer_by_bucket(spark, d):
    p = turn_pairs(spark, d).where("ref <> ''")
    each = F.floor(F.lit(1e6) * metrics.char_edits(F.col("ref"), F.col("hyp")) / F.greatest(F.length("ref"), F.lit(1)))
    return p.groupBy(metrics.bucket(T.length_ratio(F.col("ref"), F.col("hyp"))).alias("bucket")).agg(F.count("*").alias("n"), F.sum(each).alias("cer_ppm"))


RAW_SQL = f"""rp AS (SELECT 'c' || (turn % 5) AS config, text AS ref, next AS hyp FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"""


@query(f"""WITH {RAW_SQL} SELECT config, CASE WHEN {RATIO} > 2 THEN 'looper' WHEN {RATIO} BETWEEN 0.8 AND 1.2 THEN 'good' END AS bucket,
 round(avg(CASE WHEN length(ref) = 0 THEN 'nan'::double ELSE levenshtein(translate(ref, '{ODD}', {SPARE}), translate(hyp, '{ODD}', {SPARE}))::double / greatest(length(ref), 1) END), 6) AS mean_cer,
 round(avg({RATIO}), 6) AS mean_ratio, count(*) AS n FROM rp GROUP BY 1, 2""")
def decode_sweep(spark, d):
    """Mean rates by configuration and bucket, of raw texts."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = read(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "hyp": F.lead("text").over(w)})
    c = c.where("role = 'user' and next_role = 'assistant'").withColumnRenamed("text", "ref")
    c = c.select(F.concat(F.lit("c"), (F.col("turn") % 5).cast("string")).alias("config"), metrics.bucket(T.length_ratio(F.col("ref"), F.col("hyp"))).alias("bucket"), "ref", "hyp")
    return metrics.sweep(c, ["config", "bucket"]).select("config", "bucket", F.round("mean_cer", 6).alias("mean_cer"), F.round("mean_ratio", 6).alias("mean_ratio"), "n")


@query(f"""WITH {PAIRS_SQL}, b AS (SELECT conv_id, turn, CASE WHEN {RATIO} > 2 THEN 'looper' WHEN {RATIO} BETWEEN 0.8 AND 1.2 THEN 'good' END AS bucket FROM q)
SELECT * FROM (SELECT conv_id, turn, bucket, row_number() OVER (PARTITION BY bucket ORDER BY conv_id * 1000 + turn) AS rn FROM b WHERE bucket IS NOT NULL) WHERE rn <= 6""")
def loop_triage(spark, d):
    p = turn_pairs(spark, d).withColumn("i", F.col("conv_id") * 1000 + F.col("turn"))
    return metrics.triage(p, T.length_ratio(F.col("ref"), F.col("hyp")), "i").select("conv_id", "turn", "bucket", "rn")


def run_summary(spark, d, which: int):
    """A summary by language; `which` varies the figures and the languages covered."""
    s = docs(spark, d).groupBy(F.col("lang").alias("suite")).agg(F.count("*").alias("n"))
    return s.where(F.col("suite") != ("es" if which else "fr")).withColumn("cer", (F.col("n") % (7 + which)) / 10.0)


def _summary_sql(which):
    return f"(SELECT lang AS suite, count(*) AS n, (count(*) % {7 + which}) / 10.0::double AS cer FROM documents WHERE lang <> '{'es' if which else 'fr'}' GROUP BY lang)"


@query(f"SELECT suite, n, cer FROM {_summary_sql(0)} WHERE suite NOT IN (SELECT suite FROM {_summary_sql(1)}) UNION ALL SELECT suite, n, cer FROM {_summary_sql(1)}")
def summary_upsert(spark, d):
    return metrics.upsert(run_summary(spark, d, 0), run_summary(spark, d, 1), ["suite"])


@query(f"SELECT a.suite, CASE WHEN b.cer = 0 THEN 'infinity'::double ELSE a.cer / b.cer END AS ratio FROM {_summary_sql(0)} a LEFT JOIN {_summary_sql(1)} b USING (suite)")
def baseline_ratio(spark, d):
    b = run_summary(spark, d, 1).select("suite", F.col("cer").alias("base"))
    return run_summary(spark, d, 0).join(b, "suite", "left").select("suite", metrics.ratio_to(F.col("cer"), F.col("base")).alias("ratio"))


@query(f"""SELECT suite, cer > lim AS aborted, CASE WHEN cer > lim THEN 'canary CER ' || printf('%.4f', cer) || ' > ' || printf('%.4f', lim) END AS reason
FROM (SELECT a.suite, a.cer, coalesce(4.0::double * b.cer, 0.2::double) AS lim FROM {_summary_sql(0)} a LEFT JOIN {_summary_sql(1)} b USING (suite))""")
def canary_gate(spark, d):
    b = run_summary(spark, d, 1).select("suite", F.col("cer").alias("base"))
    cer, base = F.col("cer"), F.col("base")
    return run_summary(spark, d, 0).join(b, "suite", "left").select("suite", metrics.canary(cer, base).alias("aborted"), metrics.canary_reason(cer, base).alias("reason"))


@query(f"SELECT a.suite, a.cer, b.cer AS base_cer, coalesce(a.cer > b.cer, false) AS regressed, row_number() OVER (ORDER BY a.cer DESC, a.suite) AS place FROM {_summary_sql(1)} a LEFT JOIN {_summary_sql(0)} b USING (suite)")
def leaderboard(spark, d):
    """A row a suite: the window is over a handful."""
    out = metrics.leaderboard(run_summary(spark, d, 1), run_summary(spark, d, 0))
    return out.select("suite", "cer", "base_cer", "regressed", F.row_number().over(W.orderBy(F.desc("cer"), "suite")).alias("place"))


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id, lang || '[norm]' AS slice FROM r WHERE i < 30 UNION ALL SELECT doc_id, lang || '[loop]' FROM r WHERE i IN ({", ".join(map(str, metrics.LOOP_PAGES))})""")
def dev_slices(spark, d):
    """The operator itself takes the first 30 rows of a suite, and listed ones."""
    r = metrics.first_rows(docs(spark, d).select("doc_id", "lang"), "lang", "doc_id", max(metrics.LOOP_PAGES) + 1)
    normal = r.where("i < 30").select("doc_id", F.concat("lang", F.lit("[norm]")).alias("slice"))
    return normal.unionByName(r.where(F.col("i").isin(metrics.LOOP_PAGES)).select("doc_id", F.concat("lang", F.lit("[loop]")).alias("slice")))


@query(f"""SELECT -1 - r_regionkey::bigint AS id, 'Table of ' || r_name || chr(10) || {HTML_SQL} || chr(10) || 'end | of table' AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name
UNION ALL SELECT doc_id AS id, text FROM documents""")
def md_tables_to_html(spark, d):
    pages = pipe_tables(spark, d).select((-1 - F.col("r_regionkey").cast("long")).alias("id"), "text").unionByName(docs(spark, d).select(F.col("doc_id").alias("id"), "text"))
    return pages.select("id", tables.md_tables_to_html(F.col("text")).alias("text"))


@query(f"SELECT r_regionkey, replace(text, '| --- | --- |', '|---|---|') AS text FROM ({PIPE_SQL})")
def html_tables_to_md(spark, d):
    return pipe_tables(spark, d).select("r_regionkey", tables.html_tables_to_md(tables.md_tables_to_html(F.col("text"))).alias("text"))


@query("SELECT -1 - r_regionkey::bigint AS id, true AS is_table FROM region UNION ALL SELECT doc_id AS id, len(regexp_extract_all(text, '(?m)^[ \\t]*\\|.*\\|[ \\t]*$')) >= 2 AS is_table FROM documents")
def has_md_table(spark, d):
    pages = pipe_tables(spark, d).select((-1 - F.col("r_regionkey").cast("long")).alias("id"), "text").unionByName(docs(spark, d).select(F.col("doc_id").alias("id"), "text"))
    return pages.select("id", T.has_md_table(F.col("text")).alias("is_table"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_name = b.n_name THEN 0.0::double ELSE levenshtein(a.n_name, b.n_name)::double / greatest(length(a.n_name), length(b.n_name)) END AS distance
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def table_content_distance(spark, d):
    n = read(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", tables.content_distance(F.col("x"), F.col("y")).alias("distance"))


@query()
def table_similarity(spark, d):
    """The tables of every two regions, and a page without a table; held against brute force in tests."""
    html = pipe_tables(spark, d).select("r_regionkey", tables.md_tables_to_html(F.col("text")).alias("html"))
    a, b = html.toDF("a", "x"), html.toDF("b", "y").unionByName(spark.createDataFrame([(-1, "none")], "b int, y string"))
    return a.join(b, F.col("a") >= F.col("b")).select("a", "b", tables.table_similarity("x", "y").alias("score"))


@query(f"""WITH {PAIRS_SQL}, k AS (SELECT conv_id * 1000 + turn AS doc_id, ref, hyp FROM q)
SELECT doc_id FROM (SELECT doc_id, ref, hyp, row_number() OVER (ORDER BY substr(md5('42:' || doc_id), 1, 15), doc_id) AS r FROM k) WHERE r <= 100 AND ref <> '' AND hyp <> '' AND ref <> hyp""")
def preference_pairs(spark, d):
    """The operator itself takes a number of shuffled pairs before it filters."""
    p = turn_pairs(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("ref").alias("rejected"), F.col("hyp").alias("chosen"))
    return pairs.preference_pairs(p, "doc_id", 100).select("doc_id")


@query(f"WITH {PAIRS_SQL} SELECT conv_id, turn, 'user' AS first_role, 'assistant' AS last_role, 3 AS parts, {PROMPT_SQL}[conv_id % 5 + 1] AS prompt, hyp AS answer FROM q")
def chat_template(spark, d):
    p = turn_pairs(spark, d).select("conv_id", "turn", pairs.messages(T.prompt(F.col("conv_id")), F.col("hyp")).alias("m"))
    parts = F.size(F.flatten(F.transform("m", lambda x: x["content"])))
    return p.select("conv_id", "turn", F.col("m")[0]["role"].alias("first_role"), F.col("m")[1]["role"].alias("last_role"), parts.alias("parts"), F.col("m")[0]["content"][1]["text"].alias("prompt"), F.col("m")[1]["content"][0]["text"].alias("answer"))


SIDE = 12


def adapters(spark, d):
    """Two adapters of whole numbers: of each 4 * SIDE embeddings, the first and the next SIDE are A and B of one module of
    the first adapter, the others of the second. A vector's entries are the rank."""
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    group, side = F.floor(F.col("vec_id") / SIDE), F.col("vec_id") % SIDE
    e = e.select(F.concat(F.lit("a"), (F.floor(group / 2) % 2).cast("string")).alias("adapter"), F.concat(F.lit("m"), F.floor(group / 4).cast("string")).alias("module"), (group % 2).alias("which"), F.col("k").cast("long").alias("k"), side.alias("s"), F.round(F.col("x") * 100).cast("double").alias("v"))
    is_a = F.col("which") == 0
    cells = e.select("adapter", "module", F.when(is_a, "A").otherwise("B").alias("factor"), F.when(is_a, F.col("k")).otherwise(F.col("s")).alias("i"), F.when(is_a, F.col("s")).otherwise(F.col("k")).alias("j"), "v")
    config = spark.createDataFrame([("a0", 64, 128.0, 0.5, "q,v", False, "b"), ("a1", 64, 128.0, 0.5, "q,v", False, "b")], "adapter string, r int, alpha double, coeff double, target_modules string, use_rslora boolean, base string")
    return cells, config


def base_tensors(spark, d):
    """Matrices of SIDE x SIDE; every seventh module has one column more, every fifth is not in the base."""
    m = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / (4 * SIDE)).alias("m")).distinct().where("m % 5 <> 4")
    m = m.select("m", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("i"))
    m = m.select("m", F.col("i").cast("long").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("m") % 7 == 6, SIDE).otherwise(SIDE - 1).cast("long"))).alias("j"))
    return m.select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("module"), "i", "j", F.pmod(F.col("m") * 7 + F.col("i") * 31 + F.col("j") * 17, F.lit(101)).cast("double").alias("v"))


ADAPTER_SQL = f"""em AS (SELECT vec_id, unnest(range(0, len(embedding))) AS k, unnest(embedding) AS x FROM embeddings),
f AS (SELECT vec_id // {SIDE} AS g, vec_id % {SIDE} AS s, k, round(x::double * 100) AS v FROM em),
p AS (SELECT a.g // 4 AS m, b.s AS i, a.s AS j, sum(0.5::double * b.v * a.v) AS v FROM f a JOIN f b ON b.g = a.g + 1 AND a.g % 2 = 0 AND a.k = b.k GROUP BY ALL),
dims AS (SELECT m, max(i) + 1 AS r, max(j) + 1 AS c FROM p GROUP BY m),
bm AS (SELECT DISTINCT vec_id // {4 * SIDE} AS m FROM embeddings WHERE vec_id // {4 * SIDE} % 5 <> 4),
bs AS (SELECT m, i, j, ((m * 7 + i * 31 + j * 17) % 101)::double AS v FROM (SELECT m, unnest(range(0, {SIDE})) AS i FROM bm) x, range({SIDE} + 1) y(j) WHERE j < {SIDE} OR m % 7 = 6),
fits AS (SELECT m FROM dims JOIN (SELECT m, max(i) + 1 AS r, max(j) + 1 AS c FROM bs GROUP BY m) b USING (m, r, c)),
mg AS (SELECT bs.m, bs.i, bs.j, bs.v AS old, (bs.v + 2.0::double * coalesce(p.v, 0))::float::double AS v FROM bs LEFT JOIN (SELECT * FROM p WHERE m IN (SELECT m FROM fits)) p USING (m, i, j))"""


@query(f"WITH {ADAPTER_SQL} SELECT 'm' || m AS module, i, j, v FROM p")
def adapter_soup(spark, d):
    """The last module may be in one adapter alone, which a checked soup would refuse."""
    return tiles.cells(tiles.product(factor_tiles(spark, d)), size=BLOCK).select("module", "i", "j", "v")


#: Side of a tile, small enough for several blocks a matrix.
BLOCK = 8


def factor_tiles(spark, d):
    factors, config = adapters(spark, d)
    return tiles.soup(tiles.tiled(factors, ["adapter", "module", "factor"], BLOCK), config, check=False)


@query(f"WITH {ADAPTER_SQL} SELECT 'm' || m AS module, i, j, v, v <> old AS changed FROM mg")
def adapter_merge(spark, d):
    """Merged in the base's own type, floats."""
    base = tiles.tiled(base_tensors(spark, d), size=BLOCK, dtype="F32")
    merged = tiles.cells(tiles.merge(base, factor_tiles(spark, d), 2.0, BLOCK), size=BLOCK)
    old = base_tensors(spark, d).withColumnRenamed("v", "old")
    return merged.join(old, ["module", "i", "j"]).select("module", "i", "j", "v", (F.col("v") != F.col("old")).alias("changed"))


@query(f"""WITH {ADAPTER_SQL} SELECT (SELECT count(*) FROM dims) AS targets, (SELECT count(*) FROM dims WHERE m IN (SELECT m FROM bm) AND m NOT IN (SELECT m FROM fits)) AS mismatched,
(SELECT count(*) FROM dims WHERE m NOT IN (SELECT m FROM bm)) AS missing, (SELECT max(abs(v - old)) FROM mg) AS max_change, (SELECT count(*) FROM fits) AS applied""")
def adapter_merge_report(spark, d):
    base, factors = tiles.tiled(base_tensors(spark, d), size=BLOCK, dtype="F32"), factor_tiles(spark, d)
    return tiles.merge_report(tiles.merge(base, factors, 2.0, BLOCK), factors, BLOCK)


@query(f"""WITH t AS (SELECT DISTINCT vec_id // {4 * SIDE} AS m, vec_id // {2 * SIDE} % 2 AS a, vec_id // {SIDE} % 2 AS f FROM embeddings), per AS (SELECT m, a, count(*) AS n FROM t GROUP BY m, a)
SELECT 2::bigint AS adapters, false AS bad_sum, false AS bad_scale, false AS mismatch, (SELECT count(*) FROM per WHERE n < 2) AS incomplete, (SELECT count(*) FROM (SELECT m FROM per GROUP BY m HAVING count(*) < 2)) AS unshared, 0::bigint AS not_factors""")
def adapter_guards(spark, d):
    return linalg.guards(*adapters(spark, d))


@query("SELECT 'checkpoint-' || max(n_nationkey) AS latest FROM nation")
def latest_checkpoint(spark, d):
    names = read(spark, d, "nation").select(F.concat(F.lit("checkpoint-"), F.col("n_nationkey").cast("string")).alias("name"))
    return names.agg(F.max_by("name", F.split("name", "-")[1].cast("int")).alias("latest"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'model.' || lower(n_name) || '.weight' WHEN 1 THEN 'visual.' || lower(n_name) || '.weight' END AS tensor FROM nation")
def tensor_names(spark, d):
    part = F.element_at(F.array(F.lit("language_model."), F.lit("visual."), F.lit("language_model.")), F.col("n_nationkey") % 3 + 1)
    name = F.concat(F.lit("base_model.model.model."), part, F.lower("n_name"), F.when(F.col("n_nationkey") % 3 == 2, ".weight").otherwise(".lora_A.weight"))
    return read(spark, d, "nation").select("n_nationkey", T.tensor_name(name).alias("tensor"))


@query(rf"""WITH c AS (SELECT doc_id, source, {COLLAPSED} AS body FROM documents), k AS (SELECT *, length(body) < 2 AS bad, contains(coalesce(source, ''), 'src1') AS out, {DIRTY} AS dirty FROM c)
SELECT count(*) AS n, count(*) FILTER (out) AS excluded, count(*) FILTER (NOT out AND bad) AS invalid, count(*) FILTER (NOT out AND NOT bad AND dirty) AS contaminated FROM k""")
def dropped_counters(spark, d):
    """What a build drops, by the first rule that applies."""
    rows = docs(spark, d).select("doc_id", "text", F.contains(F.coalesce("source", F.lit("")), F.lit("src1")).alias("out"), (~corpus.valid(T.source_norm(F.col("text")))).alias("bad"))
    seen = corpus.flagged(rows, corpus.probes(read(spark, d, "benchmark")), "text")
    return seen.agg(F.count("*").alias("n"), F.count_if("out").alias("excluded"), F.count_if(~F.col("out") & F.col("bad")).alias("invalid"), F.count_if(~F.col("out") & ~F.col("bad") & F.col("dirty")).alias("contaminated"))


@query(ORACLE["dropped_counters"])
def build_counters(spark, d):
    """The same counts from the pass that builds and writes a shard, of a source like the scanned paragraphs but with
    rows excluded by their own source."""
    spec = replace(builders.SOURCES["khatt_para"], excluded="src1")
    counts, probes = Observation(), corpus.probes(read(spark, d, "benchmark"))
    rows = builders.used(docs(spark, d).withColumnRenamed("doc_id", "idx"), spec, counts, dirty=lambda x: corpus.flagged(x, probes, "response", "_dirty"))
    rows = builders.rows(rows, F.lit(spec.tag), F.lit(spec.domain), None)
    sinks.save_shard(rows, f"{scratch.folder(spark)}/counted-{uuid.uuid4().hex}", counts=counts)
    return spark.createDataFrame([tuple(counts.get[c] for c in ("n", "excluded", "invalid", "contaminated"))], "n long, excluded long, invalid long, contaminated long")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def keyed_join(spark, d):
    return read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query(f"SELECT source, domain, n FROM (WITH c AS (SELECT doc_id, source, lang AS domain FROM (SELECT *, {COLLAPSED} AS body FROM documents) WHERE length(body) >= 2 AND NOT {DIRTY}), h AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {_order(42)}) AS r FROM c) SELECT source, domain, count(*) AS n FROM h WHERE r > 400 GROUP BY GROUPING SETS ((source), (domain), ()))")
def corpus_build(spark, d):
    return flagship(spark, d)


# the builders, over stand-ins for their sources: documents with sizes, conversations, pages, annotations of nations

NORMED = rf"regexp_replace(regexp_replace(coalesce(text, ''), '[\x{{200b}}\x{{200e}}\x{{200f}}\x{{feff}}]', '', 'g'), '^{WS}+|{WS}+$', '', 'g')"
SIZED_SQL = f"s AS (SELECT doc_id AS idx, source AS own, {NORMED} AS response, (doc_id % 50 + 8)::int AS w, (doc_id % 31 + 10)::int AS h FROM documents)"
ROW_OK = "length(response) >= 2 AND least(w, h) >= 12"


def sized_docs(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("idx"), "text", F.col("text").alias("markdown"), F.col("text").alias("chosen"), "source", (F.col("doc_id") % 50 + 8).cast("int").alias("w"), (F.col("doc_id") % 31 + 10).cast("int").alias("h"))


PLAIN = ["aallail", "yousefmd", "nakba", "omar", "okai", "mssqpi", "presightai", "hastyle", "img2md"]


def _plain_sql(name):
    spec = builders.SOURCES[name]
    text = r"regexp_replace(response, '\n{3,}', chr(10) || chr(10), 'g')" if name in ("hastyle", "img2md") else "response"
    place = "row_number() OVER (ORDER BY idx)" if spec.after else "idx"
    keep = ROW_OK + (f" AND NOT contains(coalesce(own, ''), '{spec.excluded}')" if spec.excluded else "") + (f" AND idx % {spec.every} = 0" if spec.every > 1 else "")
    return f"SELECT idx, {PROMPT_SQL}[{place} % 5 + 1] AS prompt, response, '{spec.tag}' AS source, '{spec.domain}' AS domain, w, h FROM (SELECT idx, own, {text} AS response, w, h FROM s) WHERE {keep}"


@query(f"WITH {SIZED_SQL} {' UNION ALL '.join(map(_plain_sql, PLAIN))}")
def builders_plain(spark, d):
    out = None
    for name in PLAIN:
        part = builders.BUILDERS[name](sized_docs(spark, d)).drop("key")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT vec_id, unnest(range(len(embedding)))::bigint AS k, unnest(embedding)::double AS v FROM embeddings")
def tensor_round_trip(spark, d):
    """Embeddings as matrices of 4 * SIDE rows, written to tensor files in two shards with an index and read back."""
    at = f"{scratch.folder(spark)}/tensors-{uuid.uuid4().hex}"
    rows = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / (4 * SIDE)).alias("m"), (F.col("vec_id") % (4 * SIDE)).alias("i"), F.posexplode("embedding").alias("j", "v"))
    each = tiles.tiled(rows.select(F.format_string("m%012d", "m").alias("module"), "i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), size=BLOCK, dtype="F32")
    whole = each.join(tiles.shapes(each, size=BLOCK), "module").withColumns({"shape": F.array("height", "width"), "shard": F.format_string("model-%05d-of-00002.safetensors", F.right("module", F.lit(1)).cast("int") % 2 + 1)})
    tensor_files.save(whole, at)
    back = tiles.cells(tensor_files.read(spark, at, 2 * BLOCK), size=2 * BLOCK)
    return back.select((F.substring("module", 2, 12).cast("long") * (4 * SIDE) + F.col("i")).alias("vec_id"), F.col("j").alias("k"), "v")


@query(f"WITH {SIZED_SQL}, o AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, own, response, w, h FROM s) {_plain_sql('okai').replace(' FROM s)', ' FROM o)')}")
def saved_dataset(spark, d):
    """Documents, in order of their ids, as a saved dataset of Arrow files, from which a builder reads them in its order."""
    at = f"{scratch.folder(spark)}/saved-{uuid.uuid4().hex}"
    saved_datasets.save(sized_docs(spark, d).repartitionByRange("idx").sortWithinPartitions("idx").withColumnRenamed("idx", "place"), at)
    return builders.BUILDERS["okai"](readers.indexed(spark, at, ["text", "source", "w", "h"])).drop("key")


CHAT_SQL = f"""first AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS u, min(turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
chat AS (SELECT f.conv_id AS idx, CASE WHEN f.conv_id % 3 = 0 THEN 'flat ' || f.conv_id WHEN f.u IS NOT NULL THEN c.text END AS text FROM first f LEFT JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.a)"""


@query(f"WITH {CHAT_SQL} SELECT idx, {PROMPT_SQL}[idx % 5 + 1] AS prompt, {NORMED} AS response, 'qari10k' AS source, 'doc_markdown' AS domain FROM chat WHERE length({NORMED}) >= 2")
def builder_chat(spark, d):
    """Conversations with decorated role names; every third one in the flat form."""
    turn = F.struct("turn", F.concat(F.lit("<|"), F.initcap("role"), F.lit("|>")).alias("role"), F.col("text").alias("content"))
    c = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("idx")).agg(F.array_sort(F.collect_list(turn)).alias("m"))
    said = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    flat = F.col("idx") % 3 == 0
    rows = c.select("idx", F.when(~flat, said).alias("messages"), F.when(flat, F.concat(F.lit("flat "), F.col("idx").cast("string"))).alias("assistant_content"))
    return builders.BUILDERS["qari10k"](rows).drop("key")


@query(rf"""WITH m AS (SELECT page_id AS idx, {ORACLE["html_markup_to_md"].split(",", 1)[1].rsplit(" AS md", 1)[0]} AS text FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0),
v AS (SELECT idx, {NORMED} AS response FROM m) SELECT idx, {PROMPT_SQL}[row_number() OVER (ORDER BY idx % 2, idx) % 5 + 1] AS prompt, response, 'namaa_qari03' AS source, 'doc_markdown' AS domain, 40 AS w, 30 AS h FROM v WHERE length(response) >= 2""")
def builder_namaa(spark, d):
    return namaa_rows(spark, d).drop("key")


def namaa_rows(spark, d):
    """Pages in two splits; every fifth has no image file, every seventh an empty one."""
    p = read(spark, d, "pages").select(F.col("page_id").alias("idx"), F.concat(F.lit("a/b/"), F.col("page_id").cast("string"), F.lit(".png")).alias("image"), F.col("html").alias("text"))
    files = p.where("idx % 5 <> 0").select(F.substring_index("image", "/", -1).alias("name"), F.when(F.col("idx") % 7 == 0, 0).otherwise(9).alias("length"), F.lit(40).alias("w"), F.lit(30).alias("h"))
    return builders.BUILDERS["namaa"]([p.where("idx % 2 = 0"), p.where("idx % 2 = 1")], files)


@query(f"""WITH n AS (SELECT n_nationkey::bigint AS idx, ['Newspaper', 'Book', 'Other'][n_nationkey % 3 + 1] AS cat, n_name AS text, unnest([0, 1]) AS region FROM nation),
v AS (SELECT idx, region, cat, CASE region WHEN 0 THEN text ELSE lower(text) END AS response, CASE region WHEN 0 THEN 30 ELSE (idx % 20)::int END AS w FROM n)
SELECT idx, {PROMPT_SQL}[row_number() OVER (ORDER BY idx, region) % 5 + 1] AS prompt, response, 'jayanthmuthu_' || cat AS source, map {{'Newspaper': 'newspaper', 'Book': 'doc_markdown', 'Other': 'line_real'}}[cat] AS domain, w, 20 AS h FROM v WHERE w >= 12""")
def builder_regions(spark, d):
    return region_rows(spark, d).drop("key")


def region_rows(spark, d):
    """Two transcribed regions a nation, the second as wide as its key allows, and one without a transcription."""
    tag = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    point = lambda x, y: F.array(x.cast("double"), F.lit(y).cast("double"))
    shape = lambda x: F.struct(F.array(point(F.lit(-5), 5), point(x, 25)).alias("exterior"))
    region = lambda t, x: F.struct(F.array(tag("Kind", F.lit("x")), t).alias("tags"), shape(x).alias("points"))
    objects = F.array(region(tag("Transcription", F.col("n_name")), F.lit(90)), region(tag("Transcription", F.lower("n_name")), F.col("n_nationkey") % 20), region(tag("Other", F.col("n_name")), F.lit(20)))
    name = F.concat(F.element_at(F.array(*map(F.lit, ["Newspaper", "Book", "Other"])), F.col("n_nationkey") % 3 + 1), F.lit("-00001-of-00002.parquet"))
    a = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), name.alias("file"), F.to_json(F.struct(objects.alias("objects"))).alias("annotation"), F.lit(30).alias("w"), F.lit(50).alias("h"))
    return builders.BUILDERS["jayanthmuthu"](a)


@query(f"""WITH {SIZED_SQL}, src AS (SELECT idx AS id, response AS text, w, h FROM s WHERE {ROW_OK} AND NOT contains(coalesce(own, ''), 'arocrbench')), {STACK_SQL}
SELECT grp AS idx, {PROMPT_SQL}[(grp + 1) % 5 + 1] AS prompt, text AS response, 'okai_muharaf_para' AS source, 'handwritten_paragraph' AS domain, w, h FROM ss""")
def builder_stacked(spark, d):
    return builders.BUILDERS["okai_para"](sized_docs(spark, d)).drop("key")


@query(rf"""WITH {SIZED_SQL}, c AS (SELECT *, regexp_replace(response, '{WS}+', ' ', 'g') AS body FROM s)
SELECT idx, {PROMPT_SQL}[row_number() OVER (ORDER BY idx) % 5 + 1] AS prompt, response, 'khatt_para' AS source, 'handwritten_para_real' AS domain, w, h FROM c WHERE NOT {DIRTY} AND {ROW_OK}""")
def builder_paragraphs(spark, d):
    return builders.BUILDERS["khatt_para"](sized_docs(spark, d), read(spark, d, "benchmark")).drop("key")


@query(rf"""WITH l AS (SELECT conv_id * 1000 + turn AS idx, 's' || (conv_id % 2) AS split, conv_id // 2 AS para, {NORMED} AS response FROM conversations),
g AS (SELECT split, para, string_agg(response, ' ' ORDER BY idx, response) AS text, min(idx) AS first FROM l GROUP BY split, para), k AS (SELECT split, para, first FROM (SELECT split, para, first, {COLLAPSED} AS body FROM g) WHERE NOT {DIRTY})
SELECT idx, {PROMPT_SQL}[row_number() OVER (ORDER BY first, idx) % 5 + 1] AS prompt, response, 'khatt_lines' AS source, 'handwritten_line' AS domain, 40 AS w, 30 AS h FROM l JOIN k USING (split, para) WHERE length(response) >= 2 AND idx % 11 <> 0""")
def builder_lines(spark, d):
    """Turns as lines, written backwards; a paragraph is a conversation within its split. Every eleventh has no image."""
    c = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.concat(F.lit("s"), (F.col("conv_id") % 2).cast("string")).alias("split"), F.concat_ws("_", F.lit("p"), F.floor(F.col("conv_id") / 2).cast("string"), "turn").alias("file_name"), F.reverse("text").alias("text"))
    files = c.where("idx % 11 <> 0").select("split", "file_name", F.lit(40).alias("w"), F.lit(30).alias("h")).distinct()
    return builders.BUILDERS["khatt_lines"](c, read(spark, d, "benchmark"), files).drop("key")


ASSEMBLED = ["aallail", "hastyle", "okai"]


@query(f"""WITH {SIZED_SQL}, u AS ({' UNION ALL '.join(f"SELECT '{n}:' || idx AS id, source, domain FROM ({_plain_sql(n)})" for n in ASSEMBLED)}),
k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || id), id) <= 400 AS val FROM u)
SELECT 'source' AS kind, source AS name, count(*) AS n FROM k WHERE NOT val GROUP BY source UNION ALL SELECT 'domain', domain, count(*) FROM k WHERE NOT val GROUP BY domain
UNION ALL SELECT 'total_train', NULL, count(*) FILTER (NOT val) FROM k UNION ALL SELECT 'total_val', NULL, count(*) FILTER (val) FROM k""")
def corpus_assembly(spark, d):
    """Shards, union, holdout, both tables and the counts, written and read back."""
    at = f"{scratch.folder(spark)}/assembly-{uuid.uuid4().hex}"
    for name in ASSEMBLED:
        sinks.save_shard(builders.BUILDERS[name](sized_docs(spark, d)), f"{at}/shards/{name}")
    sinks.save_corpus(sinks.shards(spark, f"{at}/shards"), at)
    train, val = spark.read.parquet(f"{at}/unified"), spark.read.parquet(f"{at}/val")
    said = lambda kind, c: train.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    total = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("name"), "n")
    return said("source", "source").unionByName(said("domain", "domain")).unionByName(total("total_train", train)).unionByName(total("total_val", val))


@query(f"""WITH {SIZED_SQL}, u AS ({' UNION ALL '.join(f"SELECT '{n}:' || idx AS id, domain FROM ({_plain_sql(n)})" for n in ASSEMBLED)}),
k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || id), id) <= 400 AS val FROM u)
SELECT id, CASE WHEN val THEN 'val' ELSE 'unified' END AS part, row_number() OVER (PARTITION BY val ORDER BY md5('42:' || id), id) - 1 AS place FROM k""")
def corpus_order(spark, d):
    """Where each row stands in the files of the corpus and of its holdout, which are written in seeded order."""
    at = f"{scratch.folder(spark)}/order-{uuid.uuid4().hex}"
    for name in ASSEMBLED:
        sinks.save_shard(builders.BUILDERS[name](sized_docs(spark, d)), f"{at}/shards/{name}")
    sinks.save_corpus(sinks.shards(spark, f"{at}/shards"), at)
    part = lambda name: readers.indexed(spark, f"{at}/{name}/*.parquet", ["id"]).select("id", F.lit(name).alias("part"), F.col("idx").alias("place"))
    return part("unified").unionByName(part("val"))


@query(f"SELECT doc_id, copy, row_number() OVER (ORDER BY md5('42:' || doc_id || ':' || copy), doc_id || ':' || copy) - 1 AS place FROM ({_mix_sql(mix.RECIPES['1'].domains, 42, 'domain', f'(SELECT doc_id, {DOMAIN_SQL} AS domain FROM documents)')})")
def mixture_order(spark, d):
    """Where each copy of a row stands in the files of a mixture."""
    at = f"{scratch.folder(spark)}/mixture-{uuid.uuid4().hex}"
    mix.save(mix.mix(domains(spark, d), mix.RECIPES["1"], "doc_id").select("doc_id", "copy"), at, mix.RECIPES["1"], "doc_id")
    return readers.indexed(spark, f"{at}/*.parquet").select("doc_id", "copy", F.col("idx").alias("place"))


@query(f"""WITH r AS (SELECT domain FROM ({ORACLE["builder_regions"]}) UNION ALL SELECT domain FROM ({ORACLE["builder_namaa"]}))
SELECT domain, count(*) AS n, count(*) AS ids, least(count(*), 5) AS held FROM r GROUP BY domain""")
def shard_ids(spark, d):
    """Rows, distinct ids and rows held out of the sources whose positions repeat over regions and splits."""
    at = f"{scratch.folder(spark)}/ids-{uuid.uuid4().hex}"
    sinks.save_shard(region_rows(spark, d), f"{at}/shards/jayanthmuthu")
    sinks.save_shard(namaa_rows(spark, d), f"{at}/shards/namaa")
    sinks.save_corpus(sinks.shards(spark, f"{at}/shards"), at, holdout=5)
    rows = spark.read.parquet(f"{at}/unified").select("id", "domain", F.lit(0).alias("val")).unionByName(spark.read.parquet(f"{at}/val").select("id", "domain", F.lit(1).alias("val")))
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("val").alias("held"))


@query("SELECT 'hindawi' AS suite, doc_id AS i, text AS ref FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i < 30")
def suite_scan(spark, d):
    """The first rows of a suite in stored order; the operator itself takes them."""
    rows = readers.indexed(spark, f"{d}/documents.parquet", ["doc_id", "text"])
    return rows.where("idx < 30").select(F.lit("hindawi").alias("suite"), F.col("doc_id").alias("i"), F.col("text").alias("ref"))


@query("SELECT r_regionkey, ['a:b', 'c', 'x:'][r_regionkey % 3 + 1] AS name, 0.25::double AS coeff FROM region")
def mix_parts(spark, d):
    spec = F.concat(F.element_at(F.array(F.lit("a:b"), F.lit("c"), F.lit("x:")), F.col("r_regionkey") % 3 + 1), F.lit(":0.25"))
    return read(spark, d, "region").select("r_regionkey", T.mix_part(spec).alias("p")).select("r_regionkey", "p.name", "p.coeff")


# extensions over `events`


@query("""SELECT l.event_id, r.event_id AS view_id, r.value AS view_value FROM (SELECT * FROM events WHERE event_type <> 'view') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def as_of_join(spark, d):
    """The last view of the same user before each other event."""
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    met = temporal.as_of(e.where("event_type <> 'view'"), e.where("event_type = 'view'"), ["user_id"], "ts", "event_id")
    return met.select("event_id", F.col("right_event_id").alias("view_id"), F.col("right_value").alias("view_value"))


@query("""WITH v AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + (value * 6e8)::bigint AS e FROM events)
SELECT a.event_id, b.event_id AS view_id FROM v a JOIN v b ON a.event_type <> 'view' AND b.event_type = 'view' AND a.user_id = b.user_id AND a.s < b.e AND b.s < a.e""")
def interval_join(spark, d):
    """Events and views of the same user whose spans, as long as their values say, overlap."""
    at = temporal.micros("ts")
    v = read(spark, d, "events").select("event_id", "user_id", "event_type", at.alias("s"), (at + F.round(F.col("value") * 6e8).cast("long")).alias("e"))
    met = temporal.overlaps(v.where("event_type <> 'view'"), v.where("event_type = 'view'"), ["user_id"], "s", "e")
    return met.select("event_id", F.col("right_event_id").alias("view_id"))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 3 HOUR, true)::int AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM n GROUP BY user_id, nr""")
def event_sessions(spark, d):
    """Sessions of each user, three hours apart; streaming.sessions gives the same as the events arrive."""
    return temporal.sessions(read(spark, d, "events"), ["user_id"], "ts", 3 * 3600)
