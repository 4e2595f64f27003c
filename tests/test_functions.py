"""Scalars, tables, similarity, mixtures and readers on hand-made cases."""

import json
import hashlib
import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import image as I
from quillspark.functions import text as T
from quillspark.functions import edits as edit
from quillspark.operators import corpus, linalg, metrics, mix, pairs, probing, tables, tiles
from quillspark.sources import builders, readers, saved_datasets, sinks, tensor_files
from quillspark.streaming.ingest import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.source_norm, "ﻻ‏", "لا"),
        (T.source_norm, "a  b", "a  b"),
        (T.source_norm, None, ""),
        (T.eval_norm, "كِتَـاب", "كتاب"),
        (T.eval_norm, "أإآ", "ا" * 3),
        (T.eval_norm, "a\x1cb c  d ", "a b c d"),
        (T.html_to_md, "<p><b>x\ny</b></p> <p><i>z</i> <u>u</u></p>", "**x\ny**\n\n*z* u"),
        (T.unwrap_fence, "```markdown\nhi\n```", "hi"),
        (T.unwrap_fence, "```\nhi\n``` tail", "```\nhi\n``` tail"),
        (T.unwrap_fence, "```markdown\u00a0\nhi```\u2003", "hi"),
        (T.unwrap_fence, "```\na\n```\nb\n```\n", "a\n```\nb"),
        (T.pipe_lines, "| a |\r| b |\n", 1),
        (T.pipe_lines, "| a b |\n| c |", 2),
        (T.tensor_name, "base_model.model.model.visual.x.lora_B.weight", "visual.x.weight"),
        (T.tensor_name, "base_model.model.model.language_model.visual.q.lora_A.weight", "model.visual.q.weight"),
        (T.tensor_name, "x.base_model.model.base_model.model.y.lora_A.weight", "x.base_model.model.y.weight"),
        (T.mix_part, "a:b:0.25", ("a:b", 0.25)),
        (T.suite_label, "nakba_test", "nakba (newspaper)"),
        (T.tensor_name, "model.x.weight", None),
        (T.safe_int, " 7 ", 7),
        (T.safe_int, "x", 1),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_white_space_is_that_of_strings(spark):
    every = [chr(k) for k in range(1, 0x3100) if not 0xD800 <= k < 0xE000]
    got = spark.createDataFrame([(x,) for x in every], "x string").select("x", (T.strip(F.col("x")) == "").alias("a"), (T.collapse(F.concat(F.lit("p"), "x", F.lit("q"))) == "p q").alias("b")).collect()
    assert all(r["a"] == r["b"] == r["x"].isspace() for r in got)


def test_prompt_and_sizes(spark):
    assert one(spark, 7, T.prompt, "long") == T.PROMPTS[2]
    fit = lambda w, h: tuple(spark.range(1).select(I.fit(F.lit(w), F.lit(h), F.lit(I.BUDGET)).alias("s")).first()["s"])
    assert fit(1000, 1000) == (708, 708) and fit(10, 20) == (10, 20)
    stack = spark.range(1).select(I.stack(F.array(F.lit(100), F.lit(1000)), F.array(F.lit(7), F.lit(0))).alias("s")).first()["s"]
    assert tuple(stack) == (1020, 70 + 1 + 30)
    rows = spark.createDataFrame([("a", 50, 50), ("ab", 11, 50), ("ab", 12, 50), (None, 50, 50)], "t string, w int, h int")
    assert rows.where(corpus.valid(F.col("t"), F.col("w"), F.col("h"))).count() == 1


def test_holdout_and_mix_counts(spark):
    df = spark.range(804).select(F.col("id").alias("k"), F.when(F.col("id") < 401, "a").when(F.col("id") < 801, "b").otherwise("c").alias("domain"), F.lit("s").alias("source"))
    split = {(r["domain"], r["split"]): r["count"] for r in corpus.with_holdout(df, "domain", "k").groupBy("domain", "split").count().collect()}
    assert split == {("a", "val"): 400, ("a", "train"): 1, ("b", "val"): 400, ("c", "val"): 3}
    rows = spark.range(300).select(F.col("id").alias("k"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("domain"), F.lit("s").alias("source"))
    got = {r["domain"]: r["count"] for r in mix.mix(rows, mix.Recipe(1, {"a": 0.29, "b": 1.0, "c": 2.5}), "k").groupBy("domain").count().collect()}
    assert got == {"a": int(100 * 0.29), "b": 100, "c": 250}


def test_cuts_by_passes(spark, monkeypatch):
    """The cut found by narrowing equals that of a full sort, whatever the number of passes."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"))
    want = {}
    for r in sorted(df.select("g", "id", corpus.seeded(7, F.col("id")).alias("h")).collect(), key=lambda r: (r["h"], r["id"])):
        want.setdefault(r["g"], []).append(r["id"])
    for bits, few in ((10, 100_000), (3, 5)):
        monkeypatch.setattr(corpus, "BITS", bits)
        monkeypatch.setattr(corpus, "FEW", few)
        for n in (0, 1, 400, 1000, 5000):
            got = {r["_g"]: (r["_n"], r["_cut"] and r["_cut"]["k"]) for r in corpus.cuts(df, F.col("g"), "id", 7, lambda _, __, n=n: F.lit(n)).collect()}
            assert got == {g: (1000, ids[min(n, 1000) - 1] if n else None) for g, ids in want.items()}
    assert corpus.cuts(df.limit(0), F.col("g"), "id", 7, lambda n, _: n).count() == 0
    assert corpus.exact_sample(df, 0.29, "id").count() == int(3000 * 0.29) and corpus.exact_sample(df.limit(0), 0.29, "id").count() == 0
    assert mix.smoke(df, "id").count() == 2000 and mix.smoke(df.where("id < 9"), "id").count() == 9


def test_counter_with_outliers_and_ties(spark):
    values = [*range(500), 1 << 60, -(1 << 60), *[7] * 400]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v long, k long")
    got = sorted((r["i"], r["v"], r["k"]) for r in corpus.with_counter(df, ["v", "k"]).collect())
    assert [(v, k) for _, v, k in got] == sorted((v, k) for k, v in enumerate(values)) and [i for i, *_ in got] == list(range(1, len(values) + 1))
    assert corpus.with_counter(df.limit(0), "v").count() == 0


def test_counts_of_nothing(spark):
    df = spark.createDataFrame([("s", "d"), (None, "d")], "source string, domain string")
    assert sorted(map(repr, (tuple(r) for r in corpus.counts(df).collect()))) == sorted(map(repr, [("s", None, 1), (None, None, 1), (None, "d", 2), (None, None, 2)]))
    assert [tuple(r) for r in corpus.counts(df.limit(0)).collect()] == [(None, None, 0)]


def test_random_stacks(spark, monkeypatch):
    monkeypatch.setattr(corpus, "SPAN", 4)
    df = spark.range(10, 110).select("id", F.concat(F.lit("t"), "id").alias("text"))
    got = corpus.stacks(df, "id", "text").orderBy("grp").collect()
    assert {r["n"] for r in got} == {3, 4, 5, 6} and 94 < sum(r["n"] for r in got) <= 100
    assert "\n".join(r["text"] for r in got).split("\n") == [f"t{k}" for k in range(10, 10 + sum(r["n"] for r in got))]
    assert corpus.stacks(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("listed", [0, 1 << 26])
def test_decontamination_of_rows(spark, monkeypatch, listed):
    monkeypatch.setattr(corpus, "LISTED", listed)
    # by row: null and repeated keys don't matter, a null text is clean; all kinds of probes, against the nested loop
    bench = spark.createDataFrame([("one two  three four five six seven eight nine ten",), ("Ünbrokenwordthatgoesonandonandonandonandon!",), ("xy z",), ("日本語のとても長い文章がここにある。" * 3,), (" ",), (None,)], "text string")
    said = [(None, "so one two three four five six\tseven eight nine ten it is"), (None, "clean"), (1, "clean"), (1, "axy zb"), (2, None), (2, ""), (3, "xx Ünbrokenwordthatgoesonandonandonandonand"), (3, "Ünbrokenwordthatgoesonandonandonandonan"), (4, "これは日本語のとても長い文章がここにある。" + "日本語のとても長い文章がここにある。" * 3), (4, "xy\u00a0z"), (5, "one two three four five six seven eight nin")]
    docs = spark.createDataFrame(said, "id long, text string")
    got = sorted(repr(tuple(r)) for r in corpus.decontaminate(docs, bench, "text").collect())
    assert got == sorted(map(repr, [(None, "clean"), (1, "clean"), (2, None), (2, ""), (3, "Ünbrokenwordthatgoesonandonandonandonan")]))
    loop = corpus.decontaminate_by_probe(docs.where("text is not null"), bench, "text").collect()
    assert sorted(repr(tuple(r)) for r in loop) == sorted(map(repr, [(None, "clean"), (1, "clean"), (2, ""), (3, "Ünbrokenwordthatgoesonandonandonandonan")]))
    assert corpus.decontaminate(docs, bench.limit(0), "text").count() == len(said) and corpus.decontaminate(docs.limit(0), bench, "text").count() == 0


def test_probe_tables_equal_search():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
    said = lambda n: " ".join(word() for _ in range(rng.randint(0, n)))
    for _ in range(60):
        probes = sorted({p for p in (said(rng.choice([1, 2, 3, 6]))[: rng.randint(1, 40)] for _ in range(rng.randint(0, 12))) if p})
        texts = [said(30) for _ in range(20)] + ["", None, "a"] + [f"{said(3)}{rng.choice(probes)}{said(3)}" for _ in range(5) if probes]
        column = pa.array(["skipped", *texts])[1:]
        assert probing.containing(column, probing.tables(probes)).tolist() == [any(p in (t or "") for p in probes) for t in texts]
    assert probing.containing(pa.array([], pa.string()), probing.tables(["x"])).tolist() == []


def test_probe_tables_are_small(monkeypatch):
    import pickle
    import tracemalloc

    probes = [f"{k:06d} and then some words of it, {k % 7}"[:40] for k in range(30_000)]
    body = pickle.dumps(probing.tables(probes))
    tracemalloc.start()
    found = pickle.loads(body)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 150 * len(probes)
    monkeypatch.setattr(probing, "CHUNK", 100)
    texts = pa.array(["x " + probes[5] + " y", None, "", "000005 and then some words of it", "z" * 1000, probes[29_999]])
    assert probing.containing(texts, found).tolist() == [True, False, False, False, False, True]


def test_only_texts_that_may_change_are_composed(spark, monkeypatch):
    import unicodedata

    said = ["abc", "für naïve Ñandú", "كتاب", "e\u0301", "ﬁn", "\u1e9b\u0323", "한", "\u1112\u1161\u11ab", "x²", "", None, "“q” – …", "क\u093c", "\ufdfa"]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    assert [r[0] for r in rows.select(T.nfkc(F.col("t"))).collect()] == [t and unicodedata.normalize("NFKC", t) for t in said]
    allowed = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", T.STABLE)
    stable = [c for c in map(chr, range(0x110000)) if re.match(f"[{allowed}]", c)]
    assert len(stable) > 700 and not any(map(unicodedata.combining, stable))
    assert all(unicodedata.is_normalized("NFKC", a + "".join(a + b for b in stable)) for a in stable)
    here = F.when(F.length("t") > 0, F.raise_error(F.lit("in Python")))  # stands for the worker
    monkeypatch.setattr(T, "_composed", lambda c: F.when(c.isNotNull(), here.cast("string")))
    assert rows.where("t in ('abc', 'für naïve Ñandú', 'كتاب', '')").select(T.nfkc(F.col("t"))).count() == 4


def test_headers_alone_leave_the_jvm(spark, monkeypatch):
    rows = [(0, PNG + b"x" * 99), (1, JPEG + b"x" * 99), (2, b"GIF89a\x14\0\x1e\0" + b"x" * 99), (3, PNG[:20]), (4, None), (5, b"")]
    df = spark.createDataFrame(rows, "k int, data binary")
    assert [tuple(r) for r in df.orderBy("k").select(I.size_of(F.col("data")).alias("s")).select("s.*").collect()] == [(20, 30)] * 3 + [(None, None)] * 3
    monkeypatch.setattr(I, "_size", F.length)
    assert [r[0] for r in df.orderBy("k").select(I.size_of("data")).collect()] == [26, len(JPEG) + 99, 26, 20, None, 0]


def test_stored_tables_leave_no_shuffle_files(spark):
    from quillspark.sources import scratch

    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    setting, before = spark.conf.get(scratch.CLEANUP, None), held()
    table = scratch.stored(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "swept")
    assert held() <= before and spark.conf.get(scratch.CLEANUP, None) == setting and table.agg(F.sum("count")).first()[0] == 5000


def test_long_rows_stay_where_they_are(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.lit("d").alias("domain"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("body"))
    rows.repartition(2).write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    for df in (readers.indexed(spark, str(tmp_path / "rows")), corpus.with_holdout(stored, "domain", "k"), corpus.with_counter(stored, "k")):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    p = rows.select(F.lit("r").alias("run"), F.lit("s").alias("suite"), F.col("k").alias("i"), F.col("body").alias("ref"), F.col("body").alias("hyp"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.save_predictions(p, str(tmp_path / "p"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "p/run=r/suite=s").glob("part-*.json"))
    said = [[json.loads(x)["i"] for x in f.read_text().splitlines()] for f in files]
    assert len(files) > 1 and max(map(len, said)) < 2000 and sum(said, []) == list(range(3000))


def test_probe_lists_that_no_task_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k} of  some words, and {k * k} more") for k in range(200)] + [(200, None)], "id long, text string")
    bench = docs.where("id % 7 = 0")
    assert "Exchange" not in corpus.flagged(docs, corpus.probes(bench), "text")._jdf.queryExecution().executedPlan().toString()
    got = {}
    for most in (1 << 26, 100):
        monkeypatch.setattr(corpus, "LISTED", most)
        got[most] = {r["id"] for r in corpus.flagged(docs, corpus.probes(bench), "text").where("dirty").collect()}
    assert got[100] == got[1 << 26] == set(range(0, 200, 7))


def test_group_decontamination_and_short_probes(spark):
    lines = spark.createDataFrame([("g", 0, "one two three four five six"), ("g", 1, "seven eight nine ten eleven"), ("h", 0, "other"), (None, 0, "four five six"), (None, 1, "seven eight nine ten eleven")], "g string, pos int, text string")
    bench = spark.createDataFrame([("four five six seven eight nine ten eleven",), (" ",)], "text string")
    assert [r["g"] for r in corpus.decontaminate_groups(lines, bench, "g", "pos", "text").collect()] == ["h"]
    short = spark.createDataFrame([("other",)], "text string")
    assert {r["g"] for r in corpus.decontaminate_groups(lines, short, "g", "pos", "text").collect()} == {"g", None}
    two = lines.withColumn("split", F.col("pos"))  # the same group in two splits is two groups
    assert corpus.decontaminate_groups(two, bench, ["split", "g"], "pos", "text").count() == 5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_rates(spark):
    rng = random.Random(3)
    said = [(" ".join(rng.choices(["a", "bé", "c", "dd"], k=rng.randint(0, 9))), " ".join(rng.choices(["a", "bé", "c", "dd"], k=rng.randint(0, 9)))) for _ in range(60)]
    pairs_ = [(str(i), r, h) for i, (r, h) in enumerate([*said, ("ab", "ab"), ("abcd", "abcx"), ("a", None), ("", "x")])]
    got = {r["s"]: r for r in metrics.corpus_rates(spark.createDataFrame(pairs_, "s string, ref string, hyp string"), ["s"]).collect()}
    for s, r, h in pairs_:
        if r:
            h = h or ""
            assert got[s]["cer"] == edits(r, h) / len(r) and got[s]["wer"] == edits(r.split(), h.split()) / len(r.split())
    assert len(got) == sum(1 for _, r, _ in pairs_ if r)
    both = spark.createDataFrame([("x", "ab", "ab"), ("x", "abcd", "abcx")], "s string, ref string, hyp string")
    assert metrics.corpus_rates(both, ["s"]).first()["cer"] == 1 / 6


def test_gate_and_ratio(spark):
    row = spark.range(1).select(metrics.canary(F.lit(0.2), F.lit(None).cast("double")).alias("a"), metrics.canary(F.lit(0.201), F.lit(None).cast("double")).alias("b"), metrics.ratio_to(F.lit(1.0), F.lit(0.0)).alias("c"), metrics.bucket(F.lit(2.0)).alias("d"), metrics.bucket(F.lit(2.01)).alias("e"), metrics.bucket(F.lit(1.2)).alias("f")).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"]) == (False, True, float("inf"), None, "looper", "good")


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("| x |", "| x |"),
        ("t\n| a | b |\n|---|---|\n| 1 | 2 |\nend", "t\n<table>\n<tr><td>a</td><td>b</td></tr>\n<tr><td>1</td><td>2</td></tr>\n</table>\nend"),
        ("| a |\n| |\n| b |", "<table>\n<tr><td>a</td></tr>\n<tr><td>b</td></tr>\n</table>"),
        ("no pipe \n", "no pipe \n"),
        ("a | b\n| c |\n", "a | b\n| c |\n"),
    ],
)
def test_md_to_html(spark, md, want):
    assert one(spark, md, tables.md_tables_to_html) == want


def test_md_to_html_of_long_pages(spark):
    """Against a plain statement, with runs across the borders of pages."""
    rng = random.Random(12)

    def plain(text):
        """Runs of lines of a kind; pipe runs with two rows or more that are no rulers become a table."""
        blank = lambda x: x.strip()
        is_row = lambda x: len(blank(x)) > 2 and {blank(x)[0], blank(x)[-1]} == {"|"}
        ruler = lambda x: not blank(re.sub("[-:|]", "", x)) and x.partition("|")[0] + blank(x)[1:].partition("|")[0] != ""
        cells = lambda x: "".join(f"<td>{blank(c)}</td>" for c in blank(x).strip("|").split("|"))
        out = []
        for kind, run in ((k, list(g)) for k, g in itertools.groupby(text.split("\n"), is_row)):
            rows = [f"<tr>{cells(x)}</tr>" for x in run if kind and not ruler(x)]
            out.append("\n".join(["<table>", *rows, "</table>"] if len(rows) > 1 else run))
        return "\n".join(out)

    pages = ["\n".join(rng.choices(["| a | b |", "|---|---|", " | 1 |2| ", "text", "", "||", "|x|", "| - |", "\u2003| c |", " |||", "|||", "|:-:| |"], weights=[9, 2, 9, 2, 1, 1, 3, 1, 2, 1, 1, 1], k=k)) for k in (0, 1, 255, 256, 257, 900, 3000)] + ["|", "| a |\n" * 600]
    got = spark.createDataFrame(list(enumerate(pages)), "k long, t string").select("k", tables.md_tables_to_html(F.col("t")).alias("t")).collect()
    assert all(r["t"] == plain(pages[r["k"]]) for r in got)


def test_html_to_md(spark):
    assert one(spark, "<table><td>x</td></table>", tables.html_tables_to_md) == "<table><td>x</td></table>"
    html = "<TABLE><tr><th>a</th><th><b>b</b></th></tr><tr><td>1</td><td>2</td><td>3</td></tr></TABLE>"
    assert one(spark, html, tables.html_tables_to_md) == "| a | b |  |\n|---|---|---|\n| 1 | 2 | 3 |"


HOSTILE = {
    "dashes": "| a |\n|" + "-" * 10_000_000 + "|\n| b |\n| c |",
    "pipes": "|" * 5_000_000 + "x|",
    "lines": "\n" * 10_000_000,
    "openings": "<b>" * 3_000_000,
    "closed once": "<b>" * 1_000_000 + "</b>" + "<b>" * 1_000_000,
    "images": "![" * 4_000_000,
    "images and a bracket": "![" * 3_000_000 + "](" + "![](" * 500_000,
    "fence": "```" + "\n" * 5_000_000 + "``` x" * 500_000,
    "tables": "<table>" * 1_000_000 + "<tr>" * 500_000 + "<td>" * 500_000,
    "cells": "<table><tr>" + "<td>" * 500_000 + "<" * 2_000_000 + "</td></tr></table>",
    "underscores": "_" * 5_000_000,
    "colons": ":" * 5_000_000,
    "spaces": " " * 5_000_000 + "|",
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_texts_end(spark, kind):
    """Every pattern over 10 MB that invite it to recurse or to go back; what they give is checked on short ones."""
    c = F.col("t")
    each = [T.source_norm(c), T.eval_norm(c), T.html_to_md(c), T.drop_images(c), T.squeeze_blank_lines(c), T.unwrap_fence(c), T.probe(c), T.has_md_table(c), T.before_last(c), T.tensor_name(c), T.mix_part(c)["name"], tables.md_tables_to_html(c), tables.html_tables_to_md(c)]
    row = spark.createDataFrame([(HOSTILE[kind],)], "t string").select(*[F.length(x.cast("string")).alias(f"c{k}") for k, x in enumerate(each)]).first()
    assert row["c7"] == (4 if kind == "dashes" else 5)


def test_markup_equals_plain_patterns(spark):
    rng = random.Random(8)
    parts = ["<b>", "</b>", "<i>", "</i>", "![", "](", "]", ")", "(", "x", "\n", "```", "markdown", " ", "|", "</p>", "<p>", "<u>", "\u2003"]
    said = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    said += [f"```{a}{b}\n{c}```{d}" for a in ("", "markdown") for b in ("", " ", "\n") for c in ("x", "", "\n", "``", "a\n") for d in ("", " ", "`", "\n")]
    got = spark.createDataFrame(list(enumerate(said)), "k long, t string").select("k", T.html_to_md(F.col("t")).alias("md"), T.drop_images(F.col("t")).alias("images"), T.unwrap_fence(F.col("t")).alias("fence"), T.pipe_lines(F.col("t")).alias("pipes")).collect()
    for r in got:
        t = md = said[r["k"]]
        for p, to in ((r"(?s)<b>(.*?)</b>", r"**\1**"), (r"(?s)<i>(.*?)</i>", r"*\1*"), ("</?u>", ""), (r"</p>[\t\n\x0b\f\r \x1c-\x1f]*<p>", "\n\n"), ("</?p>", "")):
            md = re.sub(p, to, md)
        fence = re.fullmatch(r"(?s)```(?:markdown)?\s*\n(.*?)\n?```\s*", t)
        assert (r["md"], r["images"], r["fence"]) == (md.strip(), re.sub(r"!\[[^\]]*\]\([^)]*\)", "", t), fence[1].strip() if fence else t)
        assert r["pipes"] == len(re.findall(r"(?m)^[\s\x1c-\x1f]*\|.*\|[\s\x1c-\x1f]*$", t, re.ASCII))


def nested(tree):
    """(label, children) of a tree in arrays."""
    made = []
    for k, label in enumerate(tree.labels):
        start = len(made)
        while start and made[start - 1][0] >= tree.left[k]:
            start -= 1
        made[start:] = [(tree.left[k], (label, tuple(x for _, x in made[start:])))]
    (_, root), = made
    return root


def brute(a, b):
    """Edit distance of ordered forests by plain recursion."""
    from functools import cache

    size = lambda x: 1 + sum(map(size, x[1]))

    def rename(u, v):
        if u[:3] != v[:3]:
            return 1.0
        return 0.0 if u[3] == v[3] else 1.0 if not u[3] or not v[3] else edits(u[3], v[3]) / max(len(u[3]), len(v[3]))

    @cache
    def d(x, y):
        if not x or not y:
            return float(sum(map(size, x or y)))
        (u, cu), (v, cv) = x[-1], y[-1]
        return min(d(x[:-1] + cu, y) + 1, d(x, y[:-1] + cv) + 1, d(cu, cv) + d(x[:-1], y[:-1]) + rename(u, v))

    return d((a,), (b,))


def test_tree_distance_equals_brute_force():
    rng = random.Random(5)

    def html():
        cell = lambda: f"<t{rng.choice('dh')}{rng.choice(['', ' colspan=2'])}>{rng.choice(['a', 'ab', '', 'é b'])}{rng.choice(['</td>', '</td>', '</th>', ''])}"
        rows = [f"<tr{rng.choice(['', '', ' rowspan=3'])}>" + "".join(cell() for _ in range(rng.randint(0, 3))) + rng.choice(["</tr>", "</tr>", ""]) for _ in range(rng.randint(0, 3))]
        return "<table>" + "".join(rows) + "</table>"

    for _ in range(120):
        (a,), (b,) = tables.parse_tables(html()), tables.parse_tables(html())
        assert abs(tables.tree_distance(a, b) - brute(nested(a), nested(b))) < 1e-9


def test_long_tables_are_compared_where_they_differ(monkeypatch):
    held, costs = [], tables._costs
    monkeypatch.setattr(tables, "_costs", lambda a, b: held.append(len(a) * len(b)) or costs(a, b))
    row = lambda k: f"<tr><td>{k}</td><td>name {k}</td></tr>"
    page = lambda rows, tag="<table>": tag + "".join(rows) + "</table>"
    n = 2500
    rows = [row(k) for k in range(n)]
    size = 1 + 3 * n
    changed = [row("new") if k == 1200 else r for k, r in enumerate(rows)]
    assert tables.similarity(page(rows[:-1]), page(rows)) == 1 - 3 / size
    assert tables.similarity(page(rows), page(rows)) == 1.0
    assert tables.similarity(page(changed), page(rows)) == pytest.approx(1 - (1 + 4 / 9) / size)
    assert tables.similarity(page(rows, "<table colspan=2>"), page(rows)) == 1 - 1 / size
    assert len(held) == 4 and max(held) < 100


def test_similar_tables_of_the_data(spark):
    from quillspark.plans import catalog

    sf = "/root/testdata/sf0.001"
    html = dict(catalog.pipe_tables(spark, sf).select("r_regionkey", tables.md_tables_to_html(F.col("text"))).collect()) | {-1: "none"}
    got = {(r["a"], r["b"]): r["score"] for r in catalog.QUERIES["table_similarity"](spark, sf).collect()}
    assert len(got) == 20 and all(got[a, -1] == 0 for a in range(5)) and 0 < got[1, 0] < 1 == got[1, 1]
    for a, b in ((1, 0), (3, 2)):  # two of three cells of a row are enough to tell a wrong distance
        (x,), (y,) = (tables.parse_tables("<table>" + html[k].split("\n", 2)[2].replace("\n", "")[:150].rsplit("<tr>", 1)[0] + "</table>") for k in (a, b))
        assert abs(tables.tree_distance(x, y) - brute(nested(x), nested(y))) < 1e-9


def test_tables_that_never_close():
    deep = "<table><tr>" + "<td>x" * 2000
    (tree,) = tables.parse_tables(deep)
    assert len(tree.labels) == 2002 and tables.similarity(deep, deep) == 1.0
    outer, inner = tables.parse_tables("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>")
    assert len(outer.labels) == 3 and len(inner.labels) == 3 and tables.parse_tables("<tr><td>stray</td></tr>") == []
    assert tables.similarity("<table><tr rowspan=2><td>a</td></tr></table>", "<table><tr><td>a</td></tr></table>") == 1 - 1 / 3


def test_similarity():
    two = "<table><tr><td>{}</td><td>c</td></tr><tr><td>d</td><td>e</td></tr></table>"
    assert tables.similarity("x", "y") is None and tables.similarity(two, "y") == 0
    assert tables.similarity(two, two) == 1 and tables.similarity(two + two, two) == 0.5
    assert abs(tables.similarity(two.format("ab"), two.format("ax")) - (1 - 0.5 / 7)) < 1e-12


def test_pairs(spark):
    df = spark.createDataFrame([(1, "a", "b", b"i"), (2, " a ", "a", b"i"), (3, "", "x", b"i"), (4, None, "x", b"i"), (5, "a", "b", b""), (6, "a", "b", None)], "k long, chosen string, rejected string, image binary")
    assert [r["k"] for r in pairs.preference_pairs(df, "k", 6).collect()] == [1]
    assert {r["k"] for r in pairs.preference_pairs(df.drop("image"), "k", 6).collect()} == {1, 5, 6}


def test_soup_is_the_linear_combination(spark):
    rng = random.Random(7)
    cells, want = [], {}
    for name, coeff in (("a", 0.25), ("b", 0.75)):
        a = [[rng.random() for _ in range(5)] for _ in range(2)]
        b = [[rng.random() for _ in range(2)] for _ in range(4)]
        cells += [(name, "m", "A", i, j, a[i][j]) for i in range(2) for j in range(5)] + [(name, "m", "B", i, j, b[i][j]) for i in range(4) for j in range(2)]
        for i in range(4):
            for j in range(5):
                want[i, j] = want.get((i, j), 0) + coeff * sum(b[i][k] * a[k][j] for k in range(2))
    f = spark.createDataFrame(cells, "adapter string, module string, factor string, i long, j long, v double")
    kind = "adapter string, r int, alpha double, coeff double, target_modules string"
    c = spark.createDataFrame([("a", 2, 5.0, 0.25, "q"), ("b", 2, 5.0, 0.75, "q"), ("z", 3, 4.0, 0.0, "v")], kind)
    factors, merged = linalg.soup(f, c)
    assert all(abs(r["v"] - want[r["i"], r["j"]]) < 1e-9 for r in linalg.product(factors).collect())
    assert merged.first().asDict() == {"r": 4, "alpha": 10}
    sound = {"bad_sum": False, "adapters": 2, "bad_scale": False, "mismatch": False, "incomplete": 0, "unshared": 0, "not_factors": 0}
    assert linalg.guards(f, c).first().asDict() == sound
    bad = spark.createDataFrame([("a", 2, 4.0, 0.25, "q"), ("b", 2, 8.0, 0.7, "v")], kind)
    odd = f.where("adapter = 'a' or factor = 'A'").unionByName(spark.createDataFrame([("a", "n", "bias", 0, 0, 1.0)], f.schema))
    assert linalg.guards(odd, bad).first().asDict() == {"bad_sum": True, "adapters": 2, "bad_scale": True, "mismatch": True, "incomplete": 1, "unshared": 0, "not_factors": 1}
    with pytest.raises(ValueError, match="bad_sum"):
        linalg.soup(f, bad)
    with pytest.raises(ValueError, match="bad_sum"):
        linalg.soup(f, c.withColumn("coeff", F.lit(0.0)))


def test_tiles_equal_cells_and_round_like_their_base(spark):
    rng = np.random.default_rng(3)
    b, a, base = rng.standard_normal((13, 6)), rng.standard_normal((6, 9)), rng.standard_normal((13, 9))
    cells = lambda x, **more: [(*more.values(), i, j, float(v)) for (i, j), v in np.ndenumerate(x)]
    rows = cells(a, adapter="p", module="m", factor="A") + cells(b, adapter="p", module="m", factor="B") + cells(a, adapter="p", module="alone", factor="A")
    factors = tiles.tiled(spark.createDataFrame(rows, "adapter string, module string, factor string, i long, j long, v double"), ["adapter", "module", "factor"], 4)
    config = spark.createDataFrame([("p", 6, 12, 1.0), ("unused", 6, 12, 0.0)], "adapter string, r int, alpha int, coeff double")
    soup = tiles.soup(factors, config)
    got = {(r["i"], r["j"]): r["v"] for r in tiles.cells(tiles.product(soup), size=4).collect()}
    assert len(got) == 117 and all(abs(got[k] - v) < 1e-9 for k, v in np.ndenumerate(b @ a))
    for dtype, kind in (("F16", np.float16), ("F32", np.float32), ("F64", float), ("BF16", None)):
        whole = spark.createDataFrame(cells(base, module="m") + cells(base, module="other"), "module string, i long, j long, v double")
        merged = tiles.merge(tiles.tiled(whole, size=4, dtype=dtype), soup, 0.5, 4)
        row = tiles.merge_report(merged, soup, 4).first()
        assert (row["targets"], row["applied"], row["missing"], row["mismatched"]) == (1, 1, 0, 0) and row["max_change"] > 0
        made = {(r["module"], r["i"], r["j"]): r["v"] for r in tiles.cells(merged, size=4).collect()}
        for (i, j), v in np.ndenumerate(base):
            before = tiles.numbers(tiles.packed(np.array([v]), dtype), dtype)[0]
            want = before + 0.5 * (b @ a)[i, j]
            close = abs(made["m", i, j] - want) <= abs(want) / 256 if kind is None else abs(made["m", i, j] - float(kind(want))) <= np.spacing(abs(kind(want))) + 1e-12
            assert close and made["other", i, j] == before
    bits = np.array([1.0, 1.0 + 2**-8, 1.0 + 3 * 2**-8, 1.0 + 2**-8 + 2**-20, -2.5, np.inf, 0.0])
    assert tiles.numbers(tiles.packed(bits, "BF16"), "BF16").tolist() == [1.0, 1.0, 1.0 + 2**-6, 1.0 + 2**-7, -2.5, np.inf, 0.0]
    assert np.isnan(tiles.numbers(tiles.packed(np.array([np.nan]), "BF16"), "BF16")[0])


def test_tensor_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    named = {"a": rng.standard_normal((9, 7)).astype(np.float32), "b": rng.standard_normal(5).astype(np.float16), "c": rng.standard_normal((3, 2, 2)).astype(np.float32)}
    (tmp_path / "m").mkdir()
    for shard, names in (("x.safetensors", "ab"), ("y.safetensors", "bc")):  # b is in both; the index decides
        at, head, body = 0, {"__metadata__": {"k": "v"}}, b""
        for n in names:
            data = named[n].tobytes() if not (n == "b" and shard[0] == "y") else b"\0" * 10
            head[n] = {"dtype": {"float32": "F32", "float16": "F16"}[str(named[n].dtype)], "shape": list(named[n].shape), "data_offsets": [at, at + len(data)]}
            at, body = at + len(data), body + data
        said = json.dumps(head).encode()
        (tmp_path / "m" / shard).write_bytes(len(said).to_bytes(8, "little") + said + body)
    (tmp_path / "m/model.safetensors.index.json").write_text(json.dumps({"weight_map": {"a": "x.safetensors", "b": "x.safetensors", "c": "y.safetensors"}}))
    (tmp_path / "m/config.json").write_text("{}")

    def values(path):
        return {(r["module"], r["i"], r["j"]): r["v"] for r in tiles.cells(tensor_files.read(spark, path, 4), size=4).collect()}

    want = {(n, *k): float(v) for n, x in named.items() for k, v in np.ndenumerate(x.reshape(tensor_files.extent(list(x.shape))))}
    assert values(str(tmp_path / "m")) == want == values(f"file://{tmp_path}/m")
    read = tensor_files.read(spark, str(tmp_path / "m"), 4)
    assert read.rdd.getNumPartitions() == 3  # one a tensor
    tensor_files.save(read, str(tmp_path / "n"), sidecars=str(tmp_path / "m"))
    assert values(str(tmp_path / "n")) == want and sorted(p.name for p in (tmp_path / "n").iterdir()) == ["config.json", "model.safetensors.index.json", "x.safetensors", "y.safetensors"]
    broken = read.where("not (module = 'a' and bj = 1)")  # a tensor without some of its tiles
    with pytest.raises(Exception, match="lacks tiles"):
        tensor_files.save(broken, str(tmp_path / "n"))
    assert values(str(tmp_path / "n")) == want and len(list((tmp_path / "n").iterdir())) == 4
    with pytest.raises(Exception, match="lacks tiles"):
        tensor_files.save(broken, str(tmp_path / "none"))
    assert not list((tmp_path / "none").iterdir())


def test_saved_datasets(spark, tmp_path):
    df = spark.range(100).select("id", F.concat(F.lit("some text "), "id").alias("text"), F.array(F.lit(1), F.lit(None)).alias("xs")).repartition(3, "id")
    at = str(tmp_path / "d")
    saved_datasets.save(df, at)
    state = json.loads((tmp_path / "d/state.json").read_text())
    files = [pa.ipc.open_stream((tmp_path / "d" / x["filename"]).read_bytes()).read_all() for x in state["_data_files"]]
    assert len(files) == 3
    rows = readers.indexed(spark, at).orderBy("idx").collect()
    assert [r["id"] for r in rows] == [x for t in files for x in t["id"].to_pylist()] and [r["idx"] for r in rows] == list(range(100)) and rows[0]["xs"] == [1, None]
    only = readers.indexed(spark, at, ["text"])
    assert only.columns == ["text", "idx"] and builders.BUILDERS["yousefmd"](only).count() == 100
    saved_datasets.save(df.limit(0), at)
    assert readers.indexed(spark, at).count() == 0 and not saved_datasets.exists(str(tmp_path))
    bad = df.withColumn("id", F.when(F.col("id") == 50, F.raise_error("broken")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        saved_datasets.save(bad, str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").iterdir())


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(1500):
        a, b = ("".join(rng.choices("abé𝄞", k=rng.randint(0, 20))) for _ in range(2))
        want = edits(a, b)
        assert edit.edit_distance(a, b) == want
        x, y = sorted((np.array([*map(ord, t)], np.uint32) for t in (a, b)), key=len)
        if len(x):
            assert edit.by_bits(x, y) == want
            for k in (3, 20):
                assert len(y) - len(x) > k or edit.within(x, y, k) == (want if want <= k else None)


def test_edit_distance_of_long_texts(spark, monkeypatch):
    rng = random.Random(7)
    a = "".join(rng.choices("abcdefgh ", k=100_000))
    b = list(a)
    for _ in range(200):
        b[rng.randrange(len(b))] = "X"
    b = "".join(b)
    rows = spark.createDataFrame([(a, b), (a[:3000], a[1500:4500]), ("x", None), ("", "ab"), ("ab", "b")], "a string, b string").select(edit.distance(F.col("a"), F.col("b")).alias("d"), "a", "b").collect()
    assert [r["d"] for r in rows] == [sum(x != y for x, y in zip(a, b, strict=True)), edit.edit_distance(a[:3000], a[1500:4500]), None, 2, 1]


def test_merge_and_its_report(spark, tmp_path):
    f = spark.createDataFrame([(m, k, 0, 0, 2.0) for m in ("m", "wide", "lost") for k in "AB"] + [("half", "A", 0, 0, 1.0)], "module string, factor string, i long, j long, v double")
    base = spark.createDataFrame([("m", 0, 0, 1.0), ("wide", 0, 0, 1.0), ("wide", 0, 1, 1.0), ("half", 0, 0, 1.0)], "module string, i long, j long, v double")
    merged = linalg.merge(base, f, 0.5)
    assert {(r["module"], r["j"]): (r["v"], r["changed"]) for r in merged.collect()} == {("m", 0): (3.0, True), ("wide", 0): (1.0, False), ("wide", 1): (1.0, False), ("half", 0): (1.0, False)}
    assert linalg.verified(base, f, merged) == {"targets": 3, "mismatched": 1, "missing": 1, "max_change": 2.0, "applied": 1}
    assert [r["module"] for r in linalg.missing(base, f).collect()] == ["lost"]
    with pytest.raises(ValueError, match="not applied"):
        linalg.verified(base, f.where("module <> 'm'"), base.withColumn("changed", F.lit(False)))
    index = spark.createDataFrame([("m", "s1"), ("wide", "s2"), ("half", "s1")], "module string, shard string")
    out = str(tmp_path / "merged")
    assert sinks.save_merged(merged, index, out) == 4 and sinks.save_merged(merged, index, out) is None
    sinks.save_adapter(f, spark.createDataFrame([(1, 2)], "r int, alpha int"), str(tmp_path / "adapter"))
    assert spark.read.parquet(str(tmp_path / "adapter/factors")).count() == 7
    (tmp_path / "index.json").write_text(json.dumps({"weight_map": {"m": "a.parquet", "wide": "b.parquet"}}))
    for shard, module in (("a", "m"), ("b", "wide"), ("c", "m")):
        base.where(F.col("module") == module).toPandas().to_parquet(tmp_path / f"{shard}.parquet")
    assert sorted((r["module"], r["shard"]) for r in readers.tensors(spark, str(tmp_path), str(tmp_path / "index.json")).collect()) == [("m", "a.parquet"), ("wide", "b.parquet"), ("wide", "b.parquet")]


def test_builders(spark):
    df = spark.createDataFrame([(0, "a", 50, 50), (1, " ok one ", 50, 50), (2, "ok two", 9, 50), (3, "ok three", 50, 50)], "idx long, text string, w int, h int")
    got = [tuple(r)[2:] for r in builders.build(df, builders.SOURCES["khatt_para"]).orderBy("idx").collect()]
    assert got == [(T.PROMPTS[1], "ok one", "khatt_para", "handwritten_para_real", 50, 50), (T.PROMPTS[2], "ok three", "khatt_para", "handwritten_para_real", 50, 50)]
    chat = spark.createDataFrame([(0, [("<|User|>", "q"), ("<|Assistant|>", "from chat")], "flat"), (1, None, "flat"), (2, [("<|Assistant|>", "alone")], "flat"), (3, [], "flat 3")], "idx long, messages array<struct<role: string, content: string>>, assistant_content string")
    assert [r["response"] for r in builders.build(chat, builders.SOURCES["qari10k"]).orderBy("idx").collect()] == ["from chat", "flat", "flat 3"]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"a": {"cer": 0.5, "wer": 0.6, "n": 3}, "b": {"cer": 1.0, "wer": 1.0, "n": 1, "teds": 2.5, "teds_n": 1}}, indent=1))
    assert {(r["suite"], r["cer"], r["teds_n"]) for r in readers.summaries(spark, str(tmp_path / "s.json")).collect()} == {("a", 0.5, None), ("b", 1.0, 1)}
    for kind, name, body in (("img", "x.jpg", b"jpg"), ("img", "y.jpg", b"jpg"), ("img", "z.jpg", b""), ("txt", "x.txt", "كت".encode("cp1256")), ("txt", "z.txt", b"z")):
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / name).write_bytes(body)
    assert [(r["stem"], r["text"]) for r in readers.image_text_pairs(spark, str(tmp_path / "img"), str(tmp_path / "txt")).collect()] == [("x", "كت")]
    shard = str(tmp_path / "shard")
    assert sinks.save_shard(spark.range(5), shard) == 5 and sinks.save_shard(spark.range(9), shard) is None and sinks.save_shard(spark.range(9), shard, force=True) == 9


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x14\0\0\0\x1e\x08\x02"
JPEG = b"\xff\xd8\xff\xe0\0\x04xx\xff\xff\xc0\0\x11\x08\0\x1e\0\x14\x03"


def test_images_that_cannot_be_read_are_dropped(spark):
    for data, size in ((PNG, (20, 30)), (JPEG, (20, 30)), (b"GIF89a\x14\0\x1e\0", (20, 30)), (b"\xff\xd8\xff\xe0\0\x04", None), (PNG[:20], None), (b"", None), (None, None), (b"\xff\xd8" + b"\xff" * 40, None)):
        assert I.header_size(data) == size
    rows = [(0, "text one", (PNG, None)), (1, "text two", (b"broken", None)), (2, "text three", None), (3, "text four", (JPEG, "p"))]
    df = spark.createDataFrame(rows, "idx long, chosen string, images struct<bytes: binary, path: string>")
    assert sorted((r["idx"], r["w"], r["h"]) for r in builders.BUILDERS["nakba"](df).collect()) == [(0, 20, 30), (3, 20, 30)]


def test_corpus_is_written_and_resumed(spark, tmp_path):
    df = spark.range(30).select(F.col("id").alias("idx"), F.concat(F.lit("some text "), "id").alias("text"))
    at = f"{tmp_path}/shards"
    assert sinks.save_shard(builders.BUILDERS["aallail"](df), f"{at}/aallail") == 30 and sinks.save_shard(builders.BUILDERS["hastyle"](df), f"{at}/hastyle") == 30
    df.write.parquet(f"{at}/broken")
    (tmp_path / "shards/broken/_SUCCESS").unlink()
    body = sinks.save_corpus(sinks.shards(spark, at), str(tmp_path), holdout=10)
    assert body == {"total_train": 40, "total_val": 20, "by_source": {"aallail_synth2": 20, "hastyle_manuscript": 20}, "by_domain": {"line_synth": 20, "manuscript": 20}}
    assert json.loads((tmp_path / "STATS.md").read_text().split("```")[1].removeprefix("json")) == body
    train, val = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("unified", "val"))
    assert train.count() == 40 and val.count() == 20 and train.join(val, "id").count() == 0
    with pytest.raises(ValueError, match="no complete shard"):
        sinks.shards(spark, f"{at}/broken")
    for name, n in (("unified", 40), ("val", 20)):
        ids = [r["id"] for r in readers.indexed(spark, f"{tmp_path}/{name}/*.parquet", ["id"]).orderBy("idx").collect()]
        assert len(ids) == n and ids == sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    clash = spark.range(40).select(F.col("id") % 8, F.lit("s").alias("source"), F.lit("d").alias("domain"))
    with pytest.raises(ValueError, match="share their id"):
        sinks.save_corpus(clash.toDF("id", "source", "domain"), f"{tmp_path}/clash", holdout=3)
    none = sinks.save_corpus(sinks.shards(spark, at).limit(0), f"{tmp_path}/none")
    assert none["total_train"] == 0 and spark.read.parquet(f"{tmp_path}/none/val").count() == 0


def test_numbers_in_names_of_files():
    name = "part-00012-1a2b3c4d-c123-4c05-c999-c11111111111-c003.snappy.parquet"
    assert (re.search(corpus.PART, name)[1], re.search(corpus.CHUNK, name)[1]) == ("00012", "003")


def test_counters_over_several_files_a_task(spark):
    df = spark.createDataFrame([(k % 3, (k * 7919) % 1000) for k in range(1000)], "g int, k long")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 30)
    try:
        all_, by = corpus.with_counter(df, "k").collect(), corpus.with_counter(df, "k", "i", by=["g"], total="n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted((r["i"], r["k"]) for r in all_) == [(k + 1, k) for k in range(1000)]
    for g in range(3):
        own = sorted((r["i"], r["k"]) for r in by if r["g"] == g)
        assert [i for i, _ in own] == list(range(1, len(own) + 1)) and [k for _, k in own] == sorted(k for _, k in own) and {r["n"] for r in by if r["g"] == g} == {len(own)}


def test_commands(spark, tmp_path):
    from quillspark.plans import run

    src, out = tmp_path / "sources", str(tmp_path / "out")
    frame = lambda rows, kind, path: (path.parent.mkdir(parents=True, exist_ok=True), spark.createDataFrame(rows, kind).toPandas().to_parquet(path))
    frame([(f"text {k}",) for k in range(5)], "text string", src / "yousefmd/a.parquet")
    for k, split in enumerate(("train", "validation", "test")):
        frame([(f"x/{split}.png", f"<p>page of {split}</p>")], "image string, text string", src / f"namaa/{split}/a.parquet")
        (src / "namaa/images").mkdir(exist_ok=True)
        (src / f"namaa/images/{split}.png").write_bytes(PNG)
        (src / f"khatt_lines/{split}").mkdir(parents=True)
        (src / f"khatt_lines/{split}/metadata.csv").write_text(f"file_name,text\np_{k}_0.jpg,{'one two'[::-1]}\np_{k}_1.jpg,{'three'[::-1]}\n")
        for j in (0, 1):
            (src / f"khatt_lines/{split}/p_{k}_{j}.jpg").write_bytes(JPEG)
    for kind, name, body in (("images", "b.jpg", JPEG), ("images", "a.jpg", JPEG), ("images", "c.jpg", b"broken"), ("text", "a.txt", b"first text"), ("text", "b.txt", b"a long benchmark begins like this and goes on"), ("text", "c.txt", b"third")):
        (src / f"khatt_para/proc_{kind}").mkdir(parents=True, exist_ok=True)
        (src / f"khatt_para/proc_{kind}/{name}").write_bytes(body)
    frame([("a long benchmark begins like this",)], "text string", tmp_path / "bench.parquet")
    args = ["build", "yousefmd", "namaa", "khatt_para", "khatt_lines", "--sources", str(src), "--out", out, "--benchmark", str(tmp_path / "bench.parquet")]
    assert run.main(args, spark) == {"yousefmd": 5, "namaa": 2, "khatt_para": 1, "khatt_lines": 6}
    assert set(run.main(args, spark).values()) == {None} and run.main([*args, "--force"], spark)["namaa"] == 2
    assert [r["response"] for r in spark.read.parquet(f"{out}/shards/khatt_lines").orderBy("idx").collect()] == ["one two", "three"] * 3
    merged = run.main(["merge", "--out", out], spark)
    zero = dict.fromkeys(builders.RULES, 0)
    want = {"yousefmd": {"n": 5} | zero, "namaa": {"n": 2} | zero, "khatt_para": {"n": 3, "invalid": 1, "contaminated": 1} | {r: 0 for r in ("sampled", "excluded", "missing")}, "khatt_lines": {"n": 6} | zero}
    assert merged["total_val"] == 14 and merged["dropped"] == want and "contaminated" in (tmp_path / "out/STATS.md").read_text()
    p = spark.createDataFrame([("r", "s", 0, "a  b", "a c"), ("r", "t", 0, "<table><tr><td>a</td></tr><tr><td>b</td></tr></table>", "| a |\n| b |")], "run string, suite string, i long, ref string, hyp string")
    sinks.save_predictions(p, str(tmp_path / "p"))
    run.main(["evaluate", "--predictions", str(tmp_path / "p"), "--summary", str(tmp_path / "summary"), "--tables"], spark)
    got = {r["suite"]: (r["wer"], r["teds"]) for r in sinks.read_version(spark, str(tmp_path / "summary")).collect()}
    assert got["s"] == (0.5, None) and got["t"][1] == 100.0
    for name in ("x", "y"):
        cells = [("m", f, 0, 0, 2.0) for f in "AB"]
        sinks.save_adapter(spark.createDataFrame(cells, "module string, factor string, i long, j long, v double"), spark.createDataFrame([(1, 2, "q")], "r int, alpha int, target_modules string"), str(tmp_path / name))
    assert run.main(["soup", "--mix", f"{tmp_path}/x:0.25", "--mix", f"{tmp_path}/y:0.75", "--out", str(tmp_path / "xy")], spark) == {"r": 2, "alpha": 4}
    assert [r["v"] for r in linalg.product(spark.read.parquet(str(tmp_path / "xy/factors"))).collect()] == [4.0]


def test_commands_of_runs(spark, tmp_path):
    from quillspark.plans import run

    texts = {"arocrbench_arabicocr": ["one two", "three four"], "misraj_dococr": [f"page {k} of many" for k in range(40)]}
    (tmp_path / "suites/arocrbench_arabicocr/test").mkdir(parents=True)
    (tmp_path / "suites/misraj_dococr").mkdir()
    spark.createDataFrame([(t,) for t in texts["arocrbench_arabicocr"]], "text string").toPandas().to_parquet(tmp_path / "suites/arocrbench_arabicocr/test/a.parquet")
    spark.createDataFrame([(t,) for t in texts["misraj_dococr"]], "markdown string").toPandas().to_parquet(tmp_path / "suites/misraj_dococr/a.parquet")
    said = [("r", s, i, "stale", t if (i + 1) % 3 else t * 3) for s, ts in texts.items() for i, t in enumerate(ts) if i != 1] + [("r", "arocrbench_arabicocr", 99, "gone", "gone")]
    sinks.save_predictions(spark.createDataFrame(said, "run string, suite string, i long, ref string, hyp string"), str(tmp_path / "p"))
    common = ["--predictions", str(tmp_path / "p"), "--references", str(tmp_path / "suites")]
    run.main(["evaluate", *common, "--summary", str(tmp_path / "sum")], spark)
    got = {r["suite"]: r for r in sinks.read_version(spark, str(tmp_path / "sum")).collect()}
    assert got["arocrbench_arabicocr"]["n"] == 2 and got["arocrbench_arabicocr"]["cer"] == round(10 / 17, 4) and got["misraj_dococr"]["n"] == 40
    record = run.main(["devrun", *common, "--out", str(tmp_path / "dev.json")], spark)
    assert record["aborted"] and list(record["suites"]) == ["arocrbench_arabicocr"] and json.loads((tmp_path / "dev.json").read_text()) == record
    again = run.main(["devrun", *common, "--out", str(tmp_path / "dev2.json"), "--baseline", str(tmp_path / "dev.json")], spark)
    assert not again["aborted"] and again["suites"]["arocrbench_arabicocr"]["ratio"] == pytest.approx(1, abs=1e-3) and [x["n"] for x in again["suites"].values()] == [2, 30, 2]
    rates = run.main(["sweep", *common, "--out", str(tmp_path / "sweep.json")], spark)
    assert {(x["bucket"], x["n"]) for x in rates} == {("looper", 13), ("good", 27), (None, 2)} and rates == json.loads((tmp_path / "sweep.json").read_text())
    assert run.main(["preferences", *common, "--out", str(tmp_path / "pairs"), "--limit", "100"], spark) == 13  # different and not empty
    one = spark.read.json(str(tmp_path / "pairs")).first()
    assert one["chosen"][1]["content"][0]["text"] * 3 == one["rejected"][1]["content"][0]["text"]
    empty = spark.createDataFrame([("r", "x", 0, "", "y")], "run string, suite string, i long, ref string, hyp string")
    sinks.save_predictions(empty, str(tmp_path / "e"))
    run.main(["evaluate", "--predictions", str(tmp_path / "e"), "--summary", str(tmp_path / "sum")], spark)
    assert {(r["suite"], r["n"]) for r in sinks.read_version(spark, str(tmp_path / "sum")).collect()} >= {("x", 0), ("misraj_dococr", 40)}


def test_commands_of_corpora_and_models(spark, tmp_path):
    from quillspark.plans import run

    rows = spark.range(400).select(F.concat(F.lit("s:"), "id").alias("id"), F.lit("s").alias("source"), F.when(F.col("id") % 4 == 0, "manuscript").otherwise("doc_markdown").alias("domain"), F.concat(F.lit("text "), "id").alias("response"))
    sinks.save_corpus(rows, str(tmp_path / "c"), holdout=0)
    assert run.main(["mixture", "--corpus", str(tmp_path / "c"), "--recipe", "4", "--out", str(tmp_path / "mix")], spark) == 300 + 200
    keys = [f"{r['id']}:{r['copy']}" for r in readers.indexed(spark, f"{tmp_path}/mix/*.parquet", ["id", "copy"]).orderBy("idx").collect()]
    assert keys == sorted(keys, key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k)) and len(set(keys)) == 500
    assert run.main(["mixture", "--corpus", str(tmp_path / "c"), "--recipe", "4", "--out", str(tmp_path / "mix"), "--smoke"], spark) == 500
    rng = np.random.default_rng(2)
    cell = lambda name, x, dtype, shard: [(shard, name, dtype, list(x.shape), 0, 0, *x.shape, tiles.packed(x.ravel(), dtype))]
    w, a, b = rng.standard_normal((6, 5)), rng.standard_normal((2, 5)), rng.standard_normal((6, 2))
    kind = tensor_files.SCHEMA
    tensor_files.save(spark.createDataFrame(cell("model.q.weight", w, "BF16", "1.safetensors") + cell("model.norm.weight", w, "F32", "2.safetensors"), kind), str(tmp_path / "base"))
    (tmp_path / "base/config.json").write_text("{}")
    tensor_files.save(spark.createDataFrame(cell("base_model.model.model.q.lora_A.weight", a, "F32", "adapter_model.safetensors") + cell("base_model.model.model.q.lora_B.weight", b, "F32", "adapter_model.safetensors"), kind), str(tmp_path / "ad"))
    (tmp_path / "ad/adapter_config.json").write_text('{"lora_alpha": 4, "r": 2}')
    report = run.main(["basemerge", "--base", str(tmp_path / "base"), "--adapter", str(tmp_path / "ad"), "--out", str(tmp_path / "merged")], spark)
    assert (report["targets"], report["applied"]) == (1, 1) and (tmp_path / "merged/config.json").exists()
    back = {r["module"]: tiles.numbers(r["data"], r["dtype"]).reshape(6, 5) for r in tensor_files.read(spark, str(tmp_path / "merged")).collect()}
    f32 = lambda x: x.astype(np.float32).astype(float)
    rounded = lambda x: tiles.numbers(tiles.packed(x.ravel(), "BF16"), "BF16").reshape(x.shape)
    assert np.array_equal(back["model.q.weight"], rounded(rounded(w) + 2 * (f32(b) @ f32(a)))) and np.array_equal(back["model.norm.weight"], f32(w))
    with pytest.raises(ValueError, match="has a model"):
        run.main(["basemerge", "--base", str(tmp_path / "base"), "--adapter", str(tmp_path / "ad"), "--out", str(tmp_path / "merged")], spark)


def test_scans_in_stored_order(spark, tmp_path):
    for split, files in (("train", {"b": [2, 3], "a": [0, 1]}), ("validation", {"a": [4]}), ("test", {"a": [9]})):
        for name, values in files.items():
            (tmp_path / split).mkdir(exist_ok=True)
            spark.createDataFrame([(f"t{v}",) for v in values], "text string").toPandas().to_parquet(tmp_path / split / f"{name}.parquet")
    got = readers.splits(spark, str(tmp_path), ["train", "validation"]).orderBy("idx").collect()
    assert [(r["idx"], r["split"], r["text"]) for r in got] == [(k, "train" if k < 4 else "validation", f"t{k}") for k in range(5)]
    assert [(r["i"], r["ref"]) for r in readers.suite(spark, str(tmp_path), "arocrbench_hindawi").orderBy("i").collect()] == [(0, "t9")]  # the first split by name
    assert readers.suite(spark, str(tmp_path / "train"), "nakba_test", limit=3).count() == 3
    (tmp_path / "m.csv").write_text('file_name,text\np_1_2.jpg,"a, b"\n')
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "m.csv"), "file_name string, text string").collect()] == [("p_1_2.jpg", "a, b")]
    assert one(spark, "p_1_2.jpg", T.before_last) == "p_1" and one(spark, "plain", T.before_last) == "plain"
    with pytest.raises(ValueError, match="no chunk"):
        readers.chunks(spark, str(tmp_path))
    spark.range(3).toPandas().to_parquet(tmp_path / "chunk_0.parquet")
    assert readers.chunks(spark, str(tmp_path)).count() == 3


def test_runs_are_scored_and_kept(spark, tmp_path):
    kind = "run string, suite string, i long, ref string, hyp string"
    page = "<table><tr><td>a</td></tr></table>"
    p = spark.createDataFrame([("r", "s", 0, "a b", "a c"), ("r", "s", 1, page, page), ("r", "t", 0, "x", None)], kind)
    sinks.save_predictions(p, str(tmp_path / "p"))
    back = readers.predictions(spark, str(tmp_path / "p"))
    assert sorted((r["suite"], r["i"], r["hyp"]) for r in back.collect()) == [("s", 0, "a c"), ("s", 1, page), ("t", 0, None)]
    made = {r["suite"]: r for r in metrics.summary(back, back, ["suite"]).collect()}
    assert made["s"]["teds"] == 100.0 and made["s"]["teds_n"] == 1 and made["s"]["cer"] == round(1 / 37, 4) and made["t"]["teds"] is None and made["t"]["wer"] == 1.0
    path = str(tmp_path / "summary")
    first = spark.createDataFrame([("s", 0.5), ("t", 0.6)], "suite string, cer double")
    assert sinks.read_version(spark, path) is None
    sinks.upsert(first, path, ["suite"])
    sinks.upsert(first.where("suite = 't'").withColumn("cer", F.lit(0.1)), path, ["suite"])
    (tmp_path / "summary/v9").mkdir()  # a write that did not end
    assert {tuple(r) for r in sinks.read_version(spark, path).collect()} == {("s", 0.5), ("t", 0.1)}
    sinks.upsert(first.where("suite = 's'"), path, ["suite"])
    assert {tuple(r) for r in sinks.read_version(spark, path).collect()} == {("s", 0.5), ("t", 0.1)}
    slices = [("canary", spark.createDataFrame([("abcd", "abcx")], "ref string, hyp string")), ("next", spark.createDataFrame([("ab", "ab"), ("", "z")], "ref string, hyp string"))]
    assert metrics.dev_run("a", slices) == {"adapter": "a", "suites": {"canary": {"cer": 0.25, "wer": 1.0, "n": 1}}, "aborted": True, "abort_reason": "canary CER 0.2500 > 0.2000"}
    run = metrics.dev_run("a", slices, {"canary": 0.0625, "next": 0.0})
    assert not run["aborted"] and run["suites"]["canary"]["ratio"] == 4.0 and run["suites"]["next"] == {"cer": 0.0, "wer": 0.0, "n": 1, "ratio": float("inf")}
    sinks.save_json(spark, str(tmp_path / "run.json"), run | {"suites": "é"})
    assert json.loads((tmp_path / "run.json").read_text())["suites"] == "é"
    nan = metrics.sweep(spark.createDataFrame([("c", "", "x"), ("c", "ab", "ab"), ("d", "ab", "abc")], "c string, ref string, hyp string"), ["c"]).collect()
    assert {r["c"]: repr((r["mean_cer"], r["mean_ratio"])) for r in nan} == {"c": "(nan, 1.0)", "d": "(0.5, 1.5)"}


def test_two_writers_of_a_summary(spark, tmp_path, monkeypatch):
    path, kind = str(tmp_path / "s"), "suite string, cer double"
    sinks.upsert(spark.createDataFrame([("a", 0.1), ("b", 0.2)], kind), path, ["suite"])
    plain, others = metrics.upsert, [("c", 0.3), ("b", 0.9)]

    def late(old, new, key):
        if others:  # another writer comes in between the read and the write, twice
            monkeypatch.setattr(metrics, "upsert", plain)
            sinks.upsert(spark.createDataFrame([others.pop()], kind), path, ["suite"])
            monkeypatch.setattr(metrics, "upsert", late)
        return plain(old, new, key)

    monkeypatch.setattr(metrics, "upsert", late)
    sinks.upsert(spark.createDataFrame([("a", 0.5)], kind), path, ["suite"])
    assert not others and {tuple(r) for r in sinks.read_version(spark, path).collect()} == {("a", 0.5), ("b", 0.9), ("c", 0.3)}
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")) == ["v2", "v3"]


def test_scratch_needs_a_shared_folder(spark):
    from types import SimpleNamespace as Some

    from quillspark.sources import scratch

    t = scratch.stored(spark.range(3), "t")
    assert t.count() == 3
    scratch.discard(t)
    session = lambda master, base: Some(conf=Some(get=lambda *_: base), sparkContext=Some(master=master, applicationId="app"))
    assert scratch.folder(session("spark://host:7077", "hdfs:/x")) == "hdfs:/x/quillspark/app"
    for master in ("spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.folder(session(master, None))


def test_incremental_ingest(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(2):
        spark.range(3 + k).select(F.lit("s").alias("source")).write.mode("append").parquet(folder)
        ingest(spark, folder, "source string", out, check)
    assert sinks.read_version(spark, out).agg(F.sum("n")).first()[0] == 7


def test_builders_repair_a_text_once(spark):
    """The filter on the repaired text does not go below the repair, which would then run twice; marks and white space go
    as before."""
    from quillspark.sources import builders

    odd = ["", " ", "\u200b", "\u200f a\u200e b\ufeff ", "\x1fab\u3000", "ab", "\ufeff\n\u2028x y\x85", "\u200b  ", "fi\u200bne \ufb01", None, "\xa0e\u0301\xa0"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "idx long, text string")
    built = builders.BUILDERS["aallail"](df)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("trim(") == 1
    want = {k: unicodedata.normalize("NFKC", x or "").translate(dict.fromkeys(map(ord, T.MARKS))).strip(T.WHITE) for k, x in enumerate(odd)}
    assert {r["idx"]: r["response"] for r in built.collect()} == {k: x for k, x in want.items() if len(x) >= 2}
