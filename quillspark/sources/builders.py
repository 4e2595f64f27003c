"""Per-source builders of corpus rows (idx, key, prompt, response, source, domain, and w, h where images have sizes).
`key` is unique in a source: idx, and the part or region beside it where idx is not.

Most sources are specifications over one generic builder; four have steps of their own. A builder takes DataFrames with
`idx` (position in the source, from 0) and the source's own columns. Images come as bytes, whose header is read, or as
their sizes `w`, `h`; one that is missing or cannot be read has no size, and its row goes. No pixels are decoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import image as I
from ..functions import text as T
from ..operators import corpus
from ..operators.corpus import nth, valid, with_counter
from . import readers
from .scratch import stored


@dataclass(frozen=True)
class Source:
    tag: str
    domain: str
    text: Callable[[], Column]
    excluded: str = ""  # rows whose own `source` contains this
    every: int = 1
    after: bool = False  # prompts follow a counter of the valid rows, from 1; else the source's index
    image: Callable[[], Column] | None = None  # the image's bytes, where they are not in `image`


def _plain(name: str) -> Callable[[], Column]:
    return lambda: T.source_norm(F.col(name))


def _page(name: str) -> Callable[[], Column]:
    return lambda: T.squeeze_blank_lines(T.source_norm(T.drop_images(F.coalesce(F.col(name), F.lit("")))))


def said_by(who: str) -> Column:
    """The first message whose role contains a word, whatever the case."""
    return F.get(F.filter("messages", lambda m: F.contains(F.lower(F.coalesce(m["role"], F.lit(""))), F.lit(who))), F.lit(0))


def chat_or_flat() -> Column:
    """What the assistant said first, null where no user did; the flat column where there are no messages."""
    from_chat = F.when(said_by("user").isNotNull(), said_by("assistant")["content"])
    return F.when(F.coalesce(F.size("messages"), F.lit(0)) > 0, from_chat).otherwise(F.col("assistant_content"))


#: Names, tags, domains and text columns.
SOURCES = {
    "aallail": Source("aallail_synth2", "line_synth", _plain("text")),
    "yousefmd": Source("yousefmd", "line_real", _plain("text")),
    "nakba": Source("nakba_chosen", "newspaper", _plain("chosen")),
    "qari10k": Source("qari10k", "doc_markdown", lambda: T.source_norm(chat_or_flat())),
    "omar": Source("omar_markdown", "doc_markdown", _plain("markdown")),
    "namaa": Source("namaa_qari03", "doc_markdown", lambda: T.source_norm(T.html_to_md(F.col("text"))), after=True),
    "hastyle": Source("hastyle_manuscript", "manuscript", _page("text")),
    "okai": Source("okai_muharaf", "handwritten_line", _plain("text"), excluded="arocrbench"),
    "mssqpi": Source("mssqpi_words", "word_crop", _plain("text"), every=72),
    "presightai": Source("presightai", "doc_markdown", lambda: T.unwrap_fence(T.source_norm(F.col("markdown"))), after=True),
    "khatt_para": Source("khatt_para", "handwritten_para_real", _plain("text"), after=True),
    "khatt_lines": Source("khatt_lines", "handwritten_line", lambda: T.source_norm(F.reverse("text")), after=True),
    "img2md": Source("img2md", "doc_markdown", _page("markdown"), after=True),
}
STACKED_TAG, STACKED_DOMAIN, REGION_TAG = "okai_muharaf_para", "handwritten_paragraph", "jayanthmuthu_"
#: Names that are built where none are given.
DEFAULT = ["yousefmd", "nakba", "qari10k", "omar"]


def sized(df: DataFrame) -> DataFrame:
    """df with w and h from `image` or `images` (bytes, or a struct that has them), where it has such a column."""
    kinds = dict(df.dtypes)
    for name in ("images", "image"):
        if kinds.get(name) == "binary":
            return df.withColumn("_s", I.size_of(F.col(name))).select(*df.columns, "_s.w", "_s.h")
        if kinds.get(name, "").startswith("struct") and "bytes:binary" in kinds[name]:
            return df.withColumn("_s", I.size_of(F.col(f"{name}.bytes"))).select(*df.columns, "_s.w", "_s.h")
    return df


#: Why a row is dropped, in the order in which the first that applies counts.
RULES = ["sampled", "excluded", "missing", "invalid", "contaminated"]


def repaired(df: DataFrame, spec: Source) -> DataFrame:
    """The source's rows in use, with `response`."""
    if spec.every > 1:
        df = nth(df, "idx", spec.every)
    if spec.excluded:
        df = df.where(~F.contains(F.coalesce("source", F.lit("")), F.lit(spec.excluded)))
    return repaired_once(sized(df), spec)


def repaired_once(df: DataFrame, spec: Source) -> DataFrame:
    """df with `response`, as the only row of each row's array: filters on it, which else would go down to the scan and
    repair the text a second time, stay above."""
    rest = [c for c in df.columns if c != "response"]
    return df.select(*rest, F.explode(F.array(spec.text())).alias("response"))


def fit(df: DataFrame) -> DataFrame:
    return df.where(is_fit(df))


def is_fit(df: DataFrame) -> Column:
    return valid(F.col("response"), *([F.col("w"), F.col("h")] if {"w", "h"} <= set(df.columns) else []))


def used(df: DataFrame, spec: Source, counts: Observation | None = None, missing: Column | None = None, dirty: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of a source that are kept, with `response`. missing: rows without their image; dirty: adds the column
    `_dirty`. counts gets `n` rows and how many each of RULES drops, in the pass that makes the rows; where a numbering
    follows, which reads its input twice, they are written first. Without counts, filters may go down to the scan."""
    if counts is None:
        kept = repaired(df if missing is None else df.where(~missing), spec)
        return fit(kept if dirty is None else dirty(kept).where("not _dirty").drop("_dirty"))
    df = repaired_once(sized(df), spec)
    df = df.withColumn("_dirty", F.lit(False)) if dirty is None else dirty(df)
    tests = {
        "sampled": F.col("idx") % spec.every != 0,
        "excluded": F.contains(F.coalesce("source", F.lit("")), F.lit(spec.excluded)) if spec.excluded else F.lit(False),
        "missing": F.lit(False) if missing is None else missing,
        "invalid": ~is_fit(df),
        "contaminated": F.col("_dirty"),
    }
    rule = F
    for name in RULES:
        rule = rule.when(tests[name], name)
    df = df.withColumn("_rule", rule.otherwise(None)).observe(counts, F.count("*").alias("n"), *[F.count_if(F.col("_rule") == name).alias(name) for name in RULES])
    kept = df.where("_rule is null").drop("_rule", "_dirty")
    return stored(kept, "kept") if spec.after else kept


def rows(df: DataFrame, tag: Column, domain: Column, counter: Column | None, order: list[str] = ("idx",), key: list[str] = ("idx",)) -> DataFrame:
    """Corpus rows; prompts by counter, or by place among these rows from 1 where it is None."""
    df = df.withColumn("_i", counter) if counter is not None else with_counter(df, list(order), "_i")
    keep = [c for c in ("w", "h") if c in df.columns]
    return df.select("idx", F.concat_ws(":", *[F.col(c).cast("string") for c in key]).alias("key"), T.prompt(F.col("_i")).alias("prompt"), "response", tag.alias("source"), domain.alias("domain"), *keep)


def build(df: DataFrame, spec: Source, counts: Observation | None = None) -> DataFrame:
    return rows(used(df, spec, counts), F.lit(spec.tag), F.lit(spec.domain), None if spec.after else F.col("idx"))


def namaa(splits: Iterable[DataFrame], files: DataFrame, counts: Observation | None = None) -> DataFrame:
    """splits: (idx, image: a path, text) of the train and the validation split, in this order; files: (name, length, and
    image bytes or w and h). Rows meet the file of their path's last part; empty files do not count."""
    every = None
    for k, part in enumerate(splits):
        part = part.select("idx", F.lit(k).alias("part"), F.substring_index("image", "/", -1).alias("name"), "text")
        every = part if every is None else every.unionByName(part)
    found = files.where("length > 0").dropDuplicates(["name"]).drop("length").withColumn("_there", F.lit(True))
    spec = SOURCES["namaa"]
    met = every.join(found, "name", "inner" if counts is None else "left")
    return rows(used(met, spec, counts, F.col("_there").isNull()), F.lit(spec.tag), F.lit(spec.domain), None, ["part", "idx"], ["part", "idx"])


def regions(df: DataFrame, counts: Observation | None = None) -> DataFrame:
    """df: (idx, file, annotation, and image bytes or w and h). A row for each region with a transcription, the size that
    of its box within the image, source and domain by the file's category; prompts count all rows from 1 in order of idx
    and region."""
    named = readers.regions(sized(df)).withColumn("box", I.box(F.col("points"), F.col("w").cast("double"), F.col("h").cast("double")))
    side = lambda a, b: F.greatest(F.lit(0), F.rint(b) - F.rint(a)).cast("int")
    size = {"w": side(F.col("box.x0"), F.col("box.x1")), "h": side(F.col("box.y0"), F.col("box.y1"))}
    named = named.withColumn("response", T.source_norm(F.col("transcription"))).withColumns(size)
    cat = readers.category(F.col("file"))
    if counts is not None:
        seen = named.observe(counts, F.count("*").alias("n"), *[(F.count_if(~is_fit(named)) if r == "invalid" else F.count_if(F.lit(False))).alias(r) for r in RULES])
        named = stored(fit(seen), "kept")
    return rows(fit(named), F.concat(F.lit(REGION_TAG), cat), readers.category_domain(cat), None, ["idx", "region"], ["idx", "region"])


def stacked(df: DataFrame, seed: int = 42, counts: Observation | None = None) -> DataFrame:
    """df: (idx, text, source, and image bytes or w and h). Paragraphs of three to six consecutive valid lines."""
    spec = SOURCES["okai"]
    lines = used(df, spec, counts)
    groups = corpus.stacks(lines if counts is None else stored(lines, "kept"), "idx", "response", seed)
    if "widths" in groups.columns:
        groups = groups.withColumn("_s", I.stack(F.col("widths"), F.col("heights"))).select("grp", "text", "_s.w", "_s.h")
    groups = groups.withColumnsRenamed({"grp": "idx", "text": "response"})
    return rows(fit(groups), F.lit(STACKED_TAG), F.lit(STACKED_DOMAIN), F.col("idx") + 1)


def paragraphs(df: DataFrame, benchmark: DataFrame, counts: Observation | None = None) -> DataFrame:
    """df: (idx, text, and image bytes or w and h). Scanned paragraphs without those that hold a benchmark's beginning."""
    spec = SOURCES["khatt_para"]
    clean = used(df, spec, counts, dirty=lambda d: corpus.flagged(d, corpus.probes(benchmark), "response", "_dirty"))
    return rows(clean, F.lit(spec.tag), F.lit(spec.domain), None)


def lines(df: DataFrame, benchmark: DataFrame, files: DataFrame | None = None, counts: Observation | None = None) -> DataFrame:
    """df: (idx, split, file_name, text) of all splits, idx counting on; files: (split, file_name, and image bytes or w
    and h). The lines of a paragraph, those of one split whose file names are equal up to the last underscore, all go if
    together they hold a benchmark's beginning. Prompts count paragraph by paragraph, in the order of their first lines."""
    spec = SOURCES["khatt_lines"]
    df = df.withColumns({"response": spec.text(), "para": T.before_last(F.col("file_name"))})
    df = df.withColumn("first", F.min("idx").over(W.partitionBy("split", "para")))
    clean = corpus.flagged_groups(df, benchmark, ["split", "para"], "idx", "response", "_group")
    if files is not None:
        found = sized(files).withColumn("_there", F.lit(True))
        clean = clean.join(found, ["split", "file_name"], "inner" if counts is None else "left")
    missing = F.col("_there").isNull() if files is not None else None
    kept = used(clean, spec, counts, missing, lambda d: d.withColumnRenamed("_group", "_dirty"))
    return rows(kept, F.lit(spec.tag), F.lit(spec.domain), None, ["first", "idx"])


#: Builders by name. Those of SOURCES take the source's DataFrame; the others what their docstring says. All take `counts`,
#: an Observation that is there once the rows are written.
BUILDERS: dict[str, Callable[..., DataFrame]] = {name: (lambda df, counts=None, spec=spec: build(df, spec, counts)) for name, spec in SOURCES.items()}
BUILDERS |= {"namaa": namaa, "jayanthmuthu": regions, "okai_para": stacked, "khatt_para": paragraphs, "khatt_lines": lines}
