"""Corpus assembly: validity, decontamination, shuffle, stratified holdout, counts, counters, groups of rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import discard, stored
from . import probing

#: Least text length and image side, holdout rows a domain, length of a probe.
LEAST_TEXT, LEAST_SIDE, HOLDOUT, PROBE = 2, 12, 400, 40
#: Characters of a head; characters of probes that every task may hold.
HEAD, LISTED = 16, 1 << 26


def valid(text: Column, w: Column | None = None, h: Column | None = None) -> Column:
    ok = text.isNotNull() & (F.length(text) >= LEAST_TEXT)
    return ok if w is None else ok & w.isNotNull() & h.isNotNull() & (F.least(w, h) >= LEAST_SIDE)


def seeded(seed: int, key: Column) -> Column:
    """A portable pseudo-random order: sort by this, then by the key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hashed(seed: int, key: Column) -> Column:
    """The first 60 bits of the seeded order, as a long."""
    return F.conv(F.substring(seeded(seed, key), 1, 15), 16, 10).cast("long")


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.orderBy(seeded(seed, F.col(key)), F.col(key))


def in_order(df: DataFrame, seed: int, key: str, first: list[str] = ()) -> DataFrame:
    """df for a write whose files, by name, hold the rows in seeded order; by the columns of `first` before that. Ranges
    of the order are sampled by Spark, so no task holds more than its share."""
    order = [*first, "_h", key]
    return df.withColumn("_h", seeded(seed, F.col(key))).repartitionByRange(*order).sortWithinPartitions(*order).drop("_h")


# decontamination


def probes(benchmark: DataFrame, text: str = "text", size: int = PROBE) -> DataFrame:
    """Distinct probes; empty ones are rejected, for every text contains them."""
    return benchmark.select(T.probe(F.col(text), size).alias("probe")).where("probe <> ''").distinct()


def text_id(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def listed(found: DataFrame) -> list[str] | None:
    """The probes, if there are LISTED characters of them at most, and LISTED / 40 of them; else None."""
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("probe")), F.lit(0)).alias("chars")).first()
    return [r["probe"] for r in found.collect()] if size["chars"] <= LISTED and size["n"] <= LISTED // PROBE else None


def flagged(docs: DataFrame, found: DataFrame, text: str, name: str = "dirty") -> DataFrame:
    """docs with `name`, whether the text contains a probe once its white space is collapsed; a null text does not. A
    list of up to LISTED characters goes to the tasks, which decide in place; with a longer one, which no task should
    hold, the texts that `contaminated` names are joined."""
    known = listed(found)
    said = T.collapse(F.coalesce(F.col(text), F.lit("")))
    if known is not None:
        return docs.withColumn(name, F.lit(False) if not known else probing.filtered(docs.sparkSession, known)(said))
    bad = contaminated(docs, found, text).withColumnRenamed("_id", f"_{name}_id").withColumn(name, F.lit(True))
    return docs.drop(name).join(bad, text_id(docs[text]) == bad[f"_{name}_id"], "left").drop(f"_{name}_id").withColumn(name, F.coalesce(name, F.lit(False)))


def contaminated(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """The text_id, as `_id`, of every text of docs that contains a probe once its white space is collapsed; for lists of
    any length.

    A text that contains a probe has, after some space, the HEAD characters that follow the probe's first space. These
    meet in an equi-join, which neither long documents nor long probe lists make quadratic, and only the pairs that meet
    are checked for the whole probe. Probes without such a head, short ones and those of one long word, meet by their own
    first characters, HEAD or all of them, wherever these stand in a text.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    said = docs.select(text_id(F.col(text)).alias("_id"), plain.alias("said"))
    space = F.instr("probe", " ")
    after = F.substring(F.col("probe"), space + 1, F.lit(HEAD))
    spaced = (space > 0) & (F.length(after) == HEAD)
    size = F.when(spaced, HEAD).otherwise(F.least(F.length("probe"), F.lit(HEAD)))
    headed = found.select("probe", spaced.alias("spaced"), size.alias("size"), F.when(spaced, after).otherwise(F.left("probe", size)).alias("head"))
    out = docs.sparkSession.createDataFrame([], "_id binary")
    for kind in headed.select("spaced", "size").distinct().collect():  # HEAD + 1 kinds at most
        pattern = rf"(?s){' ' if kind['spaced'] else ''}(?=(.{{{kind['size']}}}))"
        own = headed.where((F.col("spaced") == kind["spaced"]) & (F.col("size") == kind["size"])).select("head", "probe")
        heads = F.regexp_extract_all(T.collapse(F.col("said")), F.lit(pattern), F.lit(1))
        met = said.select("_id", F.explode(F.array_distinct(heads)).alias("head")).join(own, "head").select("_id", "probe").distinct()
        out = out.unionByName(said.join(met, "_id").where(F.contains(T.collapse(F.col("said")), F.col("probe"))).select("_id"))
    return out.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str) -> DataFrame:
    """docs without the rows whose text contains a probe. Rows are judged by their text alone: they need no key, and
    neither a null key nor one that occurs twice matters. A null text is clean."""
    name = f"_{uuid.uuid4().hex}"
    return flagged(docs, probes(benchmark), text, name).where(~F.col(name)).drop(name)


def decontaminate_by_probe(docs: DataFrame, benchmark: DataFrame, text: str) -> DataFrame:
    """The same by a nested loop over a small probe list; for comparison in tests."""
    return docs.join(probes(benchmark), F.contains(T.collapse(F.col(text)), F.col("probe")), "left_anti")


def group_texts(lines: DataFrame, group: list[str], pos: str, text: str) -> DataFrame:
    """The lines of a group, in order, joined by spaces."""
    said = F.struct(F.col(pos).alias("pos"), F.col(text).alias("text"))
    return lines.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["text"]), " ").alias("_text"))


def flagged_groups(lines: DataFrame, benchmark: DataFrame, group: list[str], pos: str, text: str, name: str = "dirty") -> DataFrame:
    """lines with `name`, whether the joined group of the line contains a probe. Lines whose group is null are a group."""
    own = f"_{uuid.uuid4().hex}"
    whole = group_texts(lines, group, pos, text)
    dirty = flagged(whole, probes(benchmark), "_text", "_dirty").where("_dirty").select(*[F.col(g).alias(f"{own}{i}") for i, g in enumerate(group)], F.lit(True).alias(own))
    same = [lines[g].eqNullSafe(dirty[f"{own}{i}"]) for i, g in enumerate(group)]
    return lines.join(dirty, same, "left").withColumn(name, F.coalesce(own, F.lit(False))).drop(own, *[f"{own}{i}" for i in range(len(group))])


def decontaminate_groups(lines: DataFrame, benchmark: DataFrame, group: str | list[str], pos: str, text: str) -> DataFrame:
    """All lines of a group go if the joined group contains a probe. Lines whose group is null are a group."""
    name = f"_{uuid.uuid4().hex}"
    return flagged_groups(lines, benchmark, [group] if isinstance(group, str) else group, pos, text, name).where(~F.col(name)).drop(name)


# exact counts in seeded order

#: Bits of the hash by which cuts are narrowed in one pass, and rows that may be ranked in one task.
BITS, FEW = 10, 100_000


def cuts(df: DataFrame, group: Column, key: str, seed: int, want: Callable[[Column, Column], Column], value: Column | None = None) -> DataFrame:
    """A row for each group: `_g`, `_n` (its rows), `_v` (the largest `value`) and `_cut`, the place(seed, key) of the
    want(_n, _v)-th row in seeded order, null if want is 0 or less; the last row's if want is over _n.

    The rows are written, so that a join with them, however its plan estimates what they come from, goes to the tasks and
    leaves the other side, of few groups, where it is. Nothing is sorted but the rows around the cut: rows are counted by the first BITS bits of their hash, the range that
    holds the cut is counted by its next bits, and so on until FEW rows are left of a group. Passes read the key, group
    and value alone."""
    keyed = df.select(group.alias("_g"), hashed(seed, F.col(key)).alias("_h"), place(seed, key).alias("_p"), (F.lit(None).cast("double") if value is None else value.cast("double")).alias("_v"))

    def narrowed(counted: DataFrame) -> DataFrame:
        w = W.partitionBy("_g").orderBy("_b")
        c = counted.withColumn("_below", F.coalesce(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        c = c.where((F.col("_below") < F.col("_want")) & (F.col("_want") <= F.col("_below") + F.col("_c")))
        return c.select("_g", "_b", (F.col("_want") - F.col("_below")).alias("_want"), "_c")

    def of(bits: int) -> Column:
        return F.shiftright("_h", 60 - bits)

    counted = keyed.groupBy("_g", of(BITS).alias("_b")).agg(F.count("*").alias("_c"), F.max("_v").alias("_v"))  # 2 ** BITS rows a group
    every = W.partitionBy("_g")
    counted = counted.withColumns({"_n": F.sum("_c").over(every), "_v": F.max("_v").over(every)})
    counted = stored(counted.withColumn("_want", F.least(want(F.col("_n"), F.col("_v")), F.col("_n")).cast("long")), "sizes")
    sizes, at, bits = counted.select("_g", "_n", "_v").distinct(), narrowed(counted), BITS
    while bits + BITS <= 60 and (at.agg(F.max("_c")).first()[0] or 0) > FEW:
        inside = keyed.join(at.select(F.col("_g").alias("_k"), F.col("_b").alias("_at"), "_want"), F.col("_g").eqNullSafe(F.col("_k")) & (of(bits) == F.col("_at")))
        bits += BITS
        at = stored(narrowed(inside.groupBy("_g", of(bits).alias("_b"), "_want").agg(F.count("*").alias("_c"))), "cuts")
    near = keyed.join(at.select(F.col("_g").alias("_k"), F.col("_b").alias("_at"), "_want"), F.col("_g").eqNullSafe(F.col("_k")) & (of(bits) == F.col("_at")))
    ranked = near.withColumn("_r", F.row_number().over(W.partitionBy("_g").orderBy("_p"))).where(F.col("_r") == F.col("_want"))
    last = ranked.select(F.col("_g").alias("_k"), F.col("_p").alias("_cut"))
    return stored(sizes.join(last, F.col("_g").eqNullSafe(F.col("_k")), "left").drop("_k"), "cuts")


def place(seed: int, key: str) -> Column:
    """Where a row stands in seeded order."""
    return F.struct(seeded(seed, F.col(key)).alias("h"), F.col(key).alias("k"))


def with_holdout(df: DataFrame, domain: str, key: str, seed: int = 42, rows: int = HOLDOUT) -> DataFrame:
    """`split`: val for the first `rows` of each domain in seeded order, train for the others. Keys are unique. df is
    read several times, by its keys alone but for the last."""
    cut = cuts(df, F.col(domain), key, seed, lambda n, _: F.lit(rows)).select("_g", "_cut")
    joined = df.join(cut, F.col(domain).eqNullSafe(F.col("_g")), "left")
    return joined.withColumn("split", F.when(place(seed, key) <= F.col("_cut"), "val").otherwise("train")).drop("_g", "_cut")


def counts(df: DataFrame) -> DataFrame:
    """Rows by source, by domain and in all, in one pass; an empty table has a total of 0."""
    one = df.select("source", "domain", F.lit(1).cast("long").alias("one"))
    zero = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("domain"), F.lit(0).cast("long").alias("one"))
    out = one.unionByName(zero).groupingSets([[F.col("source")], [F.col("domain")], []], "source", "domain").agg(F.sum("one").alias("n"), F.grouping_id().alias("set"))
    return out.where("n > 0 or set = 3").select("source", "domain", "n")


def totals(df: DataFrame) -> DataFrame:
    """One row: rows of the train and of the val split."""
    return df.agg(F.count_if(F.col("split") == "train").alias("total_train"), F.count_if(F.col("split") == "val").alias("total_val"))


def nth(df: DataFrame, key: str, k: int = 72) -> DataFrame:
    return df.where(F.col(key) % k == 0)


#: In the name of a written file: its task's number, and its own number within the task. An id of the write stands between.
PART, CHUNK = r"^part-(\d+)", r"-c(\d+)\."


def with_counter(df: DataFrame, order: str | list[str], name: str = "i", by: list[str] = (), total: str | None = None) -> DataFrame:
    """1, 2, ... over the table, or over each group of `by`, in the order of some columns; `total`: the rows of the table
    or group. The table is written by ranges of the columns, which Spark samples so that they are of like size (rows that
    tie are dealt out by where they were read), each range sorted; a row's number is its place in its file and the group's
    rows in the files before. A range may have several files (spark.sql.files.maxRecordsPerFile). No task holds more than
    its range, or a row for each file of a group."""
    order = [*by, *([order] if isinstance(order, str) else order)]
    own = f"_{uuid.uuid4().hex}_"  # names that no column has
    file, row, at_, first, n, before, rows = (own + c for c in ("file", "row", "at", "first", "n", "before", "rows"))
    keys = [f"{own}by{k}" for k in range(len(by))]
    plain = stored(df, "rows")  # the ranges are sampled in a pass of its own, which would make the rows a second time
    table = stored(plain.repartitionByRange(*order, F.monotonically_increasing_id() % 61).sortWithinPartitions(*order), "ranges")
    discard(plain)
    number = lambda p: F.regexp_extract("_metadata.file_name", p, 1).cast("long")
    at = table.select("*", F.struct(number(PART), F.coalesce(number(CHUNK), F.lit(0))).alias(file), F.col("_metadata.row_index").alias(row))
    sizes = at.groupBy(F.col(file).alias(at_), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(F.min(row).alias(first), F.count("*").alias(n))
    group = W.partitionBy(*keys)
    ahead = group.orderBy(at_).rowsBetween(W.unboundedPreceding, -1)
    sums = stored(sizes, "files").withColumns({before: F.coalesce(F.sum(n).over(ahead), F.lit(0)) - F.col(first), rows: F.sum(n).over(group)})
    same = F.col(file) == F.col(at_)
    for c, k in zip(by, keys, strict=True):
        same &= F.col(c).eqNullSafe(F.col(k))
    named = [F.col(rows).alias(total)] if total else []
    return at.join(sums, same).select(*df.columns, (F.col(before) + F.col(row) + 1).cast("long").alias(name), *named)


def exact_sample(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """floor(n * share) rows of the whole table, the first in seeded order; in binary doubles, as int(n * share)."""
    cut = cuts(df, F.lit(0), key, seed, lambda n, _: F.floor(n * F.lit(float(share)))).select("_cut")
    return df.join(cut, place(seed, key) <= F.col("_cut"), "left_semi")  # a table of one row


# groups of consecutive rows

LINES, SPAN = (3, 6), 1 << 16


def stack_plan(spark, rows: int, seed: int = 42, sizes: tuple[int, int] = LINES) -> DataFrame:
    """`at` (from 0), `grp`, `pos` and `want` of each of the first `rows` rows: group sizes are drawn anew for each group
    by a seeded hash of its number. Sizes are summed up within spans of SPAN groups and over the spans, so no task sees
    more than a span or a row a span."""
    low, high = sizes
    g = spark.range(-(-rows // low)).select(F.col("id").alias("grp"), (F.pmod(hashed(seed, F.col("id")), F.lit(high - low + 1)) + low).cast("int").alias("want"))
    g = g.withColumn("span", F.floor(F.col("grp") / SPAN))
    inner = g.withColumn("inner", F.coalesce(F.sum("want").over(W.partitionBy("span").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    whole = g.groupBy("span").agg(F.sum("want").alias("all"))
    before = whole.select("span", F.coalesce(F.sum("all").over(W.orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    start = inner.join(before, "span").select("grp", "want", (F.col("before") + F.col("inner")).alias("start")).where(F.col("start") < rows)
    return start.select(F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("want") - 1)).alias("pos", "at"), "grp", "want").where(F.col("at") < rows)


def stacks(df: DataFrame, order: str, text: str, seed: int = 42, sizes: tuple[int, int] = LINES) -> DataFrame:
    """`grp`, `n`, `text` (joined by line ends) and, where df has w and h, `widths` and `heights` of groups of consecutive
    rows; a last group that is not full is left out."""
    numbered = with_counter(df, order, "_i")
    sized = {"w", "h"} <= set(df.columns)
    plan = stack_plan(df.sparkSession, df.count(), seed, sizes)
    rows = numbered.withColumn("at", F.col("_i") - 1).join(plan, "at")
    line = F.struct("pos", F.col(text).alias("text"), *([F.col("w"), F.col("h")] if sized else []))
    g = rows.groupBy("grp", "want").agg(F.array_sort(F.collect_list(line)).alias("lines")).where(F.size("lines") == F.col("want"))  # sizes[1] rows at most
    each = lambda name: F.transform("lines", lambda x: x[name])
    return g.select("grp", F.size("lines").cast("long").alias("n"), F.array_join(each("text"), "\n").alias("text"), *([each("w").alias("widths"), each("h").alias("heights")] if sized else []))
