"""Scores: character and word error rates over a corpus, table similarity, triage, sweeps, summaries, gates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.edits import distance
from .tables import table_similarity

#: Looper over 2, good from 0.8 to 1.2; canary limits; decimal places of rates and of table similarity.
LOOPER, GOOD = 2.0, (0.8, 1.2)
CANARY_ABSOLUTE, CANARY_TIMES = 0.20, 4.0
RATE_PLACES, TEDS_PLACES = 4, 2
#: The long-output pages, and the development slices in order, the canary first: label, suite, and how many first
#: rows or which.
LOOP_PAGES = [32, 35, 47, 63, 79, 81, 108, 138, 158, 179, 198, 210, 216, 221, 238, 273, 315, 318, 328, 346, 365, 382, 385, 398]
SLICES: list[tuple[str, str, int | list[int]]] = [
    ("arocrbench_arabicocr", "arocrbench_arabicocr", 20),
    ("arocrbench_hindawi", "arocrbench_hindawi", 30),
    ("misraj_dococr[norm]", "misraj_dococr", 30),
    ("misraj_dococr[loop]", "misraj_dococr", LOOP_PAGES),
]


def char_edits(ref: Column, hyp: Column) -> Column:
    return distance(ref, hyp).cast("long")


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def word_edits(pairs: DataFrame, by: list[str], ref: str, hyp: str) -> DataFrame:
    """word_edits and words (of the references) of each group, over pairs of normalized texts with a reference. The words
    of a pair are ranked, the ranks become code points from U+10000 on, and the strings of these are compared: equal pairs
    once. A pair may have a million distinct words; the comparison is quadratic in the words, so one that had more would
    not end anyway, and fails."""
    own = [f"_by{i}" for i in range(len(by))]
    each = pairs.groupBy(*[F.col(c).alias(o) for c, o in zip(by, own, strict=True)], F.col(ref).alias("_r"), F.col(hyp).alias("_h")).agg(F.count("*").alias("_times"))
    each = each.select(*own, "_times", F.concat(F.md5("_r"), F.md5("_h")).alias("_id"), F.size(words(F.col("_r"))).alias("_n"), F.posexplode(F.concat(words(F.col("_r")), words(F.col("_h")))).alias("_pos", "_word"))
    key = [*own, "_id"]
    rank = F.dense_rank().over(W.partitionBy(*key).orderBy("_word"))
    char = F.decode(F.unhex(F.lpad(F.hex(F.lit(0xFFFF) + rank), 8, "0")), "UTF-32")
    said = each.withColumn("_c", char).groupBy(*key, "_n", "_times").agg(F.array_sort(F.collect_list(F.struct("_pos", "_c"))).alias("_all"))  # one pair's words
    said = said.withColumn("_all", F.array_join(F.transform("_all", lambda x: x["_c"]), ""))
    said = said.select("*", F.left("_all", F.col("_n")).alias("_a"), F.substring(F.col("_all"), F.col("_n") + 1, F.length("_all")).alias("_b"))
    edits = distance(F.col("_a"), F.col("_b")).cast("long")
    said = said.withColumn("_e", edits)
    return said.groupBy(*own).agg(F.sum(F.col("_e") * F.col("_times")).alias("word_edits"), F.sum(F.col("_n") * F.col("_times")).alias("words")).withColumnsRenamed(dict(zip(own, by, strict=True)))


def corpus_rates(pairs: DataFrame, by: list[str], ref: str = "ref", hyp: str = "hyp", word_rate: bool = True) -> DataFrame:
    """cer, wer and n of each group: total edits over total reference length; rows without a reference are left out,
    a missing hypothesis is empty."""
    p = pairs.select(*by, ref, F.coalesce(F.col(hyp), F.lit("")).alias(hyp)).where(F.col(ref) != "")
    out = p.groupBy(*by).agg(F.sum(char_edits(F.col(ref), F.col(hyp))).alias("char_edits"), F.sum(F.length(ref)).alias("chars"), F.count("*").alias("n")).withColumn("cer", F.col("char_edits") / F.col("chars"))
    if not word_rate:
        return out
    w = word_edits(p, by, ref, hyp).withColumnsRenamed({c: f"_w{i}" for i, c in enumerate(by)})
    same = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(by)]
    return out.join(w, same).drop(*[f"_w{i}" for i in range(len(by))]).withColumn("wer", F.col("word_edits") / F.col("words"))


def table_rates(pairs: DataFrame, by: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """teds (times 100) and teds_n of each group, over the pages where either side has a table; raw texts."""
    each = pairs.select(*by, table_similarity(F.coalesce(F.col(hyp), F.lit("")), F.coalesce(F.col(ref), F.lit(""))).alias("_s"))
    return each.groupBy(*by).agg((100 * F.avg("_s")).alias("teds"), F.count("_s").alias("teds_n")).where("teds_n > 0")


def summary(normalized: DataFrame, raw: DataFrame, by: list[str]) -> DataFrame:
    """cer, wer, n, teds, teds_n of each group, rounded; the rates from normalized texts, teds from raw ones, null where
    no page has a table."""
    rates = corpus_rates(normalized, by).select(*by, F.round("cer", RATE_PLACES).alias("cer"), F.round("wer", RATE_PLACES).alias("wer"), "n")
    return rates.join(table_rates(raw, by).withColumn("teds", F.round("teds", TEDS_PLACES)), by, "left")


def bucket(ratio: Column) -> Column:
    return F.when(ratio > LOOPER, "looper").when(ratio.between(*GOOD), "good")


def triage(pairs: DataFrame, ratio: Column, order: str, most: int = 6) -> DataFrame:
    """The first `most` loopers and good pages."""
    b = pairs.withColumn("bucket", bucket(ratio)).where("bucket is not null")
    return b.withColumn("rn", F.row_number().over(W.partitionBy("bucket").orderBy(order))).where(F.col("rn") <= most)


def sweep(pairs: DataFrame, by: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """mean_cer, mean_ratio and n of each group: means of the rows' own rates, on texts as they are. A row without a
    reference has no rate, so its group's mean is NaN."""
    size = F.greatest(F.length(ref), F.lit(1))
    cer = F.when(F.length(ref) == 0, F.lit(float("nan"))).otherwise(char_edits(F.col(ref), F.col(hyp)) / size)
    return pairs.groupBy(*by).agg(F.avg(cer).alias("mean_cer"), F.avg(F.length(hyp) / size).alias("mean_ratio"), F.count("*").alias("n"))


def first_rows(rows: DataFrame, by: str, order: str, most: int, name: str = "i") -> DataFrame:
    """The first rows of each group, numbered from 0; tasks pass on `most` of a group each."""
    rn = F.row_number().over(W.partitionBy(by).orderBy(order))
    return rows.withColumn(name, rn).where(F.col(name) <= most).withColumn(name, F.col(name) - 1)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new, key, "left_anti").unionByName(new)


def ratio_to(value: Column, base: Column) -> Column:
    return F.when(base == 0, F.lit(float("inf"))).otherwise(value / base)


def canary_limit(base: Column) -> Column:
    return F.coalesce(CANARY_TIMES * base, F.lit(CANARY_ABSOLUTE))


def canary(value: Column, base: Column) -> Column:
    """True where the candidate is to be aborted."""
    return value > canary_limit(base)


def canary_reason(value: Column, base: Column) -> Column:
    """Why the candidate is to be aborted; null where it is not."""
    said = lambda c: F.format_string("%.4f", c)
    return F.when(canary(value, base), F.concat(F.lit("canary CER "), said(value), F.lit(" > "), said(canary_limit(base))))


def dev_run(adapter: str, slices: Iterable[tuple[str, DataFrame]], base: dict[str, float] | None = None) -> dict:
    """The record of a development run over slices of normalized (ref, hyp), cheapest first; the first one is the canary.
    A slice is only evaluated once those before it have passed. base: cer of an earlier run by label."""
    out: dict = {"adapter": adapter, "suites": {}, "aborted": False}
    for k, (label, pairs) in enumerate(slices):
        row = corpus_rates(pairs.withColumn("_all", F.lit(0)), ["_all"]).first()
        if row is None:  # no row has a reference
            out["suites"][label] = {"cer": None, "wer": None, "n": 0}
            continue
        out["suites"][label] = {"cer": round(row["cer"], RATE_PLACES), "wer": round(row["wer"], RATE_PLACES), "n": row["n"]}
        was = (base or {}).get(label)
        if was is not None:
            out["suites"][label]["ratio"] = row["cer"] / was if was else float("inf")
        limit = CANARY_ABSOLUTE if was is None else CANARY_TIMES * was
        if k == 0 and row["cer"] > limit:
            out |= {"aborted": True, "abort_reason": f"canary CER {row['cer']:.4f} > {limit:.4f}"}
            break
    return out


def leaderboard(run: DataFrame, base: DataFrame, key: str = "suite") -> DataFrame:
    b = base.select(key, F.col("cer").alias("base_cer"))
    return run.join(b, key, "left").withColumn("regressed", F.coalesce(F.col("cer") > F.col("base_cer"), F.lit(False)))
