"""Exact algebra on low-rank adapters held as coordinates.

Factors: (adapter, module, factor 'A' or 'B', i, j, v): A is r x in, B is out x r. Tensors that are not factors have
another name there. Config, a row an adapter: (adapter, r, alpha, coeff), and where they are known target_modules,
use_rslora and base. Configs are small: a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUM_TOLERANCE = 1e-6
MATCHING = ["target_modules", "use_rslora", "base"]


def used(config: DataFrame) -> DataFrame:
    return config.where(F.abs("coeff") > SUM_TOLERANCE)


def guards(factors: DataFrame, config: DataFrame) -> DataFrame:
    """One row: adapters in use, whether the coefficients miss 1, whether scales (alpha / r) differ, whether what has to
    match in the configs does not, modules without both factors, modules not in every adapter, tensors that are not
    factors. A sound soup has false and zero in all but the first."""
    some = used(config)
    differ = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))) > 1 for c in MATCHING if c in config.columns]
    mismatch = differ[0] if differ else F.lit(False)
    for d in differ[1:]:
        mismatch = mismatch | d
    bad_sum = F.coalesce(F.abs(F.sum("coeff") - 1) > SUM_TOLERANCE, F.lit(True))
    n = config.agg(bad_sum.alias("bad_sum"))  # of all coefficients, before those near 0 are left out
    n = n.crossJoin(some.agg(F.count("*").alias("adapters"), (F.count_distinct(F.col("alpha") / F.col("r")) > 1).alias("bad_scale"), mismatch.alias("mismatch")))  # rows: one
    own = factors.join(some.select("adapter"), "adapter", "left_semi")
    per = own.where("factor in ('A', 'B')").groupBy("adapter", "module").agg(F.count_distinct("factor").alias("factors"))
    mods = per.groupBy("module").agg(F.count("*").alias("seen"), F.count_if(F.col("factors") < 2).alias("single"))
    odd = own.where("factor not in ('A', 'B')").select("adapter", "module", "factor").distinct().agg(F.count("*").alias("not_factors"))
    m = mods.crossJoin(n.select("adapters")).agg(F.coalesce(F.sum("single"), F.lit(0)).alias("incomplete"), F.count_if(F.col("seen") != F.col("adapters")).alias("unshared"))
    return n.crossJoin(m).crossJoin(odd)


def checked(factors: DataFrame, config: DataFrame) -> None:
    """An error where `guards` finds fault; incomplete modules are no fault, the merge leaves them out."""
    g = guards(factors, config).first().asDict()
    faults = {k: v for k, v in g.items() if v and k not in ("adapters", "incomplete")}
    if faults or not g["adapters"]:
        raise ValueError(f"adapters cannot be combined: {faults or 'all coefficients are zero'}")


def soup(factors: DataFrame, config: DataFrame, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Factors of the combined adapter, whose product is the sum of coeff * B @ A exactly, and its config row. Ranks are
    laid side by side in the order of the adapters' names; alpha keeps alpha / r of the first, in whole numbers."""
    if check:
        checked(factors, config)
    some = used(config)
    offset = F.coalesce(F.sum("r").over(W.orderBy("adapter").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = some.withColumn("off", offset)  # a row an adapter
    f = factors.join(F.broadcast(placed.select("adapter", "off", "coeff")), "adapter")  # a row an adapter
    a = f.where("factor = 'A'").select("module", "factor", (F.col("i") + F.col("off")).alias("i"), "j", "v")
    b = f.where("factor = 'B'").select("module", "factor", "i", (F.col("j") + F.col("off")).alias("j"), (F.col("v") * F.col("coeff")).alias("v"))
    first = F.min_by(F.struct("alpha", "r"), "adapter")
    merged = some.agg(F.sum("r").alias("r"), F.floor(first["alpha"] * F.sum("r") / first["r"]).cast("long").alias("alpha"))
    return a.unionByName(b), merged


def complete(factors: DataFrame) -> DataFrame:
    """The factors of modules that have both."""
    both = factors.groupBy("module").agg(F.count_distinct("factor").alias("n")).where("n = 2")
    return factors.join(both, "module", "left_semi")


def product(factors: DataFrame) -> DataFrame:
    """(module, i, j, v) of B @ A: a hash join on module and rank index, then a sum. Modules without both give nothing."""
    a = factors.where("factor = 'A'").select("module", F.col("i").alias("k"), "j", F.col("v").alias("a"))
    b = factors.where("factor = 'B'").select("module", "i", F.col("j").alias("k"), F.col("v").alias("b"))
    return b.join(a, ["module", "k"]).groupBy("module", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def shapes(cells: DataFrame, by: str = "module") -> DataFrame:
    """rows and cols of each module's matrix (all cells are present)."""
    return cells.groupBy(by).agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"))


def delta_shapes(factors: DataFrame) -> DataFrame:
    """rows and cols of each module's B @ A, from its factors alone."""
    a = factors.where("factor = 'A'").groupBy("module").agg((F.max("j") + 1).alias("cols"))
    b = factors.where("factor = 'B'").groupBy("module").agg((F.max("i") + 1).alias("rows"))
    return b.join(a, "module").select("module", "rows", "cols")


def mismatched(base: DataFrame, factors: DataFrame) -> DataFrame:
    """Modules whose B @ A has another shape than the base's matrix, with both shapes."""
    d = delta_shapes(factors).select("module", F.col("rows").alias("delta_rows"), F.col("cols").alias("delta_cols"))
    return shapes(base).join(d, "module").where("rows <> delta_rows or cols <> delta_cols")


def merge(base: DataFrame, factors: DataFrame, scale: float) -> DataFrame:
    """base (module, i, j, v) plus scale * B @ A, as floats, with `changed` for cells that moved. Modules of another
    shape stay as they are."""
    d = product(factors.join(mismatched(base, factors), "module", "left_anti")).withColumnRenamed("v", "d")
    new = (F.col("v") + F.lit(scale) * F.coalesce("d", F.lit(0.0))).cast("float").cast("double")
    return base.join(d, ["module", "i", "j"], "left").select("module", "i", "j", new.alias("v"), (new != F.col("v")).alias("changed"))


def missing(base: DataFrame, factors: DataFrame) -> DataFrame:
    """Modules of the adapter that the base does not have."""
    return factors.select("module").distinct().join(base.select("module").distinct(), "module", "left_anti")


def merge_report(base: DataFrame, factors: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: modules applied, missing from the base and of another shape, and the largest absolute change."""
    whole = complete(factors)
    bad = mismatched(base, whole).agg(F.count("*").alias("mismatched"))
    lost = missing(base, whole).agg(F.count("*").alias("missing"))
    every = whole.select("module").distinct().agg(F.count("*").alias("targets"))
    old = base.withColumnRenamed("v", "old")
    moved = merged.join(old, ["module", "i", "j"]).agg(F.coalesce(F.max(F.abs(F.col("v") - F.col("old"))), F.lit(0.0)).alias("max_change"))
    row = every.crossJoin(bad).crossJoin(lost).crossJoin(moved)  # rows: one
    return row.withColumn("applied", F.col("targets") - F.col("mismatched") - F.col("missing"))


def verified(base: DataFrame, factors: DataFrame, merged: DataFrame) -> dict:
    """The report; an error where nothing was applied or nothing changed."""
    row = merge_report(base, factors, merged).first().asDict()
    if not row["applied"] or not row["max_change"]:
        raise ValueError(f"the adapter was not applied: {row}")
    return row
