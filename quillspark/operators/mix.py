"""Mixtures: exact-count sampling and oversampling by weight, with the recipes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import cuts, exact_sample, in_order, place  # noqa: F401


@dataclass(frozen=True)
class Recipe:
    seed: int
    domains: dict[str, float]
    sources: dict[str, float] = field(default_factory=dict)  # taken out of their domains first
    tables: float | None = None  # weight of rows with a markdown table, of any domain


#: Fixed values.
RECIPES = {
    "1": Recipe(42, {"line_synth": 0.6, "line_real": 1.0, "doc_markdown": 2.0, "newspaper": 2.0}),
    "2": Recipe(42, {"line_synth": 0.15, "line_real": 0.5, "doc_markdown": 1.5, "newspaper": 0.5, "manuscript": 8.0, "handwritten_line": 3.0, "word_crop": 0.3}),
    "3": Recipe(42, {"doc_markdown": 2.0, "manuscript": 4.0, "handwritten_paragraph": 3.0, "handwritten_line": 1.0, "line_real": 0.3, "newspaper": 0.3, "line_synth": 0.1, "word_crop": 0.2}),
    "3.1": Recipe(42, {"doc_markdown": 2.0, "manuscript": 4.0, "handwritten_line": 3.0, "line_real": 0.3, "newspaper": 0.3, "line_synth": 0.1, "word_crop": 0.2}),
    "4": Recipe(42, {"doc_markdown": 1.0, "handwritten_line": 1.0, "manuscript": 2.0, "line_real": 0.2, "newspaper": 0.2, "line_synth": 0.05, "word_crop": 0.1}),
    "4.1": Recipe(43, {"doc_markdown": 1.0, "handwritten_line": 1.0, "manuscript": 2.0, "line_real": 0.2, "newspaper": 0.2, "line_synth": 0.05, "word_crop": 0.1}),
    "5": Recipe(45, {"doc_markdown": 0.25, "handwritten_para_real": 3.0, "handwritten_line": 1.0, "manuscript": 2.0, "line_real": 0.15, "newspaper": 0.2, "line_synth": 0.05, "word_crop": 0.1}, {"img2md": 1.0}),
    "6": Recipe(48, {"doc_markdown": 0.12, "handwritten_para_real": 0.3, "handwritten_line": 0.2, "manuscript": 0.6, "line_real": 0.05, "newspaper": 0.08, "line_synth": 0.02, "word_crop": 0.03}, {}, 2.0),
    "6.1": Recipe(49, {"doc_markdown": 0.20, "handwritten_para_real": 0.3, "handwritten_line": 0.2, "manuscript": 0.6, "line_real": 0.05, "newspaper": 0.08, "line_synth": 0.02, "word_crop": 0.03}, {}, 0.45),
}


def weighted(df: DataFrame, weight: Column, group: str, key: str, seed: int) -> DataFrame:
    """Every row floor(w) times, and floor(n * (w - floor(w))) rows of each group once more, the first in seeded order.
    A weight of 1 passes through; rows with a null or non-positive weight go; a group has one weight. `copy` numbers a
    row's copies. Under one the sampled count is floor(n * w) in binary doubles, as int(n * w) would have it. Rows are
    neither sorted nor moved but to meet the cut of their group; df is read several times, by its keys alone but for the
    last."""
    df = df.withColumn("_w", weight).where("_w > 0")
    cut = cuts(df, F.col(group), key, seed, lambda n, w: F.floor(n * (w - F.floor(w))), F.col("_w")).select("_g", "_cut")
    df = df.join(cut, F.col(group).eqNullSafe(F.col("_g")), "left")
    more = F.when(place(seed, key) <= F.col("_cut"), 1).otherwise(0)
    df = df.withColumn("_k", (F.floor("_w") + more).cast("int")).where("_k > 0")
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_w", "_g", "_cut", "_k")


def lookup(weights: dict[str, float], c: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in weights.items():
        out = F.when(c == k, F.lit(float(v))).otherwise(out)
    return out


def mix(df: DataFrame, recipe: Recipe, key: str, is_table: Column | None = None) -> DataFrame:
    """The recipe's mixture of rows with `domain` and `source`."""
    group = F.concat(F.lit("d:"), F.col("domain"))
    weight = lookup(recipe.domains, F.col("domain"))
    if recipe.sources:
        own = F.col("source").isin(list(recipe.sources))
        group = F.when(own, F.concat(F.lit("s:"), F.col("source"))).otherwise(group)
        weight = F.when(own, lookup(recipe.sources, F.col("source"))).otherwise(weight)
    if recipe.tables is not None and is_table is not None:
        group, weight = F.when(is_table, "t").otherwise(group), F.when(is_table, float(recipe.tables)).otherwise(weight)
    return weighted(df.withColumn("part", group), weight, "part", key, recipe.seed)


def smoke(df: DataFrame, key: str, seed: int = 42, rows: int = 2000) -> DataFrame:
    """The first `rows` rows in seeded order, or all where there are fewer."""
    cut = cuts(df, F.lit(0), key, seed, lambda n, _: F.lit(rows)).select("_cut")
    return df.join(cut, place(seed, key) <= F.col("_cut"), "left_semi")  # a table of one row


def save(mixed: DataFrame, path: str, recipe: Recipe, key: str) -> None:
    """Write a mixture in the recipe's seeded order of row and copy, so that a reader meets its sources interleaved."""
    name = "_row"
    rows = mixed.withColumn(name, F.concat_ws(":", F.col(key).cast("string"), F.col("copy").cast("string")))
    in_order(rows, recipe.seed, name).drop(name).write.mode("overwrite").parquet(path)
