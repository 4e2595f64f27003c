"""Preference pairs and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .corpus import cuts, place


def sane(chosen: Column, rejected: Column) -> Column:
    a, b = strip(F.coalesce(chosen, F.lit(""))), strip(F.coalesce(rejected, F.lit("")))
    return (a != "") & (b != "") & (a != b)


def preference_pairs(pairs: DataFrame, key: str, limit: int, seed: int = 42) -> DataFrame:
    """Shuffle, take `limit`, and only then drop unfit pairs, so fewer than `limit` may stay. Where pairs have a column
    `image`, its bytes, a pair without them is unfit."""
    cut = cuts(pairs, F.lit(0), key, seed, lambda n, _: F.lit(limit)).select("_cut")
    first = pairs.join(cut, place(seed, key) <= F.col("_cut"), "left_semi")  # a table of one row
    fit = sane(F.col("chosen"), F.col("rejected"))
    return first.where(fit & (F.coalesce(F.length("image"), F.lit(0)) > 0) if "image" in pairs.columns else fit)


def messages(prompt: Column, response: Column) -> Column:
    """User turn with an image and the prompt, assistant turn with the response."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    turn = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))
    return F.array(turn("user", part("image", F.lit(None).cast("string")), part("text", prompt)), turn("assistant", part("text", response)))
