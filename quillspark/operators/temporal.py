"""Joins by time: the last row before (as-of), and intervals that overlap; sessions of rows with gaps between them.

None of them pairs rows that do not belong together: the as-of join is one ordered pass over both sides, the interval join
an equi-join on bins. Extensions of the corpus engine, over event tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a key that one task may order, before the key is cut by time.
SPAN = 1_000_000


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, tie: str, prefix: str = "right_", span: int = SPAN) -> DataFrame:
    """left with, as `prefix` and its name, each column of the last row of right of the same key that is not later; of
    rows of equal time the one of largest `tie`. Nulls where there is none; null keys and times meet nothing.

    Both sides are laid over each other in one order by key and time, and each left row takes the last right row before
    it. A key is cut into stretches of time, so that its stretches of about `span` rows are ordered in tasks of their own;
    what a stretch does not find in itself comes from the last stretch before it that has a right row, a table of a row a
    stretch."""
    own = f"_{uuid.uuid4().hex}_"
    keys, at, seq, side, row, got, cut = [f"{own}k{i}" for i in range(len(by))], own + "t", own + "q", own + "s", own + "l", own + "r", own + "c"
    names = [c for c in right.columns if c not in by]
    a = left.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], micros(time).alias(at), F.lit(None).cast(right.schema[tie].dataType).alias(seq), F.lit(1).alias(side), F.struct(*left.columns).alias(row), F.lit(None).cast(right.select(F.struct(*names)).schema[0].dataType).alias(got))
    known = right.where(F.col(time).isNotNull())
    b = known.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], micros(time).alias(at), F.col(tie).alias(seq), F.lit(0).alias(side), F.lit(None).cast(a.schema[row].dataType).alias(row), F.struct(*names).alias(got))
    both = a.unionByName(b)
    most = both.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    low, high = both.agg(F.min(at), F.max(at)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // -(-max(1, most) // span)))
    both = both.withColumn(cut, F.floor((F.col(at) - (low or 0)) / width))
    order = W.partitionBy(*keys, cut).orderBy(at, side, seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = both.withColumn(got, F.when(F.col(at).isNotNull(), F.last(got, ignorenulls=True).over(order))).where(F.col(side) == 1)
    if width <= (high or 0) - (low or 0):  # keys are cut
        ends = both.where(F.col(side) == 0).groupBy(*keys, cut).agg(F.max_by(got, F.struct(at, seq)).alias(got))
        starts = met.where(F.col(got).isNull() & F.col(at).isNotNull()).select(*keys, cut).distinct()  # stretches that look back
        stretch = ends.withColumn(side, F.lit(0)).unionByName(starts.withColumns({got: F.lit(None).cast(ends.schema[got].dataType), side: F.lit(1)}))
        back = W.partitionBy(*keys).orderBy(cut, F.desc(side)).rowsBetween(W.unboundedPreceding, -1)
        before = stretch.withColumn(own + "b", F.last(got, ignorenulls=True).over(back)).where(F.col(side) == 1)
        before = before.select(*[F.col(k).alias(k + "b") for k in keys], F.col(cut).alias(cut + "b"), own + "b")
        same = F.col(cut) == F.col(cut + "b")
        for k in keys:
            same &= F.col(k) == F.col(k + "b")
        met = met.join(before, same, "left").withColumn(got, F.coalesce(got, own + "b"))
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    return met.select(f"{row}.*", *[F.when(whole, F.col(got)[c]).alias(prefix + c) for c in names])


def overlaps(a: DataFrame, b: DataFrame, by: list[str], start: str, end: str, prefix: str = "right_") -> DataFrame:
    """Pairs of a row of a and one of b of the same key whose intervals [start, end) of numbers share a point; columns of b
    get `prefix`. Empty intervals and null ends overlap nothing.

    Lengths are classed by powers of two. A pair meets at the class of its longer interval, in bins of that width, of
    which either interval touches two at most: each row of the one side goes to the bins of its own class, of the other to
    those of every class from its own up to the longest there is. Of the bins that both touch the one that holds the later
    start counts, so a pair is found once."""
    own = f"_{uuid.uuid4().hex}_"
    level, cell = own + "level", own + "bin"
    right = b.select(*[F.col(c).alias(prefix + c) for c in b.columns])

    def classed(df: DataFrame, s: str, e: str) -> DataFrame:
        df = df.where(F.col(s) < F.col(e))
        return df.withColumn(own + "own", F.ceil(F.log2((F.col(e) - F.col(s)).cast("double"))).cast("int"))

    one, other = classed(a, start, end), classed(right, prefix + start, prefix + end)

    def binned(df: DataFrame, s: str, e: str, levels: Column) -> DataFrame:
        width = F.pow(F.lit(2.0), F.col(level))
        df = df.withColumn(level, F.explode(levels))
        return df.withColumn(cell, F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1e-9 * width) / width) if dict(df.dtypes)[e] in ("double", "float") else F.floor((F.col(e) - 1) / width))))

    def met(longer: DataFrame, ls: str, le: str, shorter: DataFrame, ss: str, se: str, least: int) -> DataFrame:
        """Pairs whose longer interval is of `longer`; `least`: by how many classes it is longer at least."""
        classes = sorted(r[0] for r in longer.select(own + "own").distinct().collect())  # sixty-odd at most
        known = F.filter(F.array(*[F.lit(c) for c in classes]).cast("array<int>"), lambda c: c >= F.col(own + "own") + least)
        x = binned(longer, ls, le, F.array(own + "own")).drop(own + "own")
        y = binned(shorter, ss, se, known).drop(own + "own").withColumnsRenamed({level: level + "y", cell: cell + "y"})
        same = (F.col(level) == F.col(level + "y")) & (F.col(cell) == F.col(cell + "y"))
        for c in by:
            same &= F.col(c) == F.col(prefix + c)
        shared = (F.col(ls) < F.col(se)) & (F.col(ss) < F.col(le))
        first = F.floor(F.greatest(F.col(ls), F.col(ss)) / F.pow(F.lit(2.0), F.col(level))) == F.col(cell)
        return x.join(y, same).where(shared & first).select(*a.columns, *right.columns)

    s, e = prefix + start, prefix + end
    return met(one, start, end, other, s, e, 0).unionByName(met(other, s, e, one, start, end, 1))


def sessions(rows: DataFrame, by: list[str], time: str, gap_seconds: float) -> DataFrame:
    """first, last and n of each session of a key: rows of which each is less than the gap after the one before."""
    order = W.partitionBy(*by).orderBy("_at")
    at = rows.where(F.col(time).isNotNull()).select(*by, time, micros(time).alias("_at"))
    new = F.coalesce((F.col("_at") - F.lag("_at").over(order) >= int(gap_seconds * 1e6)).cast("int"), F.lit(1))
    numbered = at.withColumn("_new", new).withColumn("_nr", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy(*by, "_nr").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).drop("_nr")
