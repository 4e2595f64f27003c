"""Matrices as tiles: a row holds a dense block of a matrix, so a product or a merge shuffles blocks instead of cells.

A tile is (module, bi, bj, rows, cols, dtype, data): block row and column in units of the tile size, the block's own
extent, the numbers' type (F64, F32, F16, BF16) and their bytes, row by row, little-endian. Sums are in double precision;
a merged tile is rounded once, to the type of its base. A tile of SIZE x SIZE doubles is half a megabyte.

Cases: an empty table gives an empty table; a module with one factor alone gives no product; null bytes are no tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .linalg import checked, used

SIZE = 256
TILE = ["module", "bi", "bj", "rows", "cols", "dtype", "data"]
_PLAIN = {"F64": "<f8", "F32": "<f4", "F16": "<f2"}


def numbers(data: bytes, dtype: str) -> np.ndarray:
    """Doubles of a tile's bytes; bfloat16 is the upper half of a float."""
    if dtype == "BF16":
        return (np.frombuffer(data, "<u2").astype("<u4") << 16).view("<f4").astype(float)
    return np.frombuffer(data, _PLAIN[dtype]).astype(float)


def packed(values: np.ndarray, dtype: str) -> bytes:
    """Bytes of a type, rounded to the nearest, ties to even."""
    with np.errstate(over="ignore"):
        if dtype != "BF16":
            return values.astype(_PLAIN[dtype]).tobytes()
        bits = values.astype("<f4").view("<u4")
        up = ((bits >> 16) + ((bits & 0xFFFF) + ((bits >> 16) & 1) > 0x8000)).astype("<u2")
        return np.where(np.isnan(values), (bits >> 16) | 0x40, up).astype("<u2").tobytes()


@F.arrow_udf(T_.BinaryType())
def _dense(places: pa.Array, values: pa.Array, dtypes: pa.Array) -> pa.Array:
    out = []
    for at, v, dtype in zip(places, values, dtypes, strict=True):
        tile = np.zeros(len(at.values))
        tile[at.values.to_numpy()] = v.values.to_numpy()
        out.append(packed(tile, dtype.as_py()))
    return pa.array(out, pa.binary())


@F.arrow_udf(T_.ArrayType(T_.DoubleType()))
def _values(data: pa.Array, dtypes: pa.Array) -> pa.Array:
    found = [numbers(d.as_py(), t.as_py()) for d, t in zip(data, dtypes, strict=True)]
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*found, np.zeros(0)]))


@F.arrow_udf(T_.BinaryType())
def _times(b: pa.Array, a: pa.Array, b_type: pa.Array, a_type: pa.Array, inner: pa.Array, coeff: pa.Array) -> pa.Array:
    """coeff * b @ a as doubles; `inner` is the extent that they share."""
    out = []
    for x, y, s, t, k, c in zip(b, a, b_type, a_type, inner, coeff, strict=True):
        x, y, k = numbers(x.as_py(), s.as_py()), numbers(y.as_py(), t.as_py()), k.as_py()
        out.append((c.as_py() * (x.reshape(-1, k) @ y.reshape(k, -1))).tobytes())
    return pa.array(out, pa.binary())


@F.arrow_udf(T_.BinaryType())
def _sum(parts: pa.Array) -> pa.Array:
    return pa.array([sum(np.frombuffer(p.as_py(), "<f8") for p in each.values).tobytes() for each in parts], pa.binary())


@F.arrow_udf(T_.StructType().add("data", "binary").add("changed", "long").add("max_change", "double"))
def _moved(base: pa.Array, delta: pa.Array, dtypes: pa.Array, scale: pa.Array) -> pa.Array:
    """base + scale * delta in the base's type, how many numbers differ, and by how much at most."""
    data, changed, most = [], [], []
    for old, d, dtype, s in zip(base, delta, dtypes, scale, strict=True):
        before, dtype = numbers(old.as_py(), dtype.as_py()), dtype.as_py()
        made = old.as_py() if not d.is_valid else packed(before + s.as_py() * np.frombuffer(d.as_py(), "<f8"), dtype)
        step = np.abs(numbers(made, dtype) - before)
        data.append(made)
        changed.append(int((step > 0).sum()))
        most.append(float(step.max(initial=0.0)))
    return pa.StructArray.from_arrays([pa.array(data, pa.binary()), pa.array(changed, pa.int64()), pa.array(most, pa.float64())], ["data", "changed", "max_change"])


def tiled(cells: DataFrame, by: list[str] = ("module",), size: int = SIZE, dtype: str | Column = "F64") -> DataFrame:
    """Tiles of cells (by, i, j, v); every cell of a matrix is there."""
    kind = F.lit(dtype) if isinstance(dtype, str) else dtype
    block = lambda c: F.floor(F.col(c) / size)
    cell = F.struct(F.col("i") - F.col("bi") * size, F.col("j") - F.col("bj") * size, "v").cast("struct<i:int,j:int,v:double>")
    g = cells.withColumns({"bi": block("i"), "bj": block("j")}).groupBy(*by, "bi", "bj").agg(F.collect_list(cell).alias("_c"), F.max(kind).alias("dtype"))  # size ** 2 at most
    g = g.withColumns({"rows": F.array_max(F.transform("_c", lambda x: x["i"])) + 1, "cols": F.array_max(F.transform("_c", lambda x: x["j"])) + 1})
    places = F.transform("_c", lambda x: x["i"] * F.col("cols") + x["j"])
    return g.select(*by, "bi", "bj", "rows", "cols", "dtype", _dense(places, F.transform("_c", lambda x: x["v"]), F.col("dtype")).alias("data"))


def cells(tiles: DataFrame, by: list[str] = ("module",), size: int = SIZE) -> DataFrame:
    """The cells (by, i, j, v) of tiles."""
    each = tiles.select(*by, "bi", "bj", "cols", F.posexplode(_values("data", "dtype")).alias("_k", "v"))
    return each.select(*by, (F.col("bi") * size + F.floor(F.col("_k") / F.col("cols"))).alias("i"), (F.col("bj") * size + F.col("_k") % F.col("cols")).alias("j"), "v")


def shapes(tiles: DataFrame, by: str = "module", size: int = SIZE) -> DataFrame:
    """height and width of each module's matrix."""
    return tiles.groupBy(by).agg(F.max(F.col("bi") * size + F.col("rows")).alias("height"), F.max(F.col("bj") * size + F.col("cols")).alias("width"))


def soup(factors: DataFrame, config: DataFrame, check: bool = True) -> DataFrame:
    """The factors in use, with the coefficient of their adapter and `part`, the adapter's place: the blocks of rank of
    the combined adapter are those of its parts, side by side, so no tile is cut anew. factors: tiles with adapter and
    factor ('A', r x in, or 'B', out x r); config: a row an adapter."""
    if check:
        checked(factors.select("adapter", "module", "factor"), config)
    some = used(config).withColumn("part", F.row_number().over(W.orderBy("adapter")))  # a row an adapter
    return factors.join(F.broadcast(some.select("adapter", "part", F.col("coeff").cast("double"))), "adapter")


def product(factors: DataFrame) -> DataFrame:
    """Tiles of the sum over parts of coeff * B @ A: blocks of B and A meet by module, part and block of rank; what they
    give is summed by block. Only modules with both factors give any."""
    names = ["module", "part", "k"]
    a = factors.where("factor = 'A'").select("module", "part", F.col("bi").alias("k"), "bj", "cols", F.col("dtype").alias("a_type"), F.col("data").alias("a"))
    b = factors.where("factor = 'B'").select("module", "part", F.col("bj").alias("k"), "bi", "rows", F.col("cols").alias("inner"), F.col("dtype").alias("b_type"), F.col("data").alias("b"), "coeff")
    met = b.join(a, names).select("module", "bi", "bj", "rows", "cols", _times("b", "a", "b_type", "a_type", "inner", "coeff").alias("data"))
    summed = met.groupBy("module", "bi", "bj", "rows", "cols").agg(F.collect_list("data").alias("_parts"))  # a tile for each block of rank
    return summed.select("module", "bi", "bj", "rows", "cols", F.lit("F64").alias("dtype"), _sum("_parts").alias("data"))


def merge(base: DataFrame, factors: DataFrame, scale: float, size: int = SIZE) -> DataFrame:
    """base's tiles plus scale times the product, in the base's own types, with `changed` (numbers that moved) and
    `max_change`. Modules of another shape stay as they are, and so do those that the factors do not name."""
    d = product(factors)
    fits = shapes(base, size=size).join(delta_shapes(factors, size), ["module", "height", "width"]).select("module")
    d = d.join(fits, "module", "left_semi").select("module", "bi", "bj", F.col("data").alias("_delta"))
    both = base.join(d, ["module", "bi", "bj"], "left")
    rest = [c for c in base.columns if c != "data"]
    return both.select(*rest, _moved("data", "_delta", "dtype", F.lit(float(scale))).alias("_m")).select(*rest, "_m.*")


def delta_shapes(factors: DataFrame, size: int = SIZE) -> DataFrame:
    a = factors.where("factor = 'A'").groupBy("module").agg(F.max(F.col("bj") * size + F.col("cols")).alias("width"))
    b = factors.where("factor = 'B'").groupBy("module").agg(F.max(F.col("bi") * size + F.col("rows")).alias("height"))
    return b.join(a, "module").select("module", "height", "width")


def merge_report(merged: DataFrame, factors: DataFrame, size: int = SIZE) -> DataFrame:
    """One row: modules with both factors, those of another shape than in the model, those that it lacks, the largest
    change, those applied. It reads a row a tile of the merged model, without the numbers."""
    d = delta_shapes(factors, size)
    own = shapes(merged, size=size).withColumnsRenamed({"height": "h", "width": "w"})
    each = d.join(own, "module", "left").agg(F.count("*").alias("targets"), F.count_if((F.col("h") != F.col("height")) | (F.col("w") != F.col("width"))).alias("mismatched"), F.count_if(F.col("h").isNull()).alias("missing"))
    moved = merged.agg(F.coalesce(F.max("max_change"), F.lit(0.0)).alias("max_change"))
    return each.crossJoin(moved).withColumn("applied", F.col("targets") - F.col("mismatched") - F.col("missing"))  # rows: one
