"""Edit distance of strings: the built-in function for small tables, and for long texts a band that grows until the
distance fits, then whole rows as the bits of one number. Exact at every length.

The built-in function fills the whole table, one cell a step: two texts of 100,000 characters take 10**10 of them. A band
of half width k takes their length times k, vectorized; bits take 1/64 of the table's cells, one machine word a step.

Cases: null in, null out; the distance from an empty text is the other's length. Characters are code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T_

#: Cells of a table that the built-in function fills; the first half width of a band.
CELLS, FIRST = 4_000_000, 16


def edit_distance(a: str, b: str) -> int:
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in sorted((a, b), key=len))
    same = np.flatnonzero(x != y[: len(x)])
    start = int(same[0]) if len(same) else len(x)
    x, y = x[start:], y[start:]
    tail = np.flatnonzero(x[::-1] != y[::-1][: len(x)])
    end = int(tail[0]) if len(tail) else len(x)
    x, y = x[: len(x) - end], y[: len(y) - end]
    if not len(x):
        return len(y)
    k = max(FIRST, len(y) - len(x))
    while 2 * k < len(x) // 8:
        found = within(x, y, k)
        if found is not None:
            return found
        k *= 2
    return by_bits(x, y)


def within(x: np.ndarray, y: np.ndarray, k: int) -> int | None:
    """The distance if it is k at most; the lengths differ by k at most. Row by row of the table, the 2 * k + 1 cells around
    the diagonal: what comes from above and from the diagonal, then insertions as a running minimum."""
    width, far = 2 * k + 1, 2 * (len(x) + len(y))
    at = np.arange(width)
    y = np.concatenate((np.full(k + 1, 1 << 31, np.uint32), y, np.full(2 * k + 1, 1 << 31, np.uint32)))
    row = np.where(at >= k, at - k, far)
    for i, c in enumerate(x, 1):
        step = row + (y[i : i + width] != c)
        np.minimum(step[:-1], row[1:] + 1, out=step[:-1])
        if i <= k:
            step[: k - i] = far
            step[k - i] = i
        row = at + np.minimum.accumulate(step - at)
        if row.min() > k:
            return None
    last = k + (len(y) - 3 * k - 2) - len(x)
    return int(row[last]) if row[last] <= k else None


def by_bits(x: np.ndarray, y: np.ndarray) -> int:
    """Columns of the table as differences of one up or down, a bit each: of x against each character of y."""
    x, y = (y, x) if len(x) < len(y) else (x, y)
    m = len(x)
    equal = {int(c): int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(y)}
    whole, top = (1 << m) - 1, m - 1
    up, down, out = whole, 0, m
    for c in y.tolist():
        eq = equal[c]
        carried = (((eq & up) + up) ^ up) | eq
        right_up, right_down = down | (whole & ~(carried | up)), up & carried
        out += (right_up >> top & 1) - (right_down >> top & 1)
        right_up, right_down, eq = right_up << 1 | 1, right_down << 1, eq | down
        up, down = (right_down | ~(eq | right_up)) & whole, right_up & eq & whole
    return out


@F.arrow_udf(T_.IntegerType())
def _long(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([edit_distance(x, y) if x is not None and y is not None else None for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def distance(a: Column, b: Column) -> Column:
    """As levenshtein. Only texts whose table is large leave the JVM."""
    long = F.length(a).cast("long") * F.length(b) > CELLS
    return F.when(long, _long(F.when(long, a), F.when(long, b))).otherwise(F.levenshtein(F.when(~long, a), b))
