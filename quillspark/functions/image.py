"""Image arithmetic: sizes from headers and under a pixel budget, boxes of polygons, sizes of vertical stacks. No pixels
are touched."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T_

#: Pixel budgets, and the least side that a resize leaves.
BUDGET, HIGH_BUDGET, PAIR_BUDGET, LEAST_SIDE = 640 * 28 * 28, 1280 * 28 * 28, 448 * 28 * 28, 28
HIGH_DOMAINS = ["doc_markdown", "manuscript", "handwritten_para_real"]
STACK_PAD = 10


def budget(domain: Column) -> Column:
    return F.when(domain.isin(HIGH_DOMAINS), HIGH_BUDGET).otherwise(BUDGET)


def fit(w: Column, h: Column, pixels: Column) -> Column:
    """struct(w, h) scaled down to the budget."""
    area = w.cast("long") * h.cast("long")
    s = F.sqrt(pixels.cast("double") / area.cast("double"))
    side = lambda x: F.when(area > pixels, F.greatest(F.lit(LEAST_SIDE), (x * s).cast("int"))).otherwise(x.cast("int"))
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def box(points: Column, w: Column, h: Column) -> Column:
    """struct(x0, y0, x1, y1) around [[x, y], ...], clamped to the image."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    zero = F.lit(0.0)
    return F.struct(F.greatest(zero, F.array_min(xs)).alias("x0"), F.greatest(zero, F.array_min(ys)).alias("y0"), F.least(w, F.array_max(xs)).alias("x1"), F.least(h, F.array_max(ys)).alias("y1"))


def stack(widths: Column, heights: Column) -> Column:
    """struct(w, h) of images resized to the largest width and stacked with padding. Arrays of equal length."""
    widest = F.array_max(widths)
    scaled = F.zip_with(widths, heights, lambda w, h: F.greatest(F.lit(1).cast("long"), F.floor(h * widest / w).cast("long")))
    total = F.aggregate(scaled, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.struct((widest + 2 * STACK_PAD).cast("long").alias("w"), (total + STACK_PAD * (F.size(widths) + 1)).alias("h"))


def header_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, JPEG, GIF or BMP; None for anything else."""
    d = data or b""
    if d[:8] == b"\x89PNG\r\n\x1a\n" and len(d) >= 24:
        return struct.unpack(">II", d[16:24])
    if d[:6] in (b"GIF87a", b"GIF89a") and len(d) >= 10:
        return struct.unpack("<HH", d[6:10])
    if d[:2] == b"BM" and len(d) >= 26:
        w, h = struct.unpack("<ii", d[18:26])
        return w, abs(h)
    at = 2
    while d[:2] == b"\xff\xd8" and at + 9 <= len(d) and d[at] == 0xFF:
        mark = d[at + 1]
        if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD7:  # padding, or a mark without a body
            at += 1 if mark == 0xFF else 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", d[at + 5 : at + 9])
            return w, h
        else:
            at += 2 + struct.unpack(">H", d[at + 2 : at + 4])[0]
    return None


#: Bytes at the beginning that hold the size of every kind but JPEG, whose size stands behind marks of any length.
HEADER = 26


@F.arrow_udf(T_.StructType().add("w", "integer").add("h", "integer"))
def _size(data: pa.Array) -> pa.Array:
    found = [header_size(memoryview(b).tobytes() if (b := x.as_buffer()) is not None else None) or (None, None) for x in data]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.int32()) for k in (0, 1)], ["w", "h"])


def size_of(data: Column | str) -> Column:
    """struct(w, h) of encoded images; nulls for missing ones and those whose header cannot be read. Of images other than
    JPEG only the first HEADER bytes leave the JVM."""
    data = F.col(data) if isinstance(data, str) else data
    return _size(F.when(F.substring(data, 1, 2) == F.unhex(F.lit("FFD8")), data).otherwise(F.substring(data, 1, HEADER)))
