"""Shared pieces: byte-level batches, word and shingle hashes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, stored  # noqa: F401

#: Bytes of text that numpy works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Bytes that separate words: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of doc_id as text, modulo k; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % k


#: DuckDB has no crc32: the table of the polynomial's remainders as a row that a query joins, and the sum over a text of
#: ASCII characters.
CRC_SQL = """crc AS (SELECT list(v ORDER BY i) AS crc_of FROM (
 SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::bigint, c >> 1) ELSE c >> 1 END, i::bigint) AS v FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    step = "xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])"
    return f"xor(4294967295::bigint, list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint), lambda c, b: {step}, 4294967295::bigint))"


def unit_hash(*cols: Column | str, salt: str) -> Column:
    """A number in [0, 1) that depends on the columns and the salt alone."""
    return F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(1 << 40)) / float(1 << 40)


def text_chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES, least: int = 0) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with their column `text` as bytes (null: empty), each of about `limit` bytes at most, where a
    text counts as `least` bytes or more. Only a slice's texts are copied out of the batch. At the end the memory that
    numpy and Arrow have freed goes back to the system, for a worker lives on."""
    for batch in batches:
        column = col(batch, "text")
        size = np.maximum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), least)
        ends, lo = np.cumsum(size), 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
            yield batch.slice(lo, hi - lo), [x or b"" for x in column.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
            lo = hi
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n at least."""
    if len(_powers.get("up", ())) < n:
        m = max(n, CHUNK_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                step = np.full(m, base, np.uint64)
                step[0] = 1
                _powers[key] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal spans wherever they stand."""
    with np.errstate(over="ignore"):
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in the joined bytes, the text each word is of, and the joined bytes (A-Z lowered)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        data = LOWER[data]
    word = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return starts, ends, np.searchsorted(bounds, starts, "right"), data


def by_owner(owner: np.ndarray, value: np.ndarray, level: np.ndarray | None = None) -> np.ndarray:
    """The order by owner, level (under 256) and 64-bit value. One word of the owner's, the level's and the value's first
    bits is sorted, which is far quicker than three keys; where bits cut off would decide, all keys are."""
    used = int(owner.max()).bit_length() + (0 if level is None else 8) if len(owner) else 0
    if used > 40:
        return np.lexsort((value, owner) if level is None else (value, level, owner))
    key = value >> np.uint64(used)
    if used:
        key |= owner.astype(np.uint64) << np.uint64(64 - used + (0 if level is None else 8))
        if level is not None:
            key |= level.astype(np.uint64) << np.uint64(64 - used)
    order = np.argsort(key)
    key, sorted_value = key[order], value[order]
    if ((key[1:] == key[:-1]) & (sorted_value[1:] < sorted_value[:-1])).any():
        return np.lexsort((value, owner) if level is None else (value, level, owner))
    return order


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the n+1 offsets of the texts in them. Fewer words than
    width: the whole sequence is one shingle; no word: none."""
    starts, ends, doc, data = words_of(texts)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    with np.errstate(over="ignore"):
        h = span_hashes(data, starts, ends)
        first = np.cumsum(count) - count
        sums = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            sums += mix64(h[k : k + len(sums)] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
        sums = mix64(sums + np.uint64(width))
        inside = doc[: len(sums)] == doc[width - 1 :] if len(sums) else np.zeros(0, bool)
        owner, value = doc[: len(sums)][inside], sums[inside]
        short = np.flatnonzero((count > 0) & (count < width))
        few = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            at = first[short[has]] + k
            few[has] += mix64(h[at] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
        few = mix64(few + count[short].astype(np.uint64))
    owner, value = np.concatenate((owner, short)), np.concatenate((value, few))
    order = by_owner(owner, value)
    owner, value = owner[order], value[order]
    if len(value):
        keep = np.concatenate(([True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
        owner, value = owner[keep], value[keep]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
