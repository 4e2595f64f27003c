"""Which texts contain one of many probes, decided where the texts are read.

The probes' anchors, eight bytes each as one number, go to every task as a sorted table behind a bit table. An anchor is
what follows a probe's first space, so that only places after a space of a text are looked up; probes with less than that
behind their first space are anchored by their first bytes and looked up at every place. The few places that meet an
anchor are compared with the probes in whole. Texts stay where they are; nothing is shuffled.

UTF-8 makes substrings of characters and of bytes the same thing.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

#: Bytes of an anchor; bits of the table that is asked first, at most; places that are looked up and bytes of texts that are
#: read at once.
ANCHOR, BITS, BLOCK, CHUNK = 8, 24, 1 << 18, 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Anchors of one kind: those of `width` bytes, after a space or anywhere."""

    def __init__(self, width: int, spaced: bool, anchors: np.ndarray, befores: np.ndarray, probes: list[bytes]):
        """anchors and befores: of each probe its anchor as a number, and the distance from its beginning to the anchor. The
        probes are held as flat arrays, some 30 bytes each beside their own, for every task has the table."""
        self.width, self.spaced = width, spaced
        sizes = np.array([len(p) for p in probes], np.int32)
        shape = befores.astype(np.int64) << 32 | sizes
        order = np.array(sorted(range(len(probes)), key=lambda k: (int(anchors[k]), int(shape[k]), probes[k])), np.int64)
        anchors, shape = anchors[order], shape[order]
        self.body = b"".join(probes[k] for k in order.tolist())
        #: Where the probes of one anchor, distance and length begin, in the body and by number; distance and length.
        group = np.flatnonzero(np.append(True, (anchors[1:] != anchors[:-1]) | (shape[1:] != shape[:-1])))
        self.group, self.at = np.append(group, len(probes)), (np.cumsum(sizes[order], dtype=np.int64) - sizes[order])[group]
        self.before, self.size = befores[order][group], sizes[order][group]
        #: Distinct anchors, ascending, and where the groups of each begin.
        self.keys, first = np.unique(anchors[group], return_index=True)
        self.first = np.append(first, len(group))
        self.shift = np.uint64(64 - min(BITS, max(10, 5 + len(self.keys).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self.slot(self.keys)] = True

    def slot(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (x * _ODD) >> self.shift

    def stands(self, k: int, held: bytes, at: int, start: int, end: int) -> bool:
        """Whether a probe of the k-th anchor, which stands at `at`, stands in held[start:end]. The probes of one distance and
        length are sorted, and the one is searched for."""
        for g in range(int(self.first[k]), int(self.first[k + 1])):
            before, size, first = int(self.before[g]), int(self.size[g]), int(self.at[g])
            if at - before < start or at - before + size > end:
                continue
            said, n = held[at - before : at - before + size], int(self.group[g + 1] - self.group[g])
            probe = lambda j, first=first, size=size: self.body[first + j * size : first + (j + 1) * size]
            found = bisect_left(range(n), said, key=probe)
            if found < n and probe(found) == said:
                return True
        return False

    def places(self, data: np.ndarray, spaces: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where an anchor stands, and its number. data is padded by ANCHOR bytes."""
        windows = np.lib.stride_tricks.sliding_window_view(data, ANCHOR)
        mask = np.uint64((1 << 8 * self.width) - 1)
        last = len(data) - ANCHOR
        every = spaces + 1 if self.spaced else None
        for lo in range(0, last if every is None else len(every), BLOCK):
            at = np.arange(lo, min(lo + BLOCK, last)) if every is None else every[lo : lo + BLOCK]
            at = at[at < last]
            value = np.ascontiguousarray(windows[at]).view(np.uint64)[:, 0] & mask
            some = np.flatnonzero(self.seen[self.slot(value)])
            place = np.searchsorted(self.keys, value[some])
            place[place == len(self.keys)] = 0
            hit = self.keys[place] == value[some]
            yield from zip(at[some[hit]].tolist(), place[hit].tolist(), strict=True)


def tables(probes: Iterable[str]) -> list[Table]:
    """Anchors of probes that are collapsed and not empty, by kind; ANCHOR + 1 kinds at most."""
    kinds: dict[tuple[int, bool], tuple[array, array, list]] = defaultdict(lambda: (array("Q"), array("i"), []))
    for probe in probes:
        said = probe.encode()
        before = said.find(b" ") + 1
        spaced = before > 0 and len(said) - before >= ANCHOR
        before = before if spaced else 0
        anchor = said[before : before + ANCHOR]
        for column, x in zip(kinds[len(anchor), spaced], (int.from_bytes(anchor, "little"), before, said), strict=True):
            column.append(x)
    return [Table(width, spaced, np.array(anchors, np.uint64), np.array(befores, np.int32), said) for (width, spaced), (anchors, befores, said) in sorted(kinds.items())]


def containing(texts: pa.Array, found: list[Table]) -> np.ndarray:
    """Which of the texts contain a probe; null texts do not. Texts are read in slices of some CHUNK bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, lo = [np.zeros(0, bool)], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
        out.append(_containing(texts.slice(lo, hi - lo), found))
        lo = hi
    return np.concatenate(out)


def _containing(texts: pa.Array, found: list[Table]) -> np.ndarray:
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends[1:] - ends[0]
    data = np.concatenate((raw, np.zeros(ANCHOR, np.uint8)))
    spaces = np.flatnonzero(raw == 0x20)
    bad, held = np.zeros(len(texts), bool), raw.tobytes()
    for t in found:
        for at, k in t.places(data, spaces):
            owner = int(np.searchsorted(ends, at, "right"))
            if owner < len(bad) and not bad[owner]:
                start = int(ends[owner - 1]) if owner else 0
                bad[owner] = t.stands(k, held, at, start, int(ends[owner]))
    return bad


def filtered(spark: SparkSession, probes: Iterable[str]) -> Callable[[Column], Column]:
    """Whether a collapsed text contains one of the probes, as a column."""
    shared = spark.sparkContext.broadcast(tables(probes))

    @F.arrow_udf(T_.BooleanType())
    def contains(texts: pa.Array) -> pa.Array:
        return pa.array(containing(texts, shared.value))

    return contains
