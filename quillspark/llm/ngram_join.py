"""N-gram Jaccard join by prefix trees.

A text's set is its distinct five-word shingles (words of bytes but 0x20 and 0x09-0x0D, A-Z lowered), as 64-bit hashes.
Two texts link when 100 * |A and B| >= 75 * |A or B|. Steps, each exact:

1. Texts of equal sets are one class (64-bit fingerprint of set and size); copies never meet each other again.
2. Document frequencies of all shingles of all classes are counted, and those of OFTEN or more make a table of levels
   (half a byte each), a cell for four shingles of the corpus, between CELLS and MOST_CELLS. The global order is by level,
   then hash: shingles of shared passages come last. Any order gives the same links; the table decides how much work
   there is. A shingle whose cell is empty is in one class alone.
3. Classes that link share a shingle among the first floor(n / 4) + 1 of the order. Each task joins its own classes on
   such shingles, but for those of one class alone, and passes on one representative a shingle, so a shingle shared by a third of all classes sends a row a
   task; the shuffle carries packed arrays by hash range. This gives candidate components.
4. The texts of candidate classes, one a class, go to groups. A component of BLOCK classes or fewer is a group. In larger
   ones families are found first: ROUNDS times all classes, in groups of some BLOCK, walk a trie of PIVOTS classes drawn from those outside the component's largest family so far. A class of that family is then held against
   classes outside it alone, by pairs of blocks of near sizes: first of sketches (a bit for the parity of the shingles in
   each cell, two to four bits a shingle, in blocks of SKETCHED), whose differing bits are no more than the sets' differing
   shingles, so no link is lost; then of texts, where sketches are near enough. No task holds an unbounded group, and copies with small
   changes cost a row or two each, however many there are.
5. Within a group the sets are stored, rare shingles first, in a path-compressed trie whose paths are also cut where a
   set's prefix ends. A class walks the trie once: the overlap with a shared path is counted once for all sets below it,
   and a subtree is pruned when its sizes, or the overlap plus what can remain, rule out a link, or when all of it is in
   the class's component already. The first level, the widest by far, is taken in one vectorised step.
6. The links found (a spanning forest of each component) give the components.

Cases: null or blank text: no shingle, linked with nothing, its own component. Fewer than five words: the sequence is
the one shingle. A null id keeps its row; its component is the smallest id it reaches, or null. Repeated rows give
repeated rows. Extra columns are ignored. Empty table: no row. Very long texts are shingled whole, a chunk each, in some
forty times their size of memory. Ties in frequency go by hash; of a component's ids the smallest names it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_owner, col, discard, mix64, shingles, signed, stored, table, text_chunks
from .graph import components, local_roots

WIDTH, PERCENT = 5, 75
#: Classes that make a shingle frequent; the least and the most cells of the level table, powers of two; the least and the
#: most bits of an index into the table of candidates.
OFTEN, CELLS, MOST_CELLS, CANDIDATE_BITS, MOST_BITS = 2, 1 << 24, 1 << 27, 22, 26
#: Frequencies at which levels begin, from 1.
LEVELS = np.array([OFTEN, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 512, 2048, 1 << 14, 1 << 17])
BLOCK, PIVOTS, ROUNDS = 128, 16, 1
#: Classes of a block of sketches; the most bits of a sketch.
SKETCHED, SKETCH_BITS = 4096, 1 << 15
#: Places in which the classes of one component meet what is known of it.
SALTS = 32
#: A class of more copies than MANY, and than one in HOT of all rows, is named where its rows stand.
MANY, HOT = 1000, 50_000
#: Values held by a task before they are joined and passed on.
HELD = 2_000_000


def class_ids(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A fingerprint of each set; meaningless for empty ones."""
    n = np.diff(offsets)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(values + np.uint64(0x51ED)))))
        return mix64(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64) * np.uint64(0x9E37))


def gather(values: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some sets, and the set each is of (as a position in docs)."""
    n = np.diff(offsets)[docs]
    owner = np.repeat(np.arange(len(docs)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1][docs], n)
    return values[at], owner


def new_classes(ids: np.ndarray, sizes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Positions of the first of each class that this task has not met; they are added to seen."""
    out = []
    for i, (c, n) in enumerate(zip(ids.tolist(), sizes.tolist(), strict=True)):
        if n and c not in seen:
            seen.add(c)
            out.append(i)
    return np.array(out, np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls of every row; cls is null for an empty set."""

    def apply(batches):
        for batch, texts in text_chunks(batches):
            values, offsets = shingles(texts)
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), pa.array(n), pa.array(class_ids(values, offsets).view(np.int64), mask=n == 0)], ["doc_id", "n", "cls"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, n long, cls long")


#: Bits of a shingle by which it is counted.
BITS = 40


def places(values: np.ndarray) -> np.ndarray:
    """BITS bits of each shingle, of which the first are its cell and its range."""
    return mix64(values + np.uint64(0xC0FFEE)) >> np.uint64(64 - BITS)


def cell_of(bits: np.ndarray, cells: int) -> np.ndarray:
    return (bits >> np.uint64(BITS + 1 - cells.bit_length())).astype(np.int64)


def n_cells(shingles: int) -> int:
    """Cells of the level table for so many shingles."""
    return min(MOST_CELLS, max(CELLS, 1 << (shingles // 4).bit_length()))


def n_ranges(spark: SparkSession) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_range(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[list[bytes]]]:
    """The blobs of each range, column by column; batches are sorted by range."""
    now, rows = None, [[] for _ in range(width)]
    for batch in batches:
        for r, *blobs in zip(*[batch.column(k).to_pylist() for k in range(width + 1)], strict=True):
            if r != now and now is not None:
                yield rows
                rows = [[] for _ in range(width)]
            now = r
            for x, y in zip(rows, blobs, strict=True):
                x.append(y)
    if now is not None:
        yield rows


def steps(bits: np.ndarray) -> bytes:
    """Ascending numbers as the steps between them, in as many bytes each as the widest takes."""
    step = np.diff(bits, prepend=np.uint64(0))
    step[0] = 0  # the first is kept apart
    wide = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bits[:1].tobytes() + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def numbers(blob: bytes, n: int) -> np.ndarray:
    """The n numbers that `steps` packed."""
    step = np.zeros((n, 8), np.uint8)
    data = np.frombuffer(blob, np.uint8)[8:].reshape(n, -1)
    step[:, : data.shape[1]] = data
    return np.frombuffer(blob[:8], np.uint64) + np.cumsum(step.view("<u8")[:, 0], dtype=np.uint64)


def frequencies(docs: DataFrame, cells: int) -> DataFrame:
    """first, level: runs of cells, by the first one's number, and a byte for each: the level of the largest frequency of
    its shingles, 0 if no two classes share one. All texts are counted. The shuffle carries some three bytes a shingle, and its
    count where a task has it more than once; cells meet by range, so nothing is shuffled again."""
    ranges = n_ranges(docs.sparkSession)

    def packed(parts):
        v, c = np.unique(np.concatenate(parts), return_counts=True)
        bits = places(v)
        order = np.argsort(bits, kind="stable")
        bits, c = bits[order], c[order]
        cut = np.searchsorted((bits * np.uint64(ranges) >> np.uint64(BITS)).astype(np.int64), np.arange(ranges + 1))
        for k in range(ranges):
            x, n = bits[cut[k] : cut[k + 1]], c[cut[k] : cut[k + 1]]
            if not len(x):
                continue
            more = np.flatnonzero(n > 1)
            blobs = [steps(x), more.astype(np.uint32).tobytes(), n[more].astype(np.uint32).tobytes(), np.uint32(len(x)).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *[pa.array([y], pa.binary()) for y in blobs]], ["r", "bits", "more", "n", "size"])

    def count(batches):
        seen: set[int] = set()
        held, size = [], 0
        for _, texts in text_chunks(batches):
            values, offsets = shingles(texts)
            held.append(gather(values, offsets, new_classes(class_ids(values, offsets), np.diff(offsets), seen))[0])
            size += len(held[-1])
            if size > HELD:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    def merge(batches):
        for packs, more, n, size in by_range(batches, 4):
            sizes = [int.from_bytes(x, "little") for x in size]
            bits = np.concatenate([numbers(x, k) for x, k in zip(packs, sizes, strict=True)])
            times = np.ones(len(bits), np.int64)
            first = np.cumsum([0, *sizes[:-1]])
            at = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + f for x, f in zip(more, first, strict=True)])
            times[at] = np.frombuffer(b"".join(n), np.uint32)
            order = np.argsort(bits)
            bits, times = bits[order], times[order]
            start = np.flatnonzero(np.concatenate(([True], bits[1:] != bits[:-1])))
            level = np.searchsorted(LEVELS, np.add.reduceat(times, start), "right").astype(np.uint8)
            cell = cell_of(bits[start], cells)
            own = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            run = np.zeros(int(cell[-1] - cell[0]) + 1, np.uint8)
            run[cell[own] - cell[0]] = np.maximum.reduceat(level, own)
            yield pa.RecordBatch.from_arrays([pa.array([int(cell[0])], pa.int64()), pa.array([run.tobytes()], pa.binary())], ["first", "level"])

    blobs = docs.select("text").mapInArrow(count, "r long, bits binary, more binary, n binary, size binary")
    return blobs.repartition(ranges, "r").sortWithinPartitions("r").mapInArrow(merge, "first long, level binary")


def levels(runs: DataFrame, cells: int) -> tuple[np.ndarray, int]:
    """The levels, two to a byte, and the least level that the order heeds: levels below it are left out as needed for half
    of the cells at most to count, so rare shingles keep apart from frequent ones."""
    out, taken = np.zeros(cells >> 1, np.uint8), np.zeros(16, np.int64)
    runs = stored(runs, "levels")
    for r in runs.toLocalIterator():  # a byte a cell in all, a file at a time
        first, level = r["first"], np.frombuffer(r["level"], np.uint8)
        at = first + np.flatnonzero(level)
        level = level[at - first]
        for odd in (0, 1):  # the first cell may have been met in the range before
            own = (at & 1) == odd
            byte, shift = at[own] >> 1, 4 * odd
            most = np.maximum((out[byte] >> shift) & 15, level[own])
            out[byte] = out[byte] & (240 if odd == 0 else 15) | most << shift
        taken += np.bincount(level, minlength=16)
    discard(runs)
    least = 15
    while least > 1 and taken[least - 1 :].sum() <= cells // 2:
        least -= 1
    return out, least


def level_of(table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return table[cell >> 1] >> (4 * (cell & 1)).astype(np.uint8) & np.uint8(15)


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of n of which a partner has one at least: n - ceil(n * PERCENT / 100) + 1."""
    return n - -(-n * PERCENT // 100) + 1


def candidate_edges(docs: DataFrame, level: np.ndarray, least: int) -> DataFrame:
    """(a, b): classes that share a shingle of their prefixes, as stars around the smallest class. Shingles of one class
    alone, whose cell is empty, stay where they are."""
    spark = docs.sparkSession
    ranges = n_ranges(spark)
    cells = 2 * len(level)
    shared = spark.sparkContext.broadcast(level)  # MOST_CELLS / 2 bytes at most

    def stars(token: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens, the smallest class of each, and the forest of the edges between classes of one token."""
        if not len(token):
            return token, cls, token, cls
        order = np.argsort(token)
        token, cls = token[order], cls[order]
        first = np.concatenate(([True], token[1:] != token[:-1]))
        least = np.minimum.reduceat(cls, np.flatnonzero(first))
        center = least[np.cumsum(first) - 1]
        other = center != cls
        if not other.any():
            return token[first], least, *np.zeros((2, 0), np.uint64)
        nodes, roots = local_roots(center[other], cls[other])
        return token[first], least, roots[nodes != roots], nodes[nodes != roots]

    def packed(parts: list) -> Iterator[pa.RecordBatch]:
        token, cls, a, b = stars(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        part, edge = (mix64(token) % np.uint64(ranges)).astype(np.int64), (mix64(a) % np.uint64(ranges)).astype(np.int64)
        order, edge_order = np.argsort(part, kind="stable"), np.argsort(edge, kind="stable")
        cut, edge_cut = np.searchsorted(part[order], np.arange(ranges + 1)), np.searchsorted(edge[edge_order], np.arange(ranges + 1))
        token, cls, a, b = token[order], cls[order], a[edge_order], b[edge_order]
        blob = lambda x, c, r: x[c[r] : c[r + 1]].tobytes()
        for r in np.flatnonzero(np.diff(cut) + np.diff(edge_cut)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), *[pa.array([blob(x, c, r)], pa.binary()) for x, c in ((token, cut), (cls, cut), (a, edge_cut), (b, edge_cut))]], ["r", "token", "cls", "a", "b"])

    def prefixes(batches):
        seen: set[int] = set()
        held, size = [], 0
        for _, texts in text_chunks(batches):
            values, offsets = shingles(texts)
            ids, n = class_ids(values, offsets), np.diff(offsets)
            new = new_classes(ids, n, seen)
            v, owner = gather(values, offsets, new)
            often = level_of(shared.value, cell_of(places(v), cells))
            order = by_owner(owner, v, np.where(often < least, np.uint8(0), often))
            v, often = v[order], often[order]  # owner stays sorted
            n = n[new]
            place = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)
            keep = (place < np.repeat(prefix_size(n), n)) & (often > 0)
            held.append((v[keep], ids[new][owner[keep]]))
            size += int(keep.sum())
            if size > HELD:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    def merge(batches):
        def joined(rows):
            token, cls, a, b = (np.frombuffer(b"".join(x), np.uint64) for x in rows)
            _, _, x, y = stars(token, cls) if len(token) else (None, None, *np.zeros((2, 0), np.uint64))
            a, b = np.concatenate((a, x)), np.concatenate((b, y))
            if len(a):
                nodes, roots = local_roots(a, b)
                a, b = roots[nodes != roots], nodes[nodes != roots]
            return pa.RecordBatch.from_arrays([signed(a), signed(b)], ["a", "b"])

        for rows in by_range(batches, 4):
            yield joined(rows)

    blobs = docs.select("text").mapInArrow(prefixes, "r long, token binary, cls binary, a binary, b binary")
    return blobs.repartition(ranges, "r").sortWithinPartitions("r").mapInArrow(merge, "a long, b long")


class Trie:
    """Distinct sets of ranks, some of them in a path-compressed trie, and the components of their links."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        """sets: sorted ranks, each with one at least; members: those in the trie."""
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        self.words = 1 + max(int(s[-1]) for s in sets)
        self.label = np.arange(len(sets))
        order = sorted(members.tolist(), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order = np.array(order)
        root = self._build(0, len(order), 0)
        self.top = root[7] if not len(root[0]) and root[6] < 0 else [root]
        # the first level, and the whole sets of those of its nodes that hold one set alone, as flat arrays
        self.paths = np.concatenate([t[0] for t in self.top])
        self.starts = np.cumsum([0] + [len(t[0]) for t in self.top[:-1]])
        self.last = np.array([t[0][-1] for t in self.top])
        self.alone = np.array([order[t[1]] if t[2] - t[1] == 1 else -1 for t in self.top])
        self.deep, self.small, self.large = (np.array([t[k] for t in self.top]) for k in (3, 4, 5))
        tails = [sets[i][d:] if i >= 0 else t[0][:0] for i, d, t in zip(self.alone.tolist(), self.deep.tolist(), self.top, strict=True)]
        self.tails = np.concatenate(tails)
        self.tail_at = np.cumsum([0] + [len(t) for t in tails])

    def _build(self, lo: int, hi: int, depth: int):
        """Nodes: (path from the parent's depth, lo, hi, depth at its end, smallest and largest size, set that ends here
        or -1, children). A path is cut where the largest set's prefix ends."""
        sets, order = self.sets, self.order
        top: list = []
        work = [(lo, hi, depth, top)]
        while work:
            lo, hi, depth, into = work.pop()
            first, last = sets[order[lo]], sets[order[hi - 1]]
            m = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:m] != last[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            size = self.size[order[lo:hi]]
            children: list = []
            cut = int(prefix_size(size.max()))
            if depth < cut < end:
                into.append((first[depth:cut], lo, hi, cut, int(size.min()), int(size.max()), -1, children))
                work.append((lo, hi, cut, children))
                continue
            ends, at = -1, lo
            if len(first) == end:
                ends, at = int(order[lo]), lo + 1
            into.append((first[depth:end], lo, hi, end, int(size.min()), int(size.max()), ends, children))
            if at < hi:
                heads = np.array([sets[i][end] for i in order[at:hi]])
                cuts = np.flatnonzero(np.diff(heads)) + 1
                for a, b in zip([0, *cuts], [*cuts, hi - at], strict=True):
                    work.append((at + int(a), at + int(b), end, children))
        return top[0]

    def link(self, x: int, everything: bool = False) -> list[int]:
        """Members that link with set x; without `everything`, only as many as join its component to each other one."""
        mine, label, order = self.sets[x], self.label, self.order
        n, most = len(mine), 100 + PERCENT
        mask = np.zeros(self.words + 1, np.uint8)
        mask[mine] = 1
        left = n - np.searchsorted(mine, self.last, "right")  # of x, after a path's last rank
        overlaps = np.add.reduceat(mask[self.paths].astype(np.int32), self.starts)
        best = overlaps + np.minimum(self.large - self.deep, left)
        walk = (most * best >= PERCENT * (n + self.small)) & (100 * n >= PERCENT * self.small) & (100 * self.large >= PERCENT * n)
        single = self.alone >= 0
        if not everything:
            walk &= ~single | (label[self.alone] != label[x])
        found = []

        def meet(y: int) -> None:
            if y != x and (everything or label[y] != label[x]):
                found.append(y)
                label[label == label[y]] = label[x]

        at = np.flatnonzero(walk & single)
        if len(at):
            size = self.tail_at[at + 1] - self.tail_at[at]
            if len(at) * 3 > len(self.top):
                total = np.concatenate(([0], np.cumsum(mask[self.tails], dtype=np.int32)))
                rest = total[self.tail_at[at + 1]] - total[self.tail_at[at]]
            else:
                flat = np.arange(size.sum()) + np.repeat(self.tail_at[at] - (np.cumsum(size) - size), size)
                total = np.concatenate(([0], np.cumsum(mask[self.tails[flat]], dtype=np.int32)))
                stop = np.cumsum(size)
                rest = total[stop] - total[stop - size]
            for y in self.alone[at[most * (overlaps[at] + rest) >= PERCENT * (n + self.large[at])]].tolist():
                meet(y)
        stack = [((self.top[k][0][:0], *self.top[k][1:]), int(overlaps[k])) for k in np.flatnonzero(walk & ~single).tolist()]
        while stack:
            (path, lo, hi, depth, small, large, ends, children), overlap = stack.pop()
            if 100 * n < PERCENT * small or 100 * large < PERCENT * n:
                continue
            if not everything and (label[order[lo:hi]] == label[x]).all():
                continue
            if len(path):
                overlap += int(mask[path].sum())
                rest = n - int(np.searchsorted(mine, path[-1], "right"))
                if most * (overlap + min(large - depth, rest)) < PERCENT * (n + small):
                    continue
            if ends >= 0 and most * overlap >= PERCENT * (n + self.size[ends]):
                meet(ends)
            stack += [(c, overlap) for c in children]
        return found


def forest(values: list[np.ndarray], probe: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what links among sets of hashes: of every two sets if probe holds for all, else of a set where
    it holds with one where it doesn't."""
    v, at, df = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    rank = np.empty(len(v), np.int64)
    rank[np.lexsort((v, df))] = np.arange(len(v))
    bounds = np.cumsum([len(x) for x in values])[:-1]
    members = np.flatnonzero(~probe) if not probe.all() else np.arange(len(values))
    if not probe.any():
        return []
    trie = Trie([np.sort(x) for x in np.split(rank[at], bounds)], members)
    out = []
    for x in np.flatnonzero(probe).tolist():
        if (trie.label[members] == trie.label[x]).all():
            continue
        out += [(x, y) for y in trie.link(x)]
    return out


def candidate_bodies(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """cls, body of the candidate classes and some others. Each task sends one body a class, and one of these is kept."""
    # a table of candidates, so that most other texts stay where they are; the later join is exact
    wide = min(MOST_BITS, max(CANDIDATE_BITS, (16 * roots.count()).bit_length()))
    bits = np.zeros(1 << wide >> 3, np.uint8)
    cells = roots.select(F.shiftrightunsigned("node", 64 - wide).alias("c"))
    packed = cells.groupBy(F.shiftright("c", 3).alias("byte")).agg(F.bit_or(F.expr("cast(shiftleft(1, cast(c & 7 as int)) as int)")).alias("v"))
    for b in packed.toArrow().to_batches():
        bits[b.column(0).to_numpy()] = b.column(1).to_numpy().astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def candidates(batches):
        seen: set[int] = set()
        for _, texts in text_chunks(batches):
            values, offsets = shingles(texts)
            ids, n = class_ids(values, offsets), np.diff(offsets)
            c = (ids >> np.uint64(64 - wide)).astype(np.int64)
            listed = (shared.value[c >> 3] >> (c & 7).astype(np.uint8)) & 1
            new = new_classes(ids, np.where(listed, n, 0), seen)
            yield pa.RecordBatch.from_arrays([signed(ids[new]), pa.array([texts[i] for i in new], pa.binary())], ["cls", "body"])

    out = stored(docs.select("text").mapInArrow(candidates, "cls long, body binary").groupBy("cls").agg(F.first("body").alias("body")), "bodies")
    shared.destroy()
    return out


def links(bodies: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): linked classes, a spanning forest of what each group links. groups: cls, grp, side; all pairs of a group are
    held against each other if all its classes are of side 1, else those of side 1 against those of side 0."""

    def verify(batches):
        def solve(rows):
            if len(rows) < 2:
                return [], []
            cls = list(rows)
            values, offsets = shingles([rows[c][1] for c in cls])
            found = forest(np.split(values, offsets[1:-1]), np.array([rows[c][0] for c in cls]) == 1)
            return [cls[x] for x, _ in found], [cls[y] for _, y in found]

        now, rows = None, {}
        for batch in batches:
            a, b = [], []
            for g, c, s, t in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if g != now:
                    x, y = solve(rows)
                    a, b, now, rows = a + x, b + y, g, {}
                if c not in rows or s == 0:  # a pivot is one in its own group too
                    rows[c] = (s, t)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b = solve(rows)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return bodies.join(groups, "cls").select("grp", "cls", "side", "body").repartition("grp").sortWithinPartitions("grp").mapInArrow(verify, "a long, b long")


def pivot_groups(big: DataFrame, salt: int) -> DataFrame:
    """cls, grp, side. big: cls, root, total, core (in the largest family of its component). The classes of a component are
    dealt into groups, and each group gets the component's pivots, on side 0."""
    parts = F.ceil(F.col("total") / BLOCK).cast("int")
    grp = lambda k: F.xxhash64(F.lit("pivots"), F.lit(salt), "root", k).alias("grp")
    dealt = big.select("cls", grp(F.pmod(F.xxhash64(F.lit(salt), "cls"), parts).cast("int")), F.lit(1).alias("side"))
    h = F.xxhash64(F.lit(salt + 1000), "cls")  # of each of PIVOTS parts of a component the class of least hash
    drawn = big.where(~F.col("core")).groupBy("root", "total", F.pmod(h, F.lit(PIVOTS)).alias("part")).agg(F.min(F.struct(h.alias("h"), "cls"))["cls"].alias("cls"))
    pivots = drawn.select("cls", "root", "total")
    each = pivots.select("cls", "root", F.explode(F.sequence(F.lit(0), parts - 1)).alias("k"))
    return dealt.unionByName(each.select("cls", grp(F.col("k")), F.lit(0).alias("side")))


def spread_join(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows (which have cls) with a table of few rows for each key; a key that many rows have is met in SALTS places."""
    salt = F.pmod(F.xxhash64(F.lit("salt"), "cls"), F.lit(SALTS)).cast("int")
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def with_families(big: DataFrame, edges: DataFrame) -> DataFrame:
    """big with `core` by the links found so far, and `settled` where all of a component is core."""
    found = components(edges)
    named = big.drop("core", "settled").join(found.select(F.col("node").alias("cls"), F.col("root").alias("family")), "cls", "left").withColumn("family", F.coalesce("family", "cls"))
    sizes = named.groupBy("root", "total", "family").agg(F.count("*").alias("size"))
    first = sizes.groupBy("root").agg(F.max(F.struct("size", "family", "total")).alias("m")).select("root", F.col("m.family").alias("first"), (F.col("m.size") == F.col("m.total")).alias("settled"))
    return stored(spread_join(named, first, ["root"]).withColumn("core", F.col("family") == F.col("first")).drop("family", "first"), "families")


def block_groups(big: DataFrame, block: int) -> DataFrame:
    """cls, grp, side: every pair of blocks that can hold a link yet unknown is a group. Blocks of some `block` classes are of one component, one
    size class (factor 100 / PERCENT, so links stay in a class or cross to the next) and of the core or the rest, dealt by
    hash; two blocks of a core have nothing to say to each other."""
    c = big.where(~F.col("settled")).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int"))
    kind = ["root", "band", "core"]
    parts = c.groupBy(*kind).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    c = spread_join(c, parts, kind).withColumn("p", F.pmod(F.xxhash64(F.lit("block"), "cls"), F.col("parts")).cast("int")).drop("parts")
    other = parts.select("root", F.col("band").alias("band2"), F.col("core").alias("core2"), "parts")
    near = c.withColumn("band2", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    near = spread_join(near, other, ["root", "band2"]).where("not core or not core2")
    each = near.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    here, there = F.struct("core", "band", "p"), F.struct(F.col("core2").alias("core"), F.col("band2").alias("band"), F.col("q").alias("p"))
    side = F.when(here <= there, 1).otherwise(0)
    return each.select("cls", F.xxhash64(F.lit("blocks"), "root", F.least(here, there), F.greatest(here, there)).alias("grp"), side.alias("side"))


def sketch(values: np.ndarray) -> bytes:
    """A bit for each cell, set where an odd number of the set's shingles falls into it; 2 to 4 bits a shingle."""
    bits = min(SKETCH_BITS, max(256, 1 << (2 * len(values) - 1).bit_length()))
    cell = (mix64(values + np.uint64(0x5EED)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all as short as the shortest: halves are added up."""
    size = min(map(len, sketches))
    out = np.empty((len(sketches), size // 8), np.uint64)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size // 8), axis=0)
    return out


def near_sketches(n: np.ndarray, sketches: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may link, a forest that joins the same sets as all of them do. n: sizes of the sets; side: of all pairs if
    it is 1 for all, else of 1 with 0. Sets that differ in s shingles differ in s bits at most."""
    probe = np.flatnonzero(side == 1)
    against = np.flatnonzero(side == 0) if (side == 0).any() else probe
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = max(1, (1 << 20) // max(1, sketches.shape[1] * len(against)))
    found, size = [], 0
    for lo in range(0, len(probe), step):
        x = probe[lo : lo + step]
        y = against if against is not probe else probe[lo:]
        differ = np.bitwise_count(sketches[x][:, None] ^ sketches[y][None]).sum(2, dtype=np.int64)
        i, j = np.nonzero((100 + PERCENT) * differ <= (100 - PERCENT) * (n[x][:, None] + n[y][None]))
        i, j = x[i], y[j]
        found.append((i[i != j], j[i != j]))
        size += len(found[-1][0])
        if size > 1 << 20 or lo + step >= len(probe):
            a, b = np.concatenate([a, *[f[0] for f in found]]), np.concatenate([b, *[f[1] for f in found]])
            found, size = [], 0
            if len(a):
                nodes, roots = local_roots(a, b)
                a, b = roots[nodes != roots], nodes[nodes != roots]
    return a, b


def near(bodies: DataFrame, big: DataFrame) -> DataFrame:
    """big without the classes that have no link yet unknown, each with its component by near sketches as its root. Only
    sketches are shuffled; sizes are those of the sets."""

    def sketched(batches):
        for batch, texts in text_chunks(b.rename_columns(["cls", "text"]) for b in batches):
            values, offsets = shingles(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array([sketch(v) for v in np.split(values, offsets[1:-1])], pa.binary())], ["cls", "n", "sketch"])

    def compare(batches):
        now, rows = None, {}

        def solve():
            if len(rows) < 2:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            cls = np.array(list(rows), np.int64)
            side, n, sketches = zip(*rows.values(), strict=True)
            a, b = near_sketches(np.array(n), folded(list(sketches)), np.array(side))
            return pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b])], ["a", "b"])

        for batch in batches:
            for g, c, *row in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if g != now:
                    yield solve()
                    now, rows = g, {}
                rows[c] = row
        yield solve()

    sketches = stored(bodies.select("cls", "body").mapInArrow(sketched, "cls long, n long, sketch binary"), "sketches")
    met = sketches.join(block_groups(big, SKETCHED), "cls").select("grp", "cls", "side", "n", "sketch")
    edges = met.repartition("grp").sortWithinPartitions("grp").mapInArrow(compare, "a long, b long")
    roots = components(edges)
    discard(sketches)
    return big.drop("root").join(roots.withColumnRenamed("node", "cls"), "cls")


def linked(docs: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): links that join what links. classes: cls, n; roots: the candidate components."""
    bodies = candidate_bodies(docs, roots)
    c = classes.join(roots.withColumnRenamed("node", "cls"), "cls")
    large = c.groupBy("root").agg(F.count("*").alias("total")).where(F.col("total") > BLOCK)
    c = stored(spread_join(c, large, ["root"], "left").withColumn("core", F.lit(False)), "candidates")
    small, big = c.where("total is null"), c.where("total is not null")
    groups = small.select("cls", F.xxhash64("root").alias("grp"), F.lit(1).alias("side"))
    if big.isEmpty():
        edges = stored(links(bodies, groups), "links")
        discard(bodies, c)
        return edges
    groups = stored(groups.unionByName(pivot_groups(big, 0)), "groups")
    edges, made = stored(links(bodies, groups), "links"), [c, groups]
    for k in range(1, ROUNDS + 1):
        big = with_families(big, edges)
        groups = stored(pivot_groups(big, k) if k < ROUNDS else block_groups(near(bodies, big), BLOCK), "groups")
        made += [big, groups]
        edges = edges.unionByName(stored(links(bodies, groups), "links"))
    discard(bodies, *made)
    return edges


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls (equal for equal sets; null for empty ones) and component_id of every row of docs."""
    docs = docs.select("doc_id", "text")
    rows = stored(signatures(docs), "signatures")
    cells = n_cells(rows.agg(F.sum("n")).first()[0] or 0)
    roots = components(candidate_edges(docs, *levels(frequencies(docs, cells), cells)))
    classes = rows.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    found = components(linked(docs, classes.select("cls", "n"), roots)).select(F.col("node").alias("cls"), "root")
    smallest = found.join(classes, "cls").groupBy("root").agg(F.min("first_id").alias("linked_id"))
    named = classes.join(spread_join(found, smallest, ["root"]), "cls", "left").select("cls", "copies", F.coalesce("linked_id", "first_id").alias("component_id"))
    named = stored(named, "named")
    many = max(MANY, rows.count() // HOT)
    hot = named.where(F.col("copies") > many).select("cls", "component_id")  # HOT classes at most: their rows stay where they are
    first = rows.join(F.broadcast(hot), "cls", "left")
    rest = first.where("component_id is null").drop("component_id").join(named.where(F.col("copies") <= many).select("cls", "component_id"), "cls", "left")
    out = first.where("component_id is not null").unionByName(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "cls", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, that of its smallest id, with all columns; of repeated rows one. Rows without an id
    stay."""
    kept = join(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: The same by plain joins: all shingles meet, and closures are enumerated, so for small tables.
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.y), doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = doc_id GROUP BY doc_id, n.n
"""
