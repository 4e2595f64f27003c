"""Cost-balanced packing of tokenized documents into sequences of fixed capacity.

A document is its token ids and the end id. Its full-capacity pieces are sequences of their own; what is left goes into
a pool. A pool's bins are as many full sequences as its tokens fill, and for the remainder bins at the powers of two
that sum to it, so nothing is padded. Pieces descend by length; each goes to the bin of lowest estimated cost (linear
plus quadratic in the length of a piece, as attention runs within a piece) among those with room for it; where none has
room it is cut, filling the cheapest open bin. A pool holds POOL_TOKENS tokens at most and never leaves its task, so
there is no shuffle, no group to gather, and a retried task packs the same sequences again.

Ids of pieces of words are memoized in each Python worker (`PieceIds`, some 50 MB).

Cases: null or empty text: the end id alone. A null id is packed like any other. Repeated rows are packed each. Empty
table: no row. Extra columns are ignored. Ties in length go by the order of rows, ties in cost to the first bin. A very long
text is one chunk in its task, of some ten times its size in memory.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, SPACE, col, mix64, table, text_chunks

CAPACITY, END = 4096, 2
POOL_TOKENS = 1 << 21
#: Pieces that a Python worker's memo holds (some 100 bytes each), and the bytes of the longest.
MEMO_PIECES, PIECE_BYTES = 600_000, 32
#: ASCII marks but the apostrophe; masks of the first bytes of a little-endian word.
MARK = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Cost of a token, and of a pair of tokens in a piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with one space after each, the starts and ends of the pieces in them, and which are letters alone."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    after_c3 = np.concatenate(([False], raw[:-1] == 0xC3))
    high = raw >= 0x80
    second = after_c3 & high & (raw < 0xC0)  # of Latin-1 letters, x and division signs
    data = LOWER[raw]
    data[second & (raw <= 0x9E) & (raw != 0x97)] += 32
    ends_letter = ((data >= 97) & (data <= 122)) | (second & (raw != 0x97) & (raw != 0xB7))
    space = SPACE[raw]
    begin = ~space
    begin[1:] &= space[:-1] | (ends_letter[:-1] & MARK[raw[1:]])
    starts = np.flatnonzero(begin)
    close = ~space
    close[:-1] &= space[1:] | begin[1:]
    ends = np.flatnonzero(close) + 1
    odd = high & ~second
    odd[:-1] &= ~((raw[:-1] == 0xC3) & second[1:])
    if odd.any():  # as it was, for case and composition
        n = np.concatenate(([0], np.cumsum(odd, dtype=np.int32)))
        changed = np.flatnonzero(n[ends] > n[starts])
        at, _ = runs(starts[changed], ends[changed] - starts[changed])
        data[at] = raw[at]
    letter = ends_letter
    letter[:-1] |= (raw[:-1] == 0xC3) & ends_letter[1:] & high[1:]
    n = np.concatenate(([0], np.cumsum(~letter, dtype=np.int32)))
    plain = n[ends] == n[starts]
    return data, starts, ends, plain


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first PIECE_BYTES bytes of each piece as four words, its length, and a hash of these."""
    length = ends - starts
    words = np.ndarray((len(data),), "<u8", np.concatenate((data, np.zeros(PIECE_BYTES, np.uint8))), 0, (1,))
    key = np.zeros((4, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        h = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(4):
            at = np.flatnonzero(length > 8 * j) if j else slice(None)
            begin = starts[at] + 8 * j
            # past the end of the data only pieces over PIECE_BYTES could look, whose key is not used
            key[j, at] = words[np.minimum(begin, len(data) - 1)] & FIRST[np.minimum(length[at] - 8 * j, 8)]
            h[at] = mix64(h[at] ^ key[j, at])
    return key, length, h


def runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all runs in turn, and the run that each is of."""
    sizes = sizes.astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + (starts - (np.cumsum(sizes) - sizes))[owner], owner


class PieceIds:
    """Token ids of texts, by way of a bounded memo of pieces.

    Texts are parted at white space of ASCII, and after a letter (ASCII or Latin-1) where a mark of ASCII but the
    apostrophe follows: the tokenizer's own splits never cross these places, so a text's ids are those of its pieces in
    turn. Pieces of ASCII and Latin-1 letters and ASCII marks are lowered first, as the tokenizer would. The memo is an
    open hash table over arrays that holds the bytes of its pieces, so what it returns is exact; pieces of over
    PIECE_BYTES bytes are encoded each time. A full memo keeps what was met again since it was last full.
    """

    held: dict[str, PieceIds] = {}

    def __init__(self, path: str, most: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.most = tokenizer.encode_batch_fast, most
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.bits = max(4, (2 * most - 1).bit_length())
        self._clear()

    @classmethod
    def of(cls, path: str) -> PieceIds:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def _clear(self) -> None:
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.hash, self.key = np.zeros(self.most, np.uint64), np.zeros((4, self.most), np.uint64)
        self.length, self.count = np.zeros(self.most, np.uint8), np.zeros(self.most, np.uint8)
        self.at, self.again = np.zeros(self.most, np.int64), np.zeros(self.most, bool)
        self.ids, self.used, self.n = np.zeros(4 * self.most, np.uint16 if len(self.last) <= 1 << 16 else np.uint32), 0, 0

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.encode(texts, add_special_tokens=False)]

    def find(self, key: np.ndarray, length: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 where there is none."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            e = self.table[slot]
            some = e >= 0
            left, slot, e = left[some], slot[some], e[some]
            same = (self.hash[e] == h[left]) & (self.length[e] == length[left])
            long = np.flatnonzero(same & (length[left] > 8))
            same[long] = (self.key[:, e[long]] == key[:, left[long]]).all(0)
            out[left[same]] = e[same]
            left, slot = left[~same], (slot[~same] + 1) & ((1 << self.bits) - 1)
        return out

    def place(self, lo: int) -> None:
        """Entries from lo on get their places in the table."""
        left = np.arange(lo, self.n)
        slot = (self.hash[left] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            rest = self.table[slot] != left
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def learn(self, said: Callable[[np.ndarray], list[str]], plain: np.ndarray, key: np.ndarray, length: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Makes entries of pieces, which said gives by their places, and returns these. Plain ones, letters alone, are
        encoded in runs and parted at the ids that end a word."""
        order = np.concatenate((run := np.flatnonzero(plain), rest := np.flatnonzero(~plain)))
        flat, count = [], []
        for k in range(0, len(run), 5000):
            flat += self.raw([" ".join(said(run[k : k + 5000]))])
            count.append(np.diff(np.flatnonzero(self.last[flat[-1]]), prepend=-1))
        flat += (alone := self.raw(said(rest)))
        count = np.concatenate((*count, [len(x) for x in alone])).astype(np.int64)
        flat = np.concatenate(flat)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(flat), len(self.ids) // 2), self.ids.dtype)))
        lo, hi = self.n, self.n + len(order)
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[lo:hi], self.count[lo:hi] = self.used + np.cumsum(count) - count, count
        self.key[:, lo:hi], self.length[lo:hi], self.hash[lo:hi], self.again[lo:hi] = key[:, order], length[order], h[order], False
        self.used, self.n = self.used + len(flat), hi
        self.place(lo)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.arange(lo, hi)
        return entry

    def make_room(self) -> None:
        """Half of the memo at most stays: of what was met again, the first."""
        keep = np.flatnonzero(self.again[: self.n])[: self.most // 2]
        flat, _ = runs(self.at[keep], self.count[keep])
        old = self.ids[flat], self.key[:, keep], self.length[keep], self.hash[keep], self.count[keep].astype(np.int64)
        self._clear()
        self.n, self.used = len(keep), len(flat)
        self.ids[: self.used], self.key[:, : self.n], self.length[: self.n], self.hash[: self.n], self.count[: self.n] = old
        self.at[: self.n] = np.cumsum(old[-1]) - old[-1]
        self.place(0)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with END after it, and the n+1 offsets of the texts in them."""
        odd = {i: self.raw([t.decode()])[0] for i, t in enumerate(texts) if b"<|" in t}  # special tokens have marks within
        data, starts, ends, plain = pieces([b"" if i in odd else t for i, t in enumerate(texts)])
        key, length, h = keys(data, starts, ends)
        short = length <= PIECE_BYTES
        entry = np.full(len(h), -1, np.int64)
        entry[short] = self.find(key[:, short], length[short], h[short])
        self.again[entry[entry >= 0]] = True
        new = np.flatnonzero(short & (entry < 0))
        _, first, of = np.unique(h[new], return_index=True, return_inverse=True)
        fresh = new[first]
        if self.n + len(fresh) > self.most:
            self.make_room()
            entry[short] = self.find(key[:, short], length[short], h[short])
            new = np.flatnonzero(short & (entry < 0))
            _, first, of = np.unique(h[new], return_index=True, return_inverse=True)
            fresh = new[first]
        buf = data.tobytes()
        said = lambda at: [buf[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if len(fresh) and self.n + len(fresh) <= self.most:
            made = self.learn(lambda k: said(fresh[k]), plain[fresh], key[:, fresh], length[fresh], h[fresh])
            same = (length[new] == length[fresh[of]]) & (key[:, new] == key[:, fresh[of]]).all(0)
            entry[new[same]] = made[of[same]]
            self.again[made[np.bincount(of) > 1]] = True
        alone = np.flatnonzero(entry < 0)  # too long, or more than the memo holds
        known = np.flatnonzero(entry >= 0)
        own = self.raw(said(alone))
        count = np.zeros(len(entry), np.int64)
        count[known], count[alone] = self.count[entry[known]], [len(x) for x in own]
        bounds = np.cumsum([0] + [len(t) + 1 if i not in odd else 1 for i, t in enumerate(texts)])
        doc = np.searchsorted(bounds, starts, "right") - 1
        tokens = np.bincount(doc, count, len(texts)).astype(np.int64) + 1
        for i, x in odd.items():
            tokens[i] += len(x)
        offsets = np.concatenate(([0], np.cumsum(tokens)))
        ahead = np.cumsum(count) - count  # ids of texts taken whole come in between, and an END after each text
        extra = np.cumsum([0] + [1 + len(odd.get(i, ())) for i in range(len(texts))])
        to = ahead + extra[doc]
        out = np.empty(int(offsets[-1]), np.uint32)
        out[offsets[1:] - 1] = END
        flat, _ = runs(self.at[entry[known]], count[known])
        out[runs(to[known], count[known])[0]] = self.ids[flat]
        for a, x in zip(to[alone].tolist(), own, strict=True):
            out[a : a + len(x)] = x
        for i, x in odd.items():
            out[offsets[i] : offsets[i] + len(x)] = x
        return out, offsets


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, bin, offset) of documents no longer than capacity; every bin is filled."""
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(total.bit_length(), -1, -1) if (total % capacity) >> b & 1]
    room, cost, used = np.array(sizes, np.int64), np.zeros(len(sizes)), [0] * len(sizes)
    out = []
    for doc in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[doc]
        while left:
            fits = room >= left
            to = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            n = min(left, int(room[to]))
            out.append((doc, start, n, to, used[to]))
            room[to] -= n
            used[to] += n
            cost[to] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (SCHEMA); with_ids adds each piece's token ids."""
    path = vocabulary or default_vocabulary()
    docs = docs.select("doc_id", "text")

    def rows(pool: list, next_id: int) -> tuple[pa.RecordBatch, int]:
        """pool: (doc_id, ids). The record batch of its pieces, and the next free sequence number."""
        pieces, rest = [], []
        for k, (_, ids) in enumerate(pool):
            n = len(ids)
            whole = n - n % capacity
            for start in range(0, whole, capacity):
                pieces.append((k, start, capacity, next_id, 0))
                next_id += 1
            rest.append(n - whole)
        cut = assign(rest, capacity)
        for k, start, n, to, offset in cut:
            pieces.append((k, len(pool[k][1]) - rest[k] + start, n, next_id + to, offset))
        next_id += 1 + max((p[3] for p in cut), default=-1)
        parts = [pool[k][1][s : s + n] for k, s, n, _, _ in pieces]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        arrays = [
            pa.array([pool[p[0]][0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
            pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array([len(pool[p[0]][1]) for p in pieces], pa.int64()),
            pa.array([p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64()),
        ]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names), next_id

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = PieceIds.of(path)
        next_id, pool, tokens = TaskContext.get().partitionId() << 40, [], 0
        for batch, texts in text_chunks(batches):
            ids, offsets = ids_of(texts)
            for doc_id, a, b in zip(col(batch, "doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                pool.append((doc_id, ids[a:b]))
                tokens += b - a
                if tokens >= POOL_TOKENS:
                    out, next_id = rows(pool, next_id)
                    yield out
                    pool, tokens = [], 0
        if pool:
            yield rows(pool, next_id)[0]

    return docs.mapInArrow(apply, SCHEMA + (", ids array<int>" if with_ids else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
