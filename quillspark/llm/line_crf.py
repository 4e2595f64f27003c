"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Emission features are shares of character and word classes of the line and of the lines
before and after it; transitions between the two states are learned too. Lines take their document's label in training
(numpy, Adam, exact gradients from forward-backward). A document's raw quality is the mean of its lines' marginals of
being good, weighted by their lengths; it is then stretched piecewise linearly so that the cut of least error on the
training sample lies at THRESHOLD.

Cases: a text without a word has score 0. No labelled row of either class: every score is 0.5. A null id is kept, with
held_out false, and not learned from. Of contradicting labels the smallest counts. Repeated rows give repeated rows.
Extra columns are ignored in scores and kept in `accepted`. Empty tables: no row. Very long texts are one chain, whole; the
work is in proportion to the lines, the memory some hundred times the text. A score of just THRESHOLD is accepted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, by_owner, fold, span_hashes, stored, table, text_chunks, unit_hash, words_of

THRESHOLD = 0.7
#: Bounds of the training sample: documents of a class, characters of a document on average. Whole texts are taken as
#: long as they fit, then of the longest ones a run of lines at a hashed place.
DOCS_PER_CLASS, CHARS_PER_DOC = 800, 12_000


def _class(*chars: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL = _class(*b"#*$%&<>")
BANG, PIPE, DIGIT, STOP = _class(*b"!?"), _class(*b"|"), _class(*b"0123456789"), _class(*b".,;:")
UPPER, LOWER_CASE, HIGH = _class(*range(65, 91)), _class(*range(97, 123)), _class(*range(128, 256))


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines: the text each is of, its length in bytes, its features with those of its neighbours."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    size = ends - starts

    def count(mask):
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[ends] - total[starts]).astype(float)

    of = lambda table: count(table[data])
    solid = np.maximum(count(~SPACE[data]), 1)
    upper2 = np.zeros(len(data), bool)
    upper2[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = of(UPPER) + count(upper2)
    letters = np.maximum(of(UPPER) + of(LOWER_CASE) + of(HIGH) / 2, 1)
    w0, w1, _, _ = words_of(texts, lower=False)
    h = span_hashes(data, w0, w1)
    line = np.searchsorted(ends, w0)
    n = np.bincount(line, minlength=len(ends)).astype(float)
    words = np.maximum(n, 1)
    same = np.zeros(len(ends))
    for lag in (1, 2, 3, 4):
        if len(h) > lag:
            hit = (h[lag:] == h[:-lag]) & (line[lag:] == line[:-lag])
            same += np.bincount(line[lag:][hit], minlength=len(ends))
    at = by_owner(line, h)
    fresh = np.concatenate((np.ones(min(1, len(h)), bool), (line[at][1:] != line[at][:-1]) | (h[at][1:] != h[at][:-1])))
    distinct = np.bincount(line[at][fresh], minlength=len(ends))
    lh = span_hashes(data, starts, ends)
    order = np.lexsort((np.arange(len(lh)), lh, doc))
    dup = np.zeros(len(lh), bool)
    dup[order[1:]] = (doc[order][1:] == doc[order][:-1]) & (lh[order][1:] == lh[order][:-1])
    own = np.stack(
        [of(SYMBOL) / solid, of(BANG) / solid, of(PIPE) / words, upper / letters, of(DIGIT) / solid, of(STOP) / words, np.minimum(same / words, 2), 1 - distinct / words, dup & (n > 0), solid / words / 10, np.log1p(n) / 5, n == 0, of(HIGH) / solid],
        1,
    )
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    last = np.concatenate((doc[1:] != doc[:-1], [True]))
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    x = np.concatenate((own, before, after, np.stack([first, last, np.ones(len(own), bool)], 1)), 1)
    return doc, size, x


def in_turns(texts: list[bytes], limit: int = 1 << 20):
    """Runs of texts of about `limit` bytes: where each begins, and its texts."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size + len(t) > limit and i > lo:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, texts[lo:]


def all_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text that each line is of, and the lines' features, of a training sample."""
    parts = [(lo + doc, x) for lo, some in in_turns(texts) for doc, _, x in [line_features(some)]]
    return np.concatenate([d for d, _ in parts]), np.concatenate([x for _, x in parts])


def marginals(emit: np.ndarray, trans: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """emit: scores of `good`, documents x lines (padded); trans: 2 x 2; count: lines of each document. P(good) of each
    line, and the summed expectations of the transitions of each document (documents x 2 x 2)."""
    b, t = emit.shape
    zero = np.zeros_like(emit)
    e = np.stack([zero, emit], 2)
    live = np.arange(t)[None] < count[:, None]
    alpha, beta = np.zeros((b, t, 2)), np.zeros((b, t, 2))
    alpha[:, 0] = e[:, 0]
    for i in range(1, t):
        alpha[:, i] = np.where(live[:, i, None], np.logaddexp(alpha[:, i - 1, :1] + trans[0], alpha[:, i - 1, 1:] + trans[1]) + e[:, i], alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        v = e[:, i + 1] + beta[:, i + 1]
        beta[:, i] = np.where(live[:, i + 1, None], np.logaddexp(trans[:, 0] + v[:, :1], trans[:, 1] + v[:, 1:]), 0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    good = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - total[:, None], 0))
    edge = np.zeros((b, 2, 2))
    if t > 1:
        v = e[:, 1:] + beta[:, 1:]
        p = np.exp(np.minimum(alpha[:, :-1, :, None] + trans[None, None] + v[:, :, None] - total[:, None, None, None], 0))
        edge = (p * live[:, 1:, None, None]).sum(1)
    return good, edge


def padded(doc: np.ndarray, values: np.ndarray, most: int = 1 << 17):
    """Blocks of documents of similar line counts: (documents, their line counts, values padded, rows of the lines)."""
    count = np.bincount(doc)
    first = np.cumsum(count) - count
    order = np.argsort(count, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * count[order[hi]] <= most and count[order[hi]] <= 2 * count[order[lo]] + 4:
            hi += 1
        docs = order[lo:hi]
        c = count[docs]
        at = first[docs][:, None] + np.minimum(np.arange(c.max())[None], c[:, None] - 1)
        yield docs, c, values[at], at
        lo = hi


@dataclass
class LineCrf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    cut: float = 0.5

    def raw(self, texts: list[bytes]) -> np.ndarray:
        doc, size, x = line_features(texts)
        emit = ((x - self.mean) / self.scale) @ self.weights
        out = np.zeros(len(texts))
        for docs, c, e, at in padded(doc, emit):
            good, _ = marginals(e, self.trans, c)
            w = np.where(np.arange(e.shape[1])[None] < c[:, None], size[at], 0)
            out[docs] = (good * w).sum(1) / np.maximum(w.sum(1), 1)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        m = self.raw(texts)
        out = np.where(m < self.cut, THRESHOLD * m / self.cut, THRESHOLD + (1 - THRESHOLD) * (m - self.cut) / max(1 - self.cut, 1e-9))
        return np.where([not t.strip() for t in texts], 0.0, np.clip(out, 0, 1))


def train(texts: list[bytes], labels: list[int], prior: float, steps: int = 150, rate: float = 0.08) -> LineCrf:
    """prior: the share of label 1 where the cut of least error is sought."""
    y = np.array(labels)
    doc, x = all_features(texts)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    z = (x - mean) / scale
    del x
    blocks = [(docs, c, e, at, np.arange(e.shape[1])[None] < c[:, None]) for docs, c, e, at in padded(doc, np.zeros(len(z)))]
    w, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    params = [w, trans]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        emit = z @ w
        gw, gt = 1e-3 * w, 1e-3 * trans
        for docs, c, _, at, live in blocks:
            good, edge = marginals(emit[at], trans, c)
            share = 1 / c / len(texts)
            d = (good - y[docs][:, None]) * live * share[:, None]
            gw = gw + d[live] @ z[at[live]]
            seen = np.zeros_like(edge)
            seen[np.arange(len(docs)), y[docs], y[docs]] = c - 1
            gt = gt + ((edge - seen) * share[:, None, None]).sum(0)
        for p, g, mm, vv in zip(params, (gw, gt), m, v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.001 * (g * g - vv)
            p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    model = LineCrf(mean, scale, w, trans)
    raw = np.concatenate([model.raw(some) for _, some in in_turns(texts)])
    bad, good = np.sort(raw[y == 0]), np.sort(raw[y == 1])
    cuts = np.unique(np.concatenate((raw, [0.5])))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    error = prior * np.searchsorted(good, cuts) / len(good) + (1 - prior) * (1 - np.searchsorted(bad, cuts) / len(bad))
    model.cut = float(np.clip(cuts[np.flatnonzero(error <= error.min() + 1e-12)].mean(), 1e-3, 1 - 1e-3))
    return model


def longest_run(lengths: list[int]) -> int:
    """The most characters to take of each text so that all come to CHARS_PER_DOC a text at most."""
    left = CHARS_PER_DOC * len(lengths)
    for k, n in enumerate(sorted(lengths)):
        if n > left // (len(lengths) - k):
            return left // (len(lengths) - k)
        left -= n
    return max([*lengths, 1])


def whole_lines(text: str, before: bool, after: bool) -> str:
    """A run without the broken lines at its ends, where text stands before or after it; a part of one line as it is."""
    inner = text[text.find("\n") + 1 if before else 0 :]
    inner = inner[: inner.rfind("\n")] if after and "\n" in inner else inner
    return inner if inner.strip() else text


def fit(docs: DataFrame, labels: DataFrame) -> LineCrf | None:
    """Learn from rows (doc_id, text) of docs and (doc_id, quality) of labels."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("quality") == 1, 1.2 * DOCS_PER_CLASS / counts[1]).otherwise(1.2 * DOCS_PER_CLASS / counts[0])
    unit = unit_hash("doc_id", salt="quality")
    ids = known.where(unit < share).orderBy(unit, "doc_id").limit(4 * DOCS_PER_CLASS)
    part = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    once = part.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # ids: 4 * DOCS_PER_CLASS at most
    sample = stored(once, "quality")
    longest = longest_run([r[0] for r in sample.select(F.length("text")).collect()])
    before = F.floor(unit_hash("doc_id", salt="where") * F.greatest(F.lit(0), F.length("text") - longest)).cast("int")
    after = F.length("text") > before + longest
    runs = sample.select("doc_id", F.substring(F.col("text"), before + 1, F.lit(longest)).alias("text"), "quality", (before > 0).alias("before"), after.alias("after"))
    rows = sorted((r["doc_id"], whole_lines(r["text"], r["before"], r["after"]), r["quality"]) for r in runs.collect())  # CHARS_PER_DOC a row
    picked = [r for k in (0, 1) for r in [r for r in rows if r[2] == k][:DOCS_PER_CLASS]]
    if len({r[2] for r in picked}) < 2:
        return None
    return train([t.encode() for _, t, _ in picked], [q for _, _, q in picked], counts[1] / sum(counts.values()))


def score(docs: DataFrame, model: LineCrf | None) -> DataFrame:
    """doc_id and score of every row of docs."""
    docs = docs.select("doc_id", "text")
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))

    def apply(batches):
        for batch, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(texts))], ["doc_id", "score"])

    return docs.mapInArrow(apply, "doc_id long, score double")


def accepted(docs: DataFrame, model: LineCrf | None) -> DataFrame:
    """The rows of docs, all columns, that score THRESHOLD or more; all of them without a model."""
    if model is None:
        return docs

    def apply(batches):
        for batch, texts in text_chunks(batches):
            yield batch.filter(pa.array(model.score(texts) >= THRESHOLD))

    return docs.mapInArrow(apply, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    learn = fold("doc_id", 4) != 2
    model = fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
