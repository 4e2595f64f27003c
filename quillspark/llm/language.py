"""Language identification by a byte convolutional network.

Bytes are folded into 64 classes. Filters of 2, 3 and 4 classes slide over fixed-length windows of the whole text,
each filter's largest response in a window is its feature, and a softmax layer gives the window's log-probabilities.
A text's prediction is the length-weighted mean over its windows. Training is plain numpy (Adam) on a bounded sample;
for prediction the filters are unrolled into lookup tables, so a window costs four gathers a byte.

Cases: null text or no letter: `und`, score 0. No labelled row at all: every text is `und`, score 0. A null id is kept,
with held_out false, and not learned from. Repeated rows give repeated rows; extra columns are ignored. Empty tables: no
row. Very long texts are read whole, BLOCK windows at a time. Of equal scores the language that sorts first wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fold, table, text_chunks, unit_hash

WINDOW = 256
FILTERS = 20
WIDTHS = (2, 3, 4)
#: Bounds of the training sample: documents of a language, windows of a document.
DOCS_PER_LANG, WINDOWS_PER_DOC = 500, 4
UNKNOWN = "und"
#: Windows that are worked on at once; a text of many is taken in several turns.
BLOCK = 2048


def byte_classes() -> np.ndarray:
    """0 padding and NUL; 1-26 letters; 27 white space; 28 digits; 29 other ASCII; 30, 31 lead bytes; 32-63 continuation bytes, whose lowest five bits fold upper and lower case of Latin letters."""
    out = np.full(256, 29, np.uint8)
    out[0] = 0
    out[[9, 10, 11, 12, 13, 32]] = 27
    out[48:58] = 28
    for i in range(26):
        out[65 + i] = out[97 + i] = 1 + i
    out[0x80:0xC0] = 32 + (np.arange(0x80, 0xC0) & 31)
    out[0xC0:] = 31
    out[0xC2:0xC4] = 30
    return out


CLASSES = byte_classes()


@dataclass
class ByteCnn:
    langs: list[str]
    filters: list[np.ndarray]  # of each width: width x 64 x FILTERS
    dense: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """Responses to every pair, triple, and first and second half of four."""
        two, three, four = self.filters
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        return [pair(two[0], two[1]), pair(pair(three[0], three[1]), three[2]), pair(four[0], four[1]), pair(four[2], four[3])]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts, each padded to whole windows with three zeros at least; the text that each window is of."""
    parts, counts = [], []
    for t in texts:
        k = -(-(len(t) + 3) // WINDOW)
        parts += [t, bytes(k * WINDOW - len(t))]
        counts.append(k)
    return CLASSES[np.frombuffer(b"".join(parts), np.uint8)], np.repeat(np.arange(len(texts)), counts)


def pooled(tables: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each window, for BLOCK windows at a time."""
    c = np.concatenate((classes, np.zeros(3, np.uint8)))
    n, size = len(classes), BLOCK * WINDOW
    out = np.empty((n // WINDOW, len(WIDTHS), FILTERS), np.float32)
    for lo in range(0, n, size):
        out[lo // WINDOW : (lo + size) // WINDOW] = _pooled(tables, c[lo : min(lo + size, n) + 3])
    return out.reshape(len(out), -1)


def _pooled(tables: list[np.ndarray], c: np.ndarray) -> np.ndarray:
    n = len(c) - 3
    two = c[:-1].astype(np.uint16) * np.uint16(64) + c[1:]
    three = (two[:n].astype(np.int32) * 64 + c[2 : n + 2]).reshape(-1, WINDOW).T
    first, second = two[:n].reshape(-1, WINDOW).T, two[2:].reshape(-1, WINDOW).T
    out = np.full((3, n // WINDOW, FILTERS), -1e9, np.float32)
    for j in range(WINDOW):
        np.maximum(out[0], tables[0].take(first[j], axis=0), out=out[0])
        np.maximum(out[1], tables[1].take(three[j], axis=0), out=out[1])
        wide = tables[2].take(first[j], axis=0)
        wide += tables[3].take(second[j], axis=0)
        np.maximum(out[2], wide, out=out[2])
    return np.maximum(out, 0).transpose(1, 0, 2)


def drawn(text: bytes, seed: int) -> list[bytes]:
    """WINDOWS_PER_DOC stretches from anywhere in a text; some are short, so that short texts are learned as well."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(WINDOWS_PER_DOC):
        size = int(rng.choice([WINDOW - 3, WINDOW - 3, 120, 40, 14]))
        at = int(rng.integers(0, max(1, len(text) - size + 1)))
        out.append(text[at : at + size])
    return out


def train(stretches: list[bytes], labels: list[str], epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 1) -> ByteCnn:
    """stretches: of WINDOW - 3 bytes at most."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    index = {x: i for i, x in enumerate(langs)}
    x = np.array([CLASSES[np.frombuffer(t.ljust(WINDOW, b"\0"), np.uint8)] for t in stretches], np.int64)
    y = np.array([index[lang] for lang in labels])
    share = np.bincount(y, minlength=len(langs))
    weight = (len(y) / np.maximum(share, 1) / len(langs))[y]
    params = [rng.normal(0, 0.1, (w, 64, FILTERS)) for w in WIDTHS] + [rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), np.zeros(len(langs))]
    mean, var, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            at = order[lo : lo + batch]
            c = np.pad(x[at], ((0, 0), (0, 3)))
            best, peaks = [], []
            for w, f in zip(WIDTHS, params, strict=False):
                r = sum(f[k][c[:, k : k + WINDOW]] for k in range(w))
                peak = r.argmax(1)
                peaks.append(peak)
                best.append(np.take_along_axis(r, peak[:, None], 1)[:, 0])
            h = np.concatenate(best, 1)
            on = np.maximum(h, 0)
            z = on @ params[3] + params[4]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p *= weight[at, None] / len(at)
            back = (p @ params[3].T) * (h > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g, mine = np.zeros_like(params[i]), back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    np.add.at(g[k], (c[np.arange(len(at))[:, None], peaks[i] + k], np.arange(FILTERS)[None]), mine)
                grads.append(g)
            grads += [on.T @ p, p.sum(0)]
            step += 1
            for q, g, m, v in zip(params, grads, mean, var, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(langs, [p.astype(np.float32) for p in params[:3]], params[3].astype(np.float32), params[4].astype(np.float32))


def fit(labelled: DataFrame) -> ByteCnn | None:
    """Learn from rows (doc_id, text, lang). Counts cover all rows; the sample is some DOCS_PER_LANG documents of each
    language, by a hash of their ids, and WINDOWS_PER_DOC stretches of each, drawn in the tasks from its whole text. An id
    that occurs more than once is learned from once."""
    rows = labelled.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, DOCS_PER_LANG / r["count"]))])
    picked = rows.where(unit_hash("doc_id", salt="language") <= share[F.col("lang")])

    def draw(batches):
        for batch, texts in text_chunks(batches):
            ids = col(batch, "doc_id").to_pylist()
            own = [drawn(t, i & (1 << 63) - 1) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), col(batch, "lang"), pa.array(own, pa.list_(pa.binary()))], ["doc_id", "lang", "own"])

    stretches = picked.mapInArrow(draw, "doc_id long, lang string, own array<binary>").groupBy("lang", "doc_id").agg(F.min("own").alias("own"))
    sample = sorted((r["lang"], r["doc_id"], [bytes(t) for t in r["own"]]) for r in stretches.collect())
    return train([t for _, _, own in sample for t in own], [lang for lang, _, own in sample for _ in own])


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs."""
    docs = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    langs = np.array([*model.langs, UNKNOWN], object)

    def apply(batches):
        tables = model.tables()
        for batch, texts in text_chunks(batches, 1 << 20, WINDOW):
            classes, doc = windows(texts)
            z = pooled(tables, classes) @ model.dense + model.bias
            z -= z.max(1, keepdims=True)
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            size = (classes.reshape(-1, WINDOW) != 0).sum(1) + 1e-3
            total = np.bincount(doc, size, len(texts))
            mean = np.stack([np.bincount(doc, z[:, k] * size, len(texts)) / total for k in range(z.shape[1])], 1)
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            empty = np.array([not t for t in texts])
            best = np.where(empty, len(model.langs), p.argmax(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs[best], pa.string()), pa.array(np.where(empty, 0.0, p.max(1)).astype(float))], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(apply, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
