"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, labelled or not, is the unlabelled set. A
linear classifier over the presence of words and word beginnings is trained in numpy under the risk
    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)),
and where the second term falls below zero its gradient is turned round. The prior is the share of toxic among the
labelled rows of the learning fold; labels of clean documents serve for that count alone. Tasks read the sampled texts
whole, count their features and send the driver the chosen ones' places alone.

Cases: null or empty text: the score of a text without any feature. No confirmed toxic row, or no feature that tells
them: every score is 0. A null id
is kept, with held_out false, and not learned from. Repeated rows give repeated rows (an id is learned from once); of
contradicting labels the largest counts. Extra columns are ignored. Very long texts are read whole. Ties in excess go by
the feature, in score by nothing: predicted is 1 from 0.5 on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, discard, fold, mix64, shingles, stored, table, text_chunks, unit_hash

#: Bounds of the training sample, and of the features: those in a hundredth of the positives at least and more frequent
#: there than in unlabelled texts at LEVEL, corrected for the number of features; of these FEATURES of the largest excess.
POSITIVES, UNLABELLED, FEATURES, LEVEL = 2000, 8000, 3000, 0.05
STEM = 5
#: Of 12 min-hashes, those that near copies have in common: a Jaccard similarity of about two thirds.
ALIKE = 8
#: ASCII letters lowered; digits and all bytes of other letters kept; the rest parts words.
WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def features(text: bytes) -> set[bytes]:
    """Its words, and the beginnings of those longer than STEM bytes marked with a star."""
    words = set(text.translate(WORDS).split())
    words.update([b"*" + w[:STEM] for w in words if len(w) > STEM])
    return words


@dataclass
class PuModel:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: bytes) -> float:
        words = set(text.translate(WORDS).split())
        get, total = self.weights.get, self.bias
        for w in words & self.weights.keys():
            total += get(w)
        for w in {b"*" + w[:STEM] for w in words if len(w) > STEM} & self.weights.keys():
            total += get(w)
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The two terms of the risk under logistic loss at weights w (bias last), and the gradient to follow: that of their
    sum, or, where the second term is negative, that term's own turned round. p, u: rows of positives and unlabelled."""
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    first = prior * np.logaddexp(0, -zp).mean()
    second = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    of_first, of_second_p, of_second_u = -prior * sigmoid(-zp) / len(zp), -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    dp, du = (of_first + of_second_p, of_second_u) if second >= 0 else (-of_second_p, -of_second_u)
    return float(first), float(second), np.append(dp @ p + du @ u, dp.sum() + du.sum())


def train(xp: np.ndarray, xu: np.ndarray, names: list[bytes], prior: float, epochs: int = 60, batch: int = 2000, rate: float = 0.01, seed: int = 1) -> PuModel:
    """xp, xu: which texts (positives, unlabelled) have which of the named features, as booleans."""
    rng = np.random.default_rng(seed)
    w, m, v, step = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1), 0
    for _ in range(epochs):
        order = rng.permutation(len(xu))
        for lo in range(0, len(xu), batch):
            p = xp[rng.integers(0, len(xp), min(batch, len(xp)))].astype(np.float32)
            u = xu[order[lo : lo + batch]].astype(np.float32)
            _, _, g = gradient(w, p, u, prior)
            g[:-1] += 1e-5 * w[:-1]
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            np.maximum(w[:-1], 0, out=w[:-1])  # features are chosen for being signs of toxicity, so none speaks against it
    # the cut of least zero-one risk under the same estimator, without negatives, becomes 0
    scores = lambda x: np.sort(np.concatenate([x[lo : lo + batch].astype(np.float32) @ w[:-1] + w[-1] for lo in range(0, len(x), batch)]))
    zp, zu = scores(xp), scores(xu)
    cuts = np.unique(np.concatenate((zp, zu)))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    hit, alarm = 1 - np.searchsorted(zp, cuts) / len(zp), 1 - np.searchsorted(zu, cuts) / len(zu)
    risk = prior * (1 - hit) + np.maximum(0, alarm - prior * hit)
    cut = float(cuts[np.flatnonzero(risk <= risk.min() + 1e-12)].mean())
    return PuModel({k: float(x) for k, x in zip(names, w, strict=False) if abs(x) > 1e-3}, float(w[-1]) - cut)


def min_hashes(text: bytes) -> bytes:
    """12 of a text's five-word shingles; empty where it has none."""
    h, _ = shingles([text])
    return np.array([mix64(h + np.uint64(k + 1)).min() for k in range(12)]).tobytes() if len(h) else b""


def distinct(hashes: list[bytes]) -> list[int]:
    """The places of a sample's texts with which no earlier one shares ALIKE or more of its min-hashes."""
    out, seen, n = [], np.zeros((len(hashes), 12), np.uint64), 0
    for i, x in enumerate(hashes):
        if x:
            seen[n] = np.frombuffer(x, np.uint64)
            if ((seen[:n] == seen[n]).sum(1) >= ALIKE).any():
                continue
            n += 1
        out.append(i)
    return out


def sampled(rows: DataFrame, most: int, of: int, salt: str) -> DataFrame:
    """doc_id, text of `most` ids, those of smallest hash. Of an id that occurs more than once one row counts."""
    unit = unit_hash("doc_id", salt=salt)
    some = rows.where(unit < 1.2 * most / max(of, 1) + 1e-9)
    ids = some.select("doc_id", unit.alias("u")).distinct().orderBy("u", "doc_id").limit(most).collect()  # most at most
    return some.where(unit <= (ids[-1]["u"] if ids else -1.0)).groupBy("doc_id").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> PuModel | None:
    """Learn from rows (doc_id, text) of docs and (doc_id, toxic) of labels."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    every = docs.where("doc_id is not null").count()
    if not toxic or not every:
        return None
    part = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    unit = unit_hash("doc_id", salt="toxic")
    ids = known.where("toxic = 1").where(unit < 1.2 * POSITIVES / toxic + 1e-9).orderBy(unit, "doc_id").select("doc_id").limit(2 * POSITIVES)
    positive = sampled(part.join(F.broadcast(ids), "doc_id", "left_semi"), POSITIVES, toxic, "toxic")
    sample = stored(positive.withColumn("toxic", F.lit(True)).unionByName(sampled(part, UNLABELLED, every, "unlabelled").withColumn("toxic", F.lit(False))), "toxicity")

    def signed(batches):
        for batch, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), col(batch, "toxic"), pa.array([min_hashes(t) for t in texts], pa.binary())], ["doc_id", "toxic", "hashes"])

    # near copies would make a document's own words look like signs of its class
    rows = sorted(sample.mapInArrow(signed, "doc_id long, toxic boolean, hashes binary").collect())  # 100 bytes a text
    kept = {side: {own[i]["doc_id"] for i in distinct([r["hashes"] for r in own])} for side in (True, False) for own in [[r for r in rows if r["toxic"] == side]]}
    n_pos, n_unl = len(kept[True]), len(kept[False])
    if not n_pos or not n_unl:
        return None

    def chosen_texts(batches):
        for batch, texts in text_chunks(batches):
            for doc_id, side, t in zip(col(batch, "doc_id").to_pylist(), col(batch, "toxic").to_pylist(), texts, strict=True):
                if doc_id in kept[side]:
                    yield side, t

    def count(batches):
        seen: dict[bytes, list[int]] = {}
        for side, t in chosen_texts(batches):
            for w in features(t):
                seen.setdefault(w, [0, 0])[side] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *[pa.array([c[k] for c in seen.values()], pa.int64()) for k in (0, 1)]], ["feature", "unlabelled", "positive"])

    counts = sample.mapInArrow(count, "feature binary, unlabelled long, positive long").groupBy("feature").agg(F.sum("positive").alias("p"), F.sum("unlabelled").alias("u"))
    counts = stored(counts.where("p > 0").withColumn("usual", (F.col("u") + 1) * (n_pos / n_unl)), "features")
    # Chernoff's bound of a Poisson count this far over the usual one, against all features at once
    excess = F.col("p") * F.log(F.col("p") / F.col("usual")) - F.col("p") + F.col("usual")
    signs = counts.where((F.col("p") >= 0.01 * n_pos) & (F.col("p") > F.col("usual")) & (excess >= math.log(max(1, counts.count()) / LEVEL)))
    names = [bytes(r["feature"]) for r in signs.orderBy(excess.desc(), "feature").limit(FEATURES).collect()]
    if not names:
        return None
    index = {w: i for i, w in enumerate(names)}

    def places(batches):
        own = [(side, np.array(sorted(index[w] for w in features(t) & index.keys()), np.uint16).tobytes()) for side, t in chosen_texts(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.bool_()), pa.array([x[1] for x in own], pa.binary())], ["toxic", "at"])

    matrix = {True: np.zeros((n_pos, len(names)), bool), False: np.zeros((n_unl, len(names)), bool)}
    at = {True: 0, False: 0}
    for r in sorted(sample.mapInArrow(places, "toxic boolean, at binary").collect()):  # two bytes a feature of a text
        matrix[r["toxic"]][at[r["toxic"]], np.frombuffer(r["at"], np.uint16)] = True
        at[r["toxic"]] += 1
    discard(sample, counts)
    return train(matrix[True], matrix[False], names, toxic / n)


def score(docs: DataFrame, model: PuModel | None) -> DataFrame:
    """doc_id and score of every row of docs."""
    docs = docs.select("doc_id", "text")
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))

    def apply(batches):
        for batch, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in texts], pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(apply, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    learn = fold("doc_id", 5) != 0
    model = fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
