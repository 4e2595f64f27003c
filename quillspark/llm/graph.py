"""Connected components of an edge table, by contraction in rounds; nothing but counts reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and for each the smallest node it is connected with."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return nodes, nodes[root]
        root = new


#: Edges that one task may finish: 16 bytes each, and some ten times that while it does.
LAST = 200_000


def finished(edges: DataFrame) -> DataFrame:
    """node, to: what every node of a table of LAST edges at most ends at."""

    def apply(batches):
        parts = [[b.column(k).to_numpy() for k in (0, 1)] for b in batches]
        nodes, roots = local_roots(*[np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "to"])

    return edges.coalesce(1).mapInArrow(apply, "node long, to long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: (a, b), longs. (node, root) of every node. In each round every node points at the one of smallest hash
    among its neighbours and itself, and edges move to what their ends point at. In even rounds the number itself is the
    hash, which ends a star around its smallest node at once; in odd rounds a fresh hash makes the number of nodes fall
    by a constant factor whatever the graph. Degrees only meet partial aggregates and joins that adaptive execution can
    split. Once LAST edges or fewer are left, one task ends the rounds."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    pointers: list[DataFrame] = []
    for k in range(most_rounds):
        left = edges.count()  # from the files' footers
        if not left:
            break
        if left <= LAST:
            pointers.append(stored(finished(edges), "pointers"))
            break
        rank = lambda c, k=k: F.xxhash64(F.lit(k), c) if k % 2 else F.col(c)
        pair = lambda u, v, rank=rank: edges.select(F.col(u).alias("node"), F.struct(rank(v).alias("h"), F.col(v).alias("to")).alias("p"))
        best = pair("a", "b").unionByName(pair("b", "a")).groupBy("node").agg(F.min("p").alias("p"))
        own = F.struct(rank("node").alias("h"), F.col("node").alias("to"))
        step = stored(best.select("node", F.least("p", own)["to"].alias("to")), "pointers")
        pointers.append(step)
        moved = edges.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        edges, old = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"), edges
        discard(old)
    else:
        raise RuntimeError("components did not converge")
    spark = edges.sparkSession
    if not pointers:
        return spark.createDataFrame([], "node long, root long")
    root = pointers[-1].toDF("node", "root")
    for step in reversed(pointers[:-1]):  # what a node points at has a root of its own, or is one
        later = root.toDF("to", "later")
        root = step.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("root"))
    # a root that points nowhere in later rounds is its own
    out = stored(root, "roots")
    discard(edges, *pointers)
    return out
