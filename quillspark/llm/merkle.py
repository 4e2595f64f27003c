"""Merkle manifest of a dataset: leaf, root and proof of every row, and roots folded anew from tampered leaves.

Bottom up: leaves are placed by source and doc_id (range files; no task ranks a source), and each level is grouped by
(source, place div WAY) into its parents, which are written with the digests of their children. The top node of each
source is a leaf of a tree over the sources, in order of their names, which is built in the same way. Top down: the
written levels are joined to their parents by (source, place div WAY); each child puts the digests of its siblings before
the proof that it inherits. A node has WAY children at most and a key its children alone, so a source that holds most rows
spreads like any other. Texts are read once, in the pass that hashes the leaves; digests travel as 32 bytes, and only
sha256's inputs are hex. A proof grows with the logarithm of the rows.

The fold starts from the tampered leaf and takes the siblings out of the proof, level by level: the number of siblings
and the place among them follow from the row's place and its source's rows.

Cases: nulls are `-` in a leaf. Rows without doc_id come first and are never tampered with; rows of equal source and
doc_id are placed by their leaves, so repeated rows have places and proofs of their own and a row of the result each. Rows
without source are a source of their own, the first; an empty source is another one, after it. A single row of a source is
its subroot, a single source's subroot the root. Empty and very long texts are hashed whole. Empty table: no row. Extra
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import with_counter
from .common import CRC_SQL, crc_sql, fold, stored, table

WAY, SIZE = 3, 32  # children of a node, bytes of a digest


def digest(data: Column) -> Column:
    """sha256 of the lowercase hex text of some bytes, as bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(data)), 256))


def field(c: Column) -> Column:
    said = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256))


def tampered(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))


def forest(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The levels over nodes (grp, pos, n, node), where n is the group's nodes and `most` the largest n: of every group
    the parents of its nodes, with `kids`, until it has one node."""
    levels = []
    while most > 1:
        kids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"])  # WAY at most
        up = nodes.where("n > 1").groupBy("grp", F.floor(F.col("pos") / WAY).alias("pos")).agg(F.ceil(F.max("n") / WAY).alias("n"), kids.alias("kids"))
        nodes = stored(up.withColumn("node", digest(joined(F.col("kids")))), "level")
        levels.append(nodes)
        most = -(-most // WAY)
    return levels


def pushed(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children (grp, pos, ...) with `proof` and what else the parents (grp, pos, kids, proof, ...) carry: siblings, then
    the proof of the parent."""
    up = parents.withColumnsRenamed({"grp": "_grp", "pos": "_pos", "kids": "_kids", "proof": "_proof"})
    both = children.join(up, (F.col("grp") == F.col("_grp")) & (F.floor(F.col("pos") / WAY) == F.col("_pos")))
    siblings = F.filter("_kids", lambda x, i: i != F.col("pos") % WAY)
    return both.withColumn("proof", F.concat(joined(siblings), F.col("_proof"))).drop("_grp", "_pos", "_kids", "_proof")


def folded(node: Column, proof: Column, pos: Column, n: Column, levels: int) -> Column:
    """struct(node, at): the root of a tree of n leaves by the leaf at pos and the siblings at the proof's beginning, and
    how many bytes of it these are."""

    def step(acc, _):
        first = acc["pos"] - acc["pos"] % WAY
        place, others = (acc["pos"] - first).cast("int"), (F.least(F.lit(WAY), acc["n"] - first) - 1).cast("int")
        start = acc["at"] + 1
        run = F.concat(F.substring(proof, start, place * SIZE), acc["node"], F.substring(proof, start + place * SIZE, (others - place) * SIZE))
        up = F.struct(digest(run).alias("node"), (acc["at"] + others * SIZE).alias("at"), F.floor(acc["pos"] / WAY).alias("pos"), F.ceil(acc["n"] / WAY).alias("n"))
        return F.when(acc["n"] > 1, up).otherwise(acc)

    start = F.struct(node.alias("node"), F.lit(0).alias("at"), pos.alias("pos"), n.alias("n"))
    return F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(levels)), 1, levels), start, step) if levels else start


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests as lowercase hex."""
    text = F.col("text")
    changed = (fold("doc_id", 2) == 0) & F.contains(text, F.lit("\n"))
    grp = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # none before all, and never null
    leaves = stored(docs.select("doc_id", grp.alias("grp"), leaf(text).alias("node"), F.when(changed, leaf(tampered(text))).alias("other")), "leaves")
    placed = with_counter(leaves, ["doc_id", "node"], "pos", by=["grp"], total="n").withColumn("pos", F.col("pos") - 1)
    most = placed.agg(F.max("n")).first()[0] or 0
    levels = forest(placed, most)
    none = F.array().cast("array<binary>")
    tops = [x.where("n = 1").select("grp", F.lit(k).alias("height"), "node", "kids" if k else none.alias("kids")) for k, x in enumerate([placed, *levels])]
    sources = with_counter(stored(reduce(DataFrame.unionByName, tops), "subroots"), "grp", "pos", total="n")
    sources = sources.select(F.col("grp").alias("source"), "height", F.col("kids").alias("own"), F.lit("").alias("grp"), (F.col("pos") - 1).alias("pos"), "n", "node")
    count = sources.agg(F.max("n")).first()[0] or 0
    upper = forest(sources, count)
    root = upper[-1].first()["node"] if upper else None  # one digest

    proofs = None
    for level in reversed([sources, *upper]):
        if proofs is None:
            proofs = level.withColumn("proof", F.lit(b""))
        else:
            proofs = pushed(level, proofs.select("grp", "pos", "kids", "proof"))
    tops = stored(proofs.select(F.col("source").alias("grp"), "height", F.col("own").alias("kids"), F.col("pos").alias("place"), F.col("node").alias("subroot"), "proof"), "tops")

    known = None
    for height in range(len(levels), 0, -1):
        top = tops.where(F.col("height") == height).select("grp", F.lit(0).cast("long").alias("pos"), "kids", "proof", "subroot", "place")
        if known is not None:
            known = pushed(levels[height - 1].where("n > 1").select("grp", "pos", "kids"), known).unionByName(top)
        else:
            known = top
    rows = placed.select("doc_id", "grp", "pos", "n", "node", "other")
    alone = rows.where("n = 1").join(tops.where("height = 0").select("grp", "proof", "subroot", "place"), "grp")
    out = alone if known is None else pushed(rows.where("n > 1"), known).unionByName(alone)
    out = out.withColumn("root", F.col("subroot") if root is None else F.lit(bytes(root)))
    # folds are evaluated once: each in an array of one
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    inner = folded(F.coalesce("other", "node"), F.col("proof"), F.col("pos"), F.col("n"), len(levels))
    rest = lambda x: F.substring(F.col("proof"), x["at"] + 1, F.length("proof"))
    whole = once(inner, lambda x: folded(x["node"], rest(x), F.col("place"), F.lit(count).cast("long"), len(upper))["node"])
    text_of = lambda c: F.lower(F.hex(c))
    out = out.withColumn("folded_root", text_of(whole))
    return out.select("doc_id", text_of(F.col("node")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"), F.sha2(text_of(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == text_of(F.col("root"))).alias("verified"))


#: Cases of the two trees: groups of `up` are sources, that of `top` is the tree over them.
def _tree_sql(name: str, leaves: str) -> str:
    return f"""{name} AS (SELECT grp, 0 AS lvl, pos, n, node FROM {leaves} UNION ALL
 SELECT grp, lvl + 1, pos // {WAY}, any_value((n + {WAY - 1}) // {WAY}), sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // {WAY})"""


def _fold_sql(name: str, tree: str, start: str) -> str:
    """The recomputed node and the siblings so far of each row, up to the tree's root."""
    return f"""{name} AS ({start} UNION ALL
 SELECT f.id, f.grp, f.lvl + 1, f.pos // {WAY}, any_value((f.n + {WAY - 1}) // {WAY}), sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.node ELSE t.node END, '' ORDER BY t.pos)),
  any_value(f.proof) || coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos <> f.pos), '')
 FROM {name} f JOIN {tree} t ON t.grp = f.grp AND t.lvl = f.lvl AND t.pos // {WAY} = f.pos // {WAY} WHERE f.n > 1 GROUP BY f.id, f.grp, f.lvl, f.pos)"""


def sql() -> str:
    value = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"
    hashed = lambda text: "sha256(" + " || ".join(map(value, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    return f"""
WITH RECURSIVE {CRC_SQL}, h AS (SELECT row_number() OVER () AS id, doc_id, coalesce('s' || source, 'n') AS grp, {hashed("text")} AS node,
 CASE WHEN {crc_sql("doc_id::varchar")} % 2 = 0 THEN {hashed("replace(text, chr(10), '')")} END AS other FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node, id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM h),
{_tree_sql("up", "l")},
s AS (SELECT '' AS grp, grp AS own, node, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
{_tree_sql("top", "s")},
{_fold_sql("f", "up", "SELECT id, grp, 0 AS lvl, pos, n, coalesce(other, node) AS node, '' AS proof FROM l")},
{_fold_sql("g", "top", "SELECT f.id, '' AS grp, 0 AS lvl, s.pos, s.n, f.node, f.proof FROM f JOIN s ON s.own = f.grp WHERE f.n = 1")}
SELECT doc_id, l.node AS leaf, s.node AS subroot, r.node AS root, sha256(g.proof) AS proof_sha256, g.node AS folded_root, g.node = r.node AS verified
FROM l JOIN s ON s.own = l.grp JOIN g ON g.id = l.id AND g.n = 1, (SELECT node FROM top WHERE n = 1) r
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
