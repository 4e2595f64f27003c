"""Chat formatting after a collapse of cumulative snapshots; DataFrame functions only.

A turn's hashes are salted with its position; their running exclusive-or over a conversation's turns is the hash of each
prefix (128 bits, from two seeds). A conversation whose hash is that of a shorter prefix of another one is a snapshot
of it and goes by an anti-join; of equal conversations the one of smallest id stays. Prefix hashes and whole hashes are
made distinct before they meet, so neither a common first turn nor a much-logged conversation makes a hot key. Text is
shuffled once, by conversation; a kept conversation is one output row and so has to fit a task.

Cases: turns are ordered by turn (null first), role and text; exactly repeated rows count once; null role or text is
empty; rows without conv_id belong to no conversation and are left out. Empty table: no row. Extra columns are ignored.
Very long texts are hashed whole. Of conversations that tie, being equal, the one of smallest id stands for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations that it stands for) of every maximal conversation, with its turns
    as rows: pos, role, text."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    this = F.struct(F.coalesce(F.col("turn").cast("string"), F.lit("null")).alias("turn"), "role", "text")
    rows = rows.withColumn("same", F.coalesce(F.lag(this).over(order) == this, F.lit(False))).where("not same").drop("same")
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy("conv_id")))
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    for k in (1, 2):
        rows = rows.withColumn(f"h{k}", F.bit_xor(F.xxhash64(F.lit(k), "pos", "role", "text")).over(running))
    whole = rows.where("pos = n").groupBy("h1", "h2", F.col("n").alias("n_turns")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = rows.where("pos < n").select("h1", "h2", F.col("pos").cast("long").alias("n_turns")).distinct()
    kept = whole.join(prefixes, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")
    return rows.select("conv_id", "pos", "role", "text").join(kept, "conv_id")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of every maximal conversation."""
    said = F.struct("pos", render(F.col("role"), F.col("text")).alias("said"))
    return collapse(turns).groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["said"]), "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
             string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER (w ROWS UNBOUNDED PRECEDING) AS said
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, said AS text FROM p
WHERE pos = n AND NOT EXISTS (SELECT 1 FROM p q WHERE q.said = p.said AND q.pos < q.n)
GROUP BY said, n
"""
