r"""Conversation structure repair: the cheapest edits that make a conversation's roles follow `(s?(ua)+)?`.

Rows are dealt by conversation, once, and sorted within their partitions; then a task reads them in order and runs the
forward Viterbi recursion over the four states of the grammar (nothing yet, after system, after user, after assistant).
A state holds its least (cost, audit string) and the running sha256 of the repaired text. After each row's layer the
states are closed under insertions, of which two suffice: a third would come back to a state at a higher cost.

Of the audit strings of a layer only their order is needed: none that end in a row's own edit is a prefix of another, for
all have as many such edits, so a state carries the rank of its string and the insertions after it, and the letters are
read off back pointers at the end, four bytes a row. So a task holds a batch of rows and four bytes a row of the
conversation at hand, whatever its length; a conversation's audit is one value of one output row, and its hash one chain,
so its rows have to pass one task.

Faults come from DataFrame functions: a row is a duplicate if it is not the first of its conversation, role and text, by a
window that streams, so neither long conversations nor rows that occur a million times are held.

Cases: null roles and texts are one space, which is blank and no role. Rows without conv_id are one conversation, whose id
is null. Rows of equal turn are in order of role and text; null turns come first. An empty role has no initial and can be
kept nowhere. Ties of cost are broken by the audit string, which fixes the repair. Empty table: no row. Extra columns are
ignored. Very long texts are hashed as they pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from .common import CRC_SQL, col, crc_sql, table, text_chunks

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The states, the one that a user or assistant turn leads to, and what that turn's role is.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "KRD"
#: Results a batch.
BATCH = 2000
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `dropped` after the damage by crc32 of conv_id:turn; dropped rows stay, marked."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("dropped"), copies.alias("_copy")).drop("_copy")


def judged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, and `dropped` where rows are out) by conversation, in order within partitions,
    with `fault`: blank, duplicate, truncated or empty."""
    out = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    value = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select("conv_id", "turn", value("role").alias("role"), F.when(out, F.lit("")).otherwise(value("text")).alias("text"), out.alias("dropped"))
    rows = rows.repartition("conv_id")  # what follows keeps this partitioning
    same = W.partitionBy("conv_id", "dropped", "role", F.md5("text")).orderBy("turn")
    rest = F.rtrim("text", F.lit(SPACES))
    fault = F.when(rest == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.withColumn("fault", fault).sortWithinPartitions("conv_id", "turn", "role", "text")


class Repair:
    """The recursion over one conversation. A state is (cost, rank, insertions, sha256), or None where it cannot be
    reached; `back` has a byte a state and layer: the state before it, the letter, the insertions, and the state that the
    letter led to."""

    def __init__(self):
        self.states, self.back = [], bytearray()
        self.close([(0, 0, START, 0, hashlib.sha256()), None, None, None])

    def close(self, layer: list) -> None:
        """layer: (cost, rank, state before, letter, sha256) of each state before insertions."""
        closed = [s and (s[0], s[1], 0, state, *s[2:]) for state, s in enumerate(layer)]
        for _ in range(2):
            for state in (START, SYSTEM, ASSISTANT, USER):
                s, to = closed[state], NEXT[state]
                if s and (closed[to] is None or (s[0] + INSERT, s[1], s[2] + 1) < closed[to][:3]):
                    closed[to] = (s[0] + INSERT, s[1], s[2] + 1, *s[3:6], said(s[6], state, NAME[to], b""))
        self.states = [s and (*s[:3], s[6]) for s in closed]
        self.back += bytes([s[4] << 6 | s[5] << 4 | s[2] << 2 | s[3] if s else 0 for s in closed])

    def row(self, role: str, text: bytes, fault: str) -> None:
        best: dict = {}
        extra = TRUNCATED if fault == "truncated" else 0
        for state, s in enumerate(self.states):
            if s is None:
                continue
            cost, rank, inserted, _ = s
            edits = [(state, cost + DELETE, LETTERS.index("D"))]
            if fault not in ("blank", "duplicate"):
                own = {"s": SYSTEM if state == START else None, "u": USER, "a": ASSISTANT}.get(role[:1])
                if own in (NEXT[state], SYSTEM):
                    edits.append((own, cost + extra, LETTERS.index("K")))
                edits.append((NEXT[state], cost + REROLE + extra, LETTERS.index("R")))
            for to, total, letter in edits:
                found = (total, rank, "I" * inserted + LETTERS[letter]), state, letter
                best[to] = min(best.get(to, found), found, key=lambda x: x[0])
        layer: list = [None] * 4
        for rank, to in enumerate(sorted(best, key=lambda to: best[to][0][1:])):
            key, state, letter = best[to]
            sha = self.states[state][3]
            layer[to] = (key[0], rank, state, letter, sha if LETTERS[letter] == "D" else said(sha, state, role if LETTERS[letter] == "K" else NAME[to], text))
        self.close(layer)

    def best(self) -> tuple[int, bytearray, str]:
        """The least cost, the codes of `back` on its way, one for the beginning and one a row, and the repaired hash."""
        (cost, *_), state = min((self.states[state][:3], state) for state in (START, ASSISTANT) if self.states[state])
        sha, way = self.states[state][3].hexdigest(), bytearray()
        for at in range(len(self.back) - 4, -1, -4):
            way.append(self.back[at + state])
            state = way[-1] >> 6
        way.reverse()
        return cost, way, sha


def audit(way: bytearray) -> str:
    """The letters of the codes; the first one's own letter stands for no row."""
    return "".join(LETTERS[c >> 4 & 3] + "I" * (c >> 2 & 3) for c in way)[1:]


def turns_of(code: int, first: bool) -> tuple[bool, list[str | None]]:
    """Whether the row's text stays, and the roles of the turns that its edits leave (None: the row's own)."""
    state, letter, roles = code & 3, "D" if first else LETTERS[code >> 4 & 3], []
    if letter != "D":
        roles.append(None if letter == "K" else NAME[state])
    for _ in range(code >> 2 & 3):
        state = NEXT[state]
        roles.append(NAME[state])
    return letter != "D", roles


def said(sha, state: int, role: str, text: bytes):
    """The hash after one more turn; turns are parted by line ends."""
    sha = sha.copy()
    sha.update((b"" if state == START else b"\n") + role.encode() + b":")
    sha.update(text)
    return sha


def conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[int], Repair]]:
    """conv_id, the counts but for the cost, and the recursion of each conversation of rows in order."""
    nothing = object()
    now, counts, repair = nothing, [0] * 5, Repair()
    before = first = last = None
    for batch, texts in text_chunks(batches):
        rows = zip(*(col(batch, c).to_pylist() for c in ("conv_id", "turn", "role", "dropped", "fault")), texts, strict=True)
        for conv, turn, role, dropped, fault, text in rows:
            if now is nothing or conv != now:
                if now is not nothing:
                    yield now, counts, repair
                now, counts, repair, before, first, last = conv, [0] * 5, Repair(), None, None, None
            if dropped:
                continue
            if turn is not None and turn != last:  # turns rise
                counts[0] += turn - last - 1 if first is not None else 0
                first, last = turn if first is None else first, turn
            if fault:
                counts[1 + ("blank", "duplicate", "truncated").index(fault)] += 1
            counts[4] += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            repair.row(role, text, fault)
    if now is not nothing:
        yield now, counts, repair


def _typed(df: DataFrame, rest: str) -> str:
    return f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {rest}"


def repairs(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
    rows = judged(turns)
    kinds = [to_arrow_type(rows.schema["conv_id"].dataType), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]

    def packed(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for conv, counts, repair in conversations(batches):
            cost, way, sha = repair.best()
            out.append((conv, *counts, cost, audit(way), sha))
            if len(out) == BATCH:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    return rows.mapInArrow(run, _typed(rows, ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"))


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, pos, role, text. pos orders a conversation's turns; it is the number
    of the row that a turn comes from or follows, and of the turn among those."""
    rows = judged(turns)
    kind = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, _, repair in conversations(batches):
            way = repair.best()[1]
            for lo in range(0, len(way), BATCH):
                left = [turns_of(code, lo + k == 0) for k, code in enumerate(way[lo : lo + BATCH])]
                columns = [pa.array([conv] * len(left), kind), pa.array(range(lo, lo + len(left)), pa.int64()), pa.array([x[0] for x in left]), pa.array([x[1] for x in left], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "nr", "stays", "roles"])

    edits = rows.mapInArrow(run, _typed(rows, "nr long, stays boolean, roles array<string>"))
    numbered = rows.where("not dropped").select(F.col("conv_id").alias("_conv"), "role", "text", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("_nr"))
    both = edits.join(numbered, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("nr") == F.col("_nr")), "left")
    said = both.select("conv_id", "nr", "stays", "role", "text", F.posexplode("roles").alias("k", "given"))
    own = F.col("stays") & (F.col("k") == 0)
    return said.select("conv_id", F.struct("nr", "k").alias("pos"), F.coalesce("given", "role").alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(table(spark, sf_dir, "conversations")))


def sql() -> str:
    """The same recursion, with whole audit strings and repaired texts in the states."""

    def via(s: str, cost: str, letter: str, item: str) -> str:
        return f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'r': {s}.r || {item}}} END"

    line = lambda role: f"{role} || ':' || n.text || chr(10)"
    insert = lambda s, role: via(s, str(INSERT), "I", f"'{role}:' || chr(10)")
    delete = lambda s: via(s, str(DELETE), "D", "''")
    keep = lambda s, ini: f"CASE WHEN usable AND left(n.role, 1) = '{ini}' THEN {via(s, 'extra', 'K', line('n.role'))} END"
    rerole = lambda s, role: f"CASE WHEN usable THEN {via(s, f'{REROLE} + extra', 'R', line(chr(39) + role + chr(39)))} END"
    users = [f(f"s{k}", x) for k in (START, SYSTEM, ASSISTANT) for f, x in ((keep, "u"), (rerole, "user"))]
    value = lambda c: f"coalesce({c}::varchar, ' ')"
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    struct = "{'c': 0::bigint, 'a': '', 'r': ''}"
    return f"""
WITH RECURSIVE {CRC_SQL}, k AS (SELECT conv_id, turn, {value("role")} AS role, {value("text")} AS text, {crc_sql(value("conv_id") + " || ':' || " + value("turn"))} % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, {spaces}) AS rest FROM d),
f AS (SELECT *, CASE WHEN rest = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
n AS (SELECT conv_id AS conv, i, role, text, fault NOT IN ('blank', 'duplicate') AS usable, CASE fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra FROM f),
s AS (SELECT conv_id AS conv, 0::bigint AS i, {struct} AS s0, NULL::struct(c bigint, a varchar, r varchar) AS s1, {insert(struct, "user")} AS s2, {insert("(" + insert(struct, "user") + ")", "assistant")} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL SELECT conv, i, p0, p1, q2, list_min([p3, {insert("q2", "assistant")}]) FROM (
  SELECT *, list_min([p2, {insert("p0", "user")}, {insert("p1", "user")}, {insert("p3", "user")}]) AS q2 FROM (
   SELECT s.conv, s.i + 1 AS i, {delete("s0")} AS p0, list_min([{delete("s1")}, {keep("s0", "s")}]) AS p1, list_min([{delete("s2")}, {", ".join(users)}]) AS p2,
    list_min([{delete("s3")}, {keep("s2", "a")}, {rerole("s2", "assistant")}]) AS p3 FROM s JOIN n ON n.conv IS NOT DISTINCT FROM s.conv AND n.i = s.i + 1))),
e AS (SELECT conv, max_by(list_min([s0, s3]), i) AS best FROM s GROUP BY conv),
c AS (SELECT conv_id AS conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 best.c AS cost, best.a AS audit, sha256(left(best.r, length(best.r) - 1)) AS repaired_sha256
FROM e LEFT JOIN c ON c.conv IS NOT DISTINCT FROM e.conv
"""
