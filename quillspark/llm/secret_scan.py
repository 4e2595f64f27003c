r"""Secret scans; DataFrame functions only.

Base kinds by pattern (assign, access, hex), leftmost and non-overlapping per kind, with code-point spans taken from the
lengths of what `split` leaves between the matches. The method adds entropy spans: candidate strings of CANDIDATE_MIN
characters or more get a window of WINDOW characters slid over them; the sum of c*log2(c) over the window's character
counts is updated for the one character that enters and the one that leaves, which gives the window's Shannon entropy
log2(WINDOW) - sum / WINDOW. A window at or over the threshold of the candidate's character class marks its characters;
the span runs from the first to the last marked one. Allow-listed candidates are suppressed: those without a digit, those
of digits alone (their threshold is out of reach), UUIDs, and those where stand-ins and rulers leave no window free. Of a
candidate that overlaps base spans the parts between them are scanned. There is no shuffle.

Very long texts: candidates are scanned in pieces of PIECE characters that overlap by a window, matches are placed in
runs of RUN and texts redacted in blocks of BLOCK characters, so the time is in proportion to a text's length (but for
its base spans, which each candidate is held against, and its redacted spans, which each block is). A scalar Python
function over the results needs them written first: the planner does not part it from lambdas that hold others' variables.

Cases: null text is empty. A null id is kept. Repeated rows give repeated rows. Extra columns are kept; a column with the
name of a result is replaced by it. Spans of equal start go by kind; an entropy of just the threshold marks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: kind: (pattern, group that must be long enough, its least length)
BASE = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
KINDS = [*BASE, "entropy"]
CANDIDATE_MIN, WINDOW = 20, 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: class: (pattern, bits); the first that fits.
CLASSES = {"digits": (r"^[0-9_=+/-]+$", 9.0), "hex": (r"^[0-9a-fA-F]+$", 2.9), "alnum": (r"^[A-Za-z0-9]+$", 3.3), "base64": (r"", 3.4)}
ALLOWED = [
    r"^[A-Za-z+/_=-]+$",  # words and paths without a digit
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
]
#: Stand-ins and rulers; a candidate that has some, and no WINDOW characters between them, is no secret.
STAND_IN = r"(?i)example|dummy|placeholder|changeme|x{4,}|0123456789|abcdefgh|(.)\1{7,}"
PIECE, RUN, BLOCK = 64, 512, 4096
#: Of entropies, for the order in which a window's sum was added up.
TOLERANCE = 1e-9
SPAN = "array<struct<s:int,rank:int,e:int,kind:string>>"


def matches(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """s, rank, e, kind and the group's text of each match; an empty array where the pattern is absent."""
    found, named = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    between = F.transform(F.split(text, pattern, -1), F.length)
    empty = F.array().cast("array<struct<s:int,rank:int,e:int,kind:string,x:string>>")

    def step(acc, x):
        s = acc["at"] + x["gap"]
        e = s + F.length(x["m"])
        span = F.struct(s.alias("s"), F.lit(KINDS.index(kind)).alias("rank"), e.alias("e"), F.lit(kind).alias("kind"), x["x"].alias("x"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def run(acc, part):
        here = F.struct(acc["at"].alias("at"), empty.alias("out"))
        return F.aggregate(part, here, step, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    zipped = F.zip_with(F.arrays_zip(found.alias("m"), named.alias("x")), F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(gap.alias("gap"), m["m"].alias("m"), m["x"].alias("x")))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(RUN)), lambda k: F.slice(zipped, k, F.lit(RUN)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,rank:int,e:int,kind:string,x:string>>>").alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, zero, run, lambda acc: F.flatten(acc["out"]))).otherwise(empty)


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"], x["rank"], x["e"], x["kind"]))


def times(char: Column, within: Column) -> Column:
    return F.length(within) - F.length(F.replace(within, char, F.lit("")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once however often it occurs in use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hot_part(x: Column, bits: Column) -> Column:
    """First (0-based) and end of the characters in windows of `bits` entropy or more; nulls if there is none. Pieces of
    PIECE characters have the next WINDOW - 1 as well, so each window is in one of them."""
    pieces = F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{1,{PIECE + WINDOW - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    found = F.transform(pieces, lambda p, k: F.struct((k * PIECE).alias("at"), _hot_piece(p, bits).alias("p")))
    found = F.filter(found, lambda y: y["p"]["first"].isNotNull())
    first, end = F.array_min(F.transform(found, lambda y: y["at"] + y["p"]["first"])), F.array_max(F.transform(found, lambda y: y["at"] + y["p"]["end"]))
    return F.struct(first.alias("first"), end.alias("end"))


def _hot_piece(x: Column, bits: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("end"))
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])  # c * log2(c)
    weight = lambda c: F.get(weights, c)

    def counts(i):
        """How often the character that enters was in the window, and the one that leaves, with the one that entered."""
        new, old = F.substring(x, i, F.lit(1)), F.substring(x, i - WINDOW, F.lit(1))
        before = F.when(i <= 1, F.lit("")).otherwise(F.substring(x, F.greatest(i - WINDOW, F.lit(1)), F.least(i - 1, F.lit(WINDOW))))
        return F.struct(times(new, before).alias("c"), F.when(i > WINDOW, bound(F.concat(before, new), lambda w: times(old, w))).otherwise(0).alias("d"))

    def mark(acc, i):
        total = bound(counts(i), lambda n: acc["sum"] + weight(n["c"] + 1) - weight(n["c"]) + F.when(i > WINDOW, weight(n["d"] - 1) - weight(n["d"])).otherwise(0.0))

        def marked(t):
            hot = (i >= WINDOW) & (math.log2(WINDOW) - t / WINDOW >= bits - TOLERANCE)
            return F.struct(t.alias("sum"), F.when(hot, F.coalesce(acc["first"], i - WINDOW)).otherwise(acc["first"]).alias("first"), F.when(hot, i).otherwise(acc["end"]).alias("end"))

        return bound(total, marked)

    return F.aggregate(F.sequence(F.lit(1), F.length(x)), zero, mark)


def bits_of(x: Column) -> Column:
    out = F
    for pattern, bits in CLASSES.values():
        out = out.when(x.rlike(pattern), bits) if pattern else out.otherwise(bits)
    return out


def outside(x: Column, base: Column) -> Column:
    """s, text and threshold of the parts of a candidate between base spans (in order) where a window fits."""
    part = lambda s, e: F.struct(s.alias("s"), F.substring(x["x"], s - x["s"] + 1, e - s).alias("x"), bits_of(x["x"]).alias("bits"))
    zero = F.struct(x["s"].alias("at"), F.array().cast("array<struct<s:int,x:string,bits:double>>").alias("out"))

    def more(acc, end):
        return F.when(end - acc["at"] >= WINDOW, F.concat(acc["out"], F.array(part(acc["at"], end)))).otherwise(acc["out"])

    def step(acc, b):
        return F.struct(F.greatest(acc["at"], b["e"]).alias("at"), more(acc, F.least(b["s"], x["e"])).alias("out"))

    return F.aggregate(base, zero, step, lambda acc: more(acc, x["e"]))


def scan(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with the columns `base` and `spans`, arrays of struct(s, rank, e, kind) in order of start and kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = f"_{uuid.uuid4().hex}_"  # names that no column has
    kept = [c for c in docs.columns if c not in (base, spans)]
    docs = docs.withColumns({f"{own}{kind}": plain(_long_enough(matches(t, kind, pattern, group), least)) for kind, (pattern, group, least) in BASE.items()} | {f"{own}odd": F.filter(matches(t, "entropy", CANDIDATE), lambda x: ~_allowed(x["x"]))})
    docs = docs.withColumn(f"{own}base", F.array_sort(F.concat(*[F.col(f"{own}{k}") for k in BASE])))
    docs = docs.withColumn(f"{own}odd", F.flatten(F.transform(f"{own}odd", lambda x: outside(x, F.col(f"{own}base")))))
    found = F.transform(f"{own}odd", lambda x: F.struct(x["s"].alias("at"), hot_part(x["x"], x["bits"]).alias("p")))
    found = F.transform(F.filter(found, lambda x: x["p"]["first"].isNotNull()), lambda x: F.struct((x["at"] + x["p"]["first"]).alias("s"), F.lit(3).alias("rank"), (x["at"] + x["p"]["end"]).alias("e"), F.lit("entropy").alias("kind")))
    docs = docs.withColumn(f"{own}found", F.when(F.size(f"{own}odd") > 0, found).otherwise(F.array().cast(SPAN)))
    return docs.select(*kept, F.col(f"{own}base").alias(base), F.array_sort(F.concat(F.col(f"{own}base"), F.col(f"{own}found"))).alias(spans))


def _long_enough(found: Column, least: int) -> Column:
    return F.filter(found, lambda x: F.length(x["x"]) >= least)


def _of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def _allowed(x: Column) -> Column:
    rests = F.split(x, STAND_IN, -1)
    out = (F.size(rests) > 1) & ~F.exists(rests, lambda r: F.length(r) >= WINDOW)
    for pattern in ALLOWED:
        out = out | x.rlike(pattern)
    return out


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every run of overlapping or touching spans replaced by the mark, block by block."""
    zero = F.array().cast("array<struct<s:int,e:int>>")

    def merge(acc, x):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["s"] <= F.when(F.size(acc) > 0, last["e"]))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    runs = F.aggregate(spans, zero, merge)

    def block(b, k):
        start = k * BLOCK
        size = F.length(b)
        here = F.filter(runs, lambda r: (r["s"] < start + size) & (r["e"] > start))

        def step(acc, r):
            gap = F.substring(b, acc["at"] + 1, F.greatest(r["s"] - start - acc["at"], F.lit(0)))
            return F.struct(F.least(r["e"] - start, size).alias("at"), F.concat(acc["out"], gap, F.when(r["s"] >= start, F.lit(mark)).otherwise("")).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(here, begin, step, lambda acc: F.concat(acc["out"], F.substring(b, acc["at"] + 1, size)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, F.array_join(F.transform(blocks, block), "")).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_of_kind("base", k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def sql() -> str:
    """The same query, window by window; back references are spelled out, which this dialect's patterns lack."""
    quoted = lambda p: p.replace("'", "''")
    signs = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    stand_in = STAND_IN.replace(r"(.)\1{7,}", "|".join(f"[{c}]{{8,}}" for c in signs))

    def found(kind: str, pattern: str, group: int, least: int) -> str:
        p = quoted(pattern)
        return f"""SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS rank, x, (e - length(m))::int AS s, e::int AS e FROM (
  SELECT doc_id, m, x, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM (
    SELECT doc_id, unnest(f) AS m, unnest(g) AS x, unnest(gaps[1:len(f)]) AS gap, unnest(range(len(f))) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{p}') AS f, regexp_extract_all(text, '{p}', {group}) AS g, regexp_split_to_array(text, '{p}') AS gaps FROM t) WHERE len(f) > 0)) WHERE length(x) >= {least}"""

    classes = " ".join(f"WHEN regexp_matches(y, '{p}') THEN {bits}::double" for p, bits in CLASSES.values() if p)
    other = next(bits for p, bits in CLASSES.values() if not p)
    allowed = " OR ".join(f"regexp_matches(x, '{p}')" for p in ALLOWED)
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(found(k, *v) for k, v in BASE.items())}),
cand AS (SELECT doc_id, s, e, x FROM ({found("entropy", CANDIDATE, 0, CANDIDATE_MIN)}) WHERE NOT ({allowed})
  AND NOT (regexp_matches(x, '{stand_in}') AND list_max(list_transform(regexp_split_to_array(x, '{stand_in}'), lambda r: length(r))) < {WINDOW})),
free AS (SELECT c.doc_id, c.s, c.x, p FROM (SELECT doc_id, s, e, x, unnest(range(s, e)) AS p FROM cand) c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s <= p AND p < b.e)),
part AS (SELECT doc_id, min(p) AS a, substr(any_value(x), (min(p) - s + 1)::int, count(*)::int) AS y FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, s ORDER BY p) AS island FROM free) GROUP BY doc_id, s, island HAVING count(*) >= {WINDOW}),
win AS (SELECT doc_id, a, y, unnest(range(0, length(y) - {WINDOW - 1})) AS k FROM part),
chars AS (SELECT doc_id, a, k, c, count(*) AS n FROM (SELECT doc_id, a, k, unnest(string_split(substr(y, (k + 1)::int, {WINDOW}), '')) AS c FROM win) GROUP BY doc_id, a, k, c),
bits AS (SELECT doc_id, a, k, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS h FROM chars GROUP BY doc_id, a, k),
hot AS (SELECT doc_id, a + min(k) AS s, a + max(k) + {WINDOW} AS e FROM bits JOIN (SELECT doc_id, a, CASE {classes} ELSE {other}::double END AS least FROM part) USING (doc_id, a) WHERE h >= least - {TOLERANCE!r}::double GROUP BY doc_id, a),
spans AS (SELECT doc_id, kind, rank, s, e FROM base UNION ALL SELECT doc_id, 'entropy', 3, s, e FROM hot)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(b.said, '')) AS base_sha256, coalesce(a.said, '') AS spans
FROM t LEFT JOIN (SELECT doc_id, {counts}, {listed} AS said FROM base GROUP BY doc_id) b USING (doc_id) LEFT JOIN (SELECT doc_id, {listed} AS said FROM spans GROUP BY doc_id) a USING (doc_id)
"""
