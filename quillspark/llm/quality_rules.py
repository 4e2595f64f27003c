"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose measure is over a cutoff. Cutoffs are chosen for each stratum (language, and short or
long) from labelled documents: for every rule the cutoffs of a fixed grid are tested from the loosest to the strictest,
and the last one of the unbroken run that passes is taken. A cutoff passes if the exact binomial test refutes, at its
level, that the rule rejects more than RISK / rules of the good documents: P(Binomial(n, RISK / rules) <= rejected)
<= LEVEL / (strata * rules). The order is fixed beforehand, so a run needs no further correction; the Bonferroni factor
covers strata and rules. With confidence 1 - LEVEL every stratum loses at most RISK of its good documents to the method.
Where labels are too few nothing passes and the rule is off. All documents are measured, all labels counted.

Cases: null text has no word and fails the base rule. A null language is a stratum of its own; documents with a null
id have no label. Repeated labels of a document count once (the smallest quality). Repeated rows give repeated rows. Empty
tables: no row, or no rule. Extra columns are ignored. Very long texts are measured whole, a chunk each. A measure that ties
with its cutoff is kept.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, stored, table, text_chunks

RISK, LEVEL = 0.05, 0.05
SHORT = 200  # words
#: rule: how much of what; each measure is in [0, 1].
RULES = ["symbols", "dup_lines", "repeats", "upper", "bangs"]
GRID = [round(0.95**k, 6) for k in range(1, 120)]
_GAPS = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, symbols double, dup_lines double, repeats double, upper double, bangs double"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of `width` words that is found twice or more."""
    if len(words) <= width:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    key = a[: len(a) - width + 1]
    for k in range(1, width):
        _, key = np.unique(key * len(ids) + a[k : len(a) - width + 1 + k], return_inverse=True)
    twice = np.bincount(key)[key] > 1
    inside = np.zeros(len(a) + 1, np.int64)
    inside[: len(twice)] += twice
    inside[width : width + len(twice)] -= twice
    return int((np.cumsum(inside[:-1]) > 0).sum())


def measure(text: bytes) -> tuple:
    """The numbers of SCHEMA from n_words on."""
    words = text.split()  # of bytes: parted at 0x20 and 0x09-0x0D alone
    chars = len(text.translate(None, _GAPS))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    seen, dup, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    letters = len(text.translate(None, _NOT_LETTER))
    upper = len(text.translate(None, _NOT_UPPER))
    share = lambda a, b: min(1.0, a / b) if b else 0.0
    return len(words), chars, symbols, dup, repeat, share(symbols, chars), share(dup, lines), share(repeat, len(words)), share(upper, letters), share(text.count(b"!"), chars)


def measures(docs: DataFrame) -> DataFrame:
    def apply(batches):
        for batch, texts in text_chunks(batches):
            cols = list(zip(*map(measure, texts), strict=True))
            kinds = [pa.int64()] * 5 + [pa.float64()] * 5
            yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), col(batch, "lang"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text", "lang").mapInArrow(apply, SCHEMA)


def refuted(n: int, k: int, risk: float, level: float) -> bool:
    """P(Binomial(n, risk) <= k) <= level."""
    if k >= n * risk:
        return False
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk) for i in range(k + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs)) <= math.log(level)


def cutoffs(good: dict[tuple[str, str], Counter], risk: float = RISK, level: float = LEVEL) -> dict[tuple[str, str], float]:
    """good: for each (stratum, rule) how many good documents exceed exactly the first j cutoffs of reversed GRID,
    that is, how many have each number j of cutoffs below their measure. The chosen cutoff of each that has one."""
    out = {}
    for key, counts in good.items():
        n, over = sum(counts.values()), 0
        for j in range(len(GRID), 0, -1):  # GRID[len - j] is the j-th smallest cutoff
            over += counts.get(j, 0)
            if not refuted(n, over, risk / len(RULES), level / len(good)):
                break
            out[key] = GRID[len(GRID) - j]
    return out


def stratum() -> Column:
    return F.concat(F.coalesce(F.col("lang"), F.lit("und")), F.when(F.col("n_words") < SHORT, "/short").otherwise("/long"))


def learn(measured: DataFrame, labels: DataFrame) -> dict[tuple[str, str], float]:
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    passed = F.array(*[F.lit(c) for c in GRID])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.size(F.filter(passed, _below(F.col(r)))).alias("j")) for r in RULES])).alias("x")
    rows = measured.join(good, "doc_id", "left_semi").select(stratum().alias("stratum"), each).groupBy("stratum", "x.rule", "x.j").count().collect()
    counts: dict[tuple[str, str], Counter] = {}
    for r in rows:
        counts.setdefault((r["stratum"], r["rule"]), Counter())[r["j"]] += r["count"]
    return cutoffs(counts)


def _below(value: Column):
    return lambda c: c < value


def judge(measured: DataFrame, chosen: dict[tuple[str, str], float]) -> DataFrame:
    """measured with base_failed, kept, and `failed`, the rules of the method that reject it."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array()
    if chosen:
        cut = F.create_map(*[F.lit(v) for (s, r), c in sorted(chosen.items()) for v in (f"{s}:{r}", c)])
        failed = F.filter(F.array(*[F.when(F.col(r) > F.try_element_at(cut, F.concat(stratum(), F.lit(f":{r}"))), r) for r in RULES]), lambda x: x.isNotNull())
    return measured.withColumns({"base_failed": base, "failed": failed.cast("array<string>")}).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stored(measures(table(spark, sf_dir, "documents")), "measures")
    out = judge(measured, learn(measured, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def sql() -> str:
    """The same query: measures by lists, the chosen cutoffs by sums of binomial terms."""
    word, risk, grid = r"[^\x20\x09-\x0D]+", RISK / len(RULES), [float(c) for c in GRID]
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN least(1.0::double, ({a})::double / ({b})) ELSE 0.0::double END"
    kept = lambda chars: f"length(regexp_replace(text, '[^{chars}]', '', 'g'))"
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
three AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM three) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS nr FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{word}') GROUP BY doc_id),
b AS (SELECT t.doc_id, coalesce(lang, 'und') || CASE WHEN len(w) < {SHORT} THEN '/short' ELSE '/long' END AS stratum, len(w)::bigint AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
  {kept("#*$%&|<>")}::bigint AS n_symbols, coalesce(lines.n - lines.d, 0)::bigint AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words,
  {kept("A-Za-z")} AS letters, {kept("A-Z")} AS upper, {kept("!")} AS bangs FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
m AS (SELECT doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  {{'symbols': {ratio("n_symbols", "word_chars")}, 'dup_lines': {ratio("n_dup_lines", "n_lines")}, 'repeats': {ratio("n_repeat_words", "n_words")}, 'upper': {ratio("upper", "letters")}, 'bangs': {ratio("bangs", "word_chars")}}} AS x FROM b),
r AS (SELECT doc_id, stratum, unnest({RULES}) AS rule, unnest([x.symbols, x.dup_lines, x.repeats, x.upper, x.bangs]) AS v FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
cuts AS (SELECT unnest(range(0, {len(GRID)})) AS nr, unnest({grid}) AS cutoff),
held AS (SELECT stratum, rule, count(*) AS n, list(v) AS vs FROM r JOIN good USING (doc_id) GROUP BY stratum, rule),
fam AS (SELECT count(*) AS families FROM held),
k AS (SELECT stratum, rule, nr, cutoff, n, families, len(list_filter(vs, lambda v: v > cutoff)) AS k FROM held, cuts, fam),
ok AS (SELECT stratum, rule, nr, cutoff, k < n * {risk!r}::double AND (SELECT ln(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}::double) + (n - i) * ln(1 - {risk!r}::double)))) FROM range(0, k + 1) q(i)) <= ln({LEVEL!r}::double / families) AS passed FROM k),
run AS (SELECT stratum, rule, cutoff FROM (SELECT *, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY nr) AS unbroken FROM ok) WHERE unbroken),
chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM run GROUP BY stratum, rule),
f AS (SELECT r.doc_id, string_agg(rule, ',' ORDER BY list_position({RULES}, rule)) AS failed FROM r JOIN chosen c USING (stratum, rule) WHERE v > cutoff GROUP BY r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.failed IS NULL AS kept, coalesce(f.failed, '') AS failed FROM m LEFT JOIN f USING (doc_id)
"""
