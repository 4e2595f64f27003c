r"""License scans by ordered signature rules; DataFrame functions only.

A text's words (runs of ASCII letters in lower case, digits and characters beyond ASCII) are taken once. Of each rule the
plain words have to occur among them before its pattern is tried: the words are met with the list of all rules' keywords,
and only rules whose keywords are all there are run. A text without any keyword, which most are, costs no more. Rules are
patterns over words; their detections are intervals of words. A detection goes if another one of a level as high or higher
covers its interval (of equal intervals of a level the one whose rule stands first stays), which one sweep in order of
start decides with the furthest end so far of each level. There is no shuffle and nothing leaves the row.

RULES holds the four base phrases, hand-written sentences, and the forms in which licenses are named: name, name or short
name with version, short name beside the word license, identifier tag, address. Base detections are counted and kept
whatever covers them.

In a pattern each token is a word's regular expression; `x?` may be missing, `*k` stands for up to k words.

Cases: null text has no word. Ties are decided as above. Repeated rows give repeated rows. Extra columns are kept; a
column of a result's name is replaced by it. Very long texts take one pass for the words and one for each rule whose
keywords they have; detections are swept in runs of RUN. Empty table: no row.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUN, MARK = 512, "\x01"
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
#: Levels: sentences and tags, versions and addresses, names in context, bare names; with the confidence of each.
SENTENCE, VERSION, CONTEXT, NAME = 4, 3, 2, 1
CONFIDENCE = {SENTENCE: 1.0, VERSION: 0.95, CONTEXT: 0.8, NAME: 0.6}
#: label: names; short names; versions. Short names count beside the word license, a version or a tag only.
FAMILIES = {
    "gpl": ("gnu general public licen[sc]e", "gnu? gpl", "1.0 2.0 3.0"),
    "lgpl": ("gnu lesser general public licen[sc]e; gnu library general public licen[sc]e; lesser general public licen[sc]e", "gnu? lgpl", "2.0 2.1 3.0"),
    "agpl": ("gnu affero general public licen[sc]e; affero general public licen[sc]e", "gnu? agpl", "1.0 3.0"),
    "gfdl": ("gnu free documentation licen[sc]e", "gfdl; gnu fdl", "1.1 1.2 1.3"),
    "apache": ("apache software licen[sc]e; apache software foundation licen[sc]e", "apache; asl", "1.0 1.1 2.0"),
    "mpl": ("mozilla public licen[sc]e", "mpl", "1.0 1.1 2.0"),
    "epl": ("eclipse public licen[sc]e", "epl", "1.0 2.0"),
    "edl": ("eclipse distribution licen[sc]e", "edl", "1.0"),
    "cpl": ("common public licen[sc]e", "cpl", "1.0"),
    "ipl": ("ibm public licen[sc]e", "ipl", "1.0"),
    "cddl": ("common development and distribution licen[sc]e", "cddl", "1.0 1.1"),
    "eupl": ("european union public licen[sc]e", "eupl", "1.0 1.1 1.2"),
    "artistic": ("artistic licen[sc]e; perl artistic licen[sc]e", "artistic", "1.0 2.0"),
    "osl": ("open software licen[sc]e", "osl", "1.0 2.0 2.1 3.0"),
    "afl": ("academic free licen[sc]e", "afl", "1.1 1.2 2.0 2.1 3.0"),
    "bsl": ("boost software licen[sc]e", "bsl; boost", "1.0"),
    "busl": ("business source licen[sc]e", "busl", "1.1"),
    "sspl": ("server side public licen[sc]e", "sspl", "1.0"),
    "elastic": ("elastic licen[sc]e", "elastic", "2.0"),
    "psf": ("python software foundation licen[sc]e; psf licen[sc]e agreement", "psf; python", "2.0"),
    "php": ("php licen[sc]e", "php", "3.0 3.01"),
    "apsl": ("apple public source licen[sc]e", "apsl", "1.0 1.1 1.2 2.0"),
    "qpl": ("q public licen[sc]e", "qpl", "1.0"),
    "lppl": ("latex project public licen[sc]e", "lppl", "1.0 1.1 1.2 1.3"),
    "ecl": ("educational community licen[sc]e", "ecl", "1.0 2.0"),
    "upl": ("universal permissive licen[sc]e", "upl", "1.0"),
    "cecill": ("cecill free software licen[sc]e", "cecill", "1.0 1.1 2.0 2.1"),
    "ofl": ("sil open font licen[sc]e; open font licen[sc]e", "ofl", "1.0 1.1"),
    "odbl": ("open data commons open database licen[sc]e; open database licen[sc]e", "odbl", "1.0"),
    "odc-by": ("open data commons attribution licen[sc]e", "odc by", "1.0"),
    "pddl": ("open data commons public domain dedication and licen[sc]e", "pddl", "1.0"),
    "cc0": ("creative commons zero; cc0 public domain dedication; creative commons public domain dedication", "cc0; cc zero", "1.0"),
    "ms-pl": ("microsoft public licen[sc]e", "ms pl", ""),
    "ms-rl": ("microsoft reciprocal licen[sc]e", "ms rl", ""),
    "nasa": ("nasa open source agreement", "nosa", "1.3"),
    "mulan": ("mulan permissive software licen[sc]e", "mulanpsl", "1.0 2.0"),
    "blueoak": ("blue oak model licen[sc]e", "blueoak", "1.0"),
    "hippocratic": ("hippocratic licen[sc]e", "hippocratic", "2.0 2.1 3.0"),
    "openrail": ("bigscience openrail m licen[sc]e; open rail licen[sc]e; responsible ai licen[sc]e", "openrail", ""),
    "ncsa": ("university of illinois ncsa open source licen[sc]e", "ncsa", ""),
    "w3c": ("w3c software notice and licen[sc]e; w3c software and document licen[sc]e", "w3c", ""),
    "zpl": ("zope public licen[sc]e", "zpl", "1.1 2.0 2.1"),
    "sleepycat": ("sleepycat licen[sc]e", "sleepycat", ""),
    "postgresql": ("postgresql licen[sc]e", "postgresql", ""),
    "openssl": ("openssl licen[sc]e", "openssl", ""),
    "unlicense": ("the unlicense", "unlicense", ""),
    "wtfpl": ("do what the fuck you want to public licen[sc]e", "wtfpl", "1.0 2.0"),
    "beerware": ("beer ware licen[sc]e; beerware licen[sc]e", "beerware", ""),
    "isc": ("isc licen[sc]e; internet systems consortium licen[sc]e", "isc", ""),
    "zlib": ("zlib licen[sc]e; zlib libpng licen[sc]e", "zlib", ""),
    "x11": ("x11 licen[sc]e; mit x11 licen[sc]e", "x11", ""),
    "mit": ("mit licen[sc]e; expat licen[sc]e", "mit; expat", ""),
    "mit-0": ("mit no attribution licen[sc]e; mit no attribution", "mit 0", ""),
    "0bsd": ("zero clause bsd licen[sc]e; bsd zero clause licen[sc]e", "0bsd", ""),
    "bsd-2-clause": ("(two|2) clause bsd licen[sc]e; simplified bsd licen[sc]e; freebsd licen[sc]e", "bsd 2 clause", ""),
    "bsd-3-clause": ("(three|3) clause bsd licen[sc]e; new bsd licen[sc]e; modified bsd licen[sc]e; revised bsd licen[sc]e", "bsd 3 clause", ""),
    "bsd-4-clause": ("(four|4) clause bsd licen[sc]e; original bsd licen[sc]e", "bsd 4 clause", ""),
    "bsd": ("bsd licen[sc]e; bsd style licen[sc]e", "bsd", ""),
}
#: Creative Commons licenses: what follows "attribution", in words and in short form; their versions.
COMMONS = {
    "cc-by": ("", "by"),
    "cc-by-sa": ("(sharealike|share) alike?", "by sa"),
    "cc-by-nd": ("(noderivatives|noderivs|no) (derivatives|derivs|derivative)? works?", "by nd"),
    "cc-by-nc": ("(noncommercial|non) commercial?", "by nc"),
    "cc-by-nc-sa": ("(noncommercial|non) commercial? (sharealike|share) alike?", "by nc sa"),
    "cc-by-nc-nd": ("(noncommercial|non) commercial? (noderivatives|noderivs|no) (derivatives|derivs|derivative)? works?", "by nc nd"),
}
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
#: Addresses, with the versions that they name.
ADDRESSES = {
    "gpl": ("gnu org licenses gpl", "2.0 3.0"),
    "lgpl": ("gnu org licenses lgpl", "2.1 3.0"),
    "agpl": ("gnu org licenses agpl", "3.0"),
    "gfdl": ("gnu org licenses fdl", "1.2 1.3"),
    "apache": ("apache org licenses license", "1.1 2.0"),
    "mpl": ("mozilla org (mpl|en) (us|mpl)? mpl?", "1.1 2.0"),
    "epl": ("eclipse org legal epl", "1.0 2.0"),
    "bsl": ("boost org license", "1.0"),
    "mit": ("opensource org (licenses|license) mit", ""),
    "isc": ("opensource org (licenses|license) isc", ""),
    "bsd-2-clause": ("opensource org (licenses|license) bsd 2 clause", ""),
    "bsd-3-clause": ("opensource org (licenses|license) bsd 3 clause", ""),
    "cc0": ("creativecommons org publicdomain zero", "1.0"),
    "odbl": ("opendatacommons org licenses odbl", "1.0"),
    "unlicense": ("unlicense org", ""),
    "wtfpl": ("wtfpl net", ""),
}
#: Sentences of licenses and notices.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and (or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "permission to use copy modify and (or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted *120 neither the (name|names) of"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0-or-later", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0-or-later", "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("cc0-1.0", "waived all copyright and related or neighboring rights"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("public-domain", "this (work|file|software|code) (is|has) (been)? (in|placed|released|dedicated) (in|into|to)? the public domain"),
    ("all-rights-reserved", "all rights reserved *12 (may|shall) not be (copied|reproduced|distributed|redistributed)"),
    ("proprietary", "(confidential|proprietary) and (confidential|proprietary)? *6 unauthorized (copying|use|distribution) *8 (strictly)? prohibited"),
    ("non-commercial", "for (non|noncommercial) commercial? (use|purposes) only"),
]
#: Words too common to tell that a rule may apply, unless it has no other.
COMMON = frozenset("a all and any are as at be by code commercial common copy database development distribute document domain en express fee file for form free grants has held if in is it just later model modify more no non not notice of on one only open option or original org person public purpose release science service software source style support terms the this to under use used us version want was we will with without work you your zero".split())


@dataclass(frozen=True)
class Rule:
    label: str
    level: int
    tokens: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        """Plain words that the rule needs; the common ones only if there are no others."""
        plain = sorted({t for t in self.tokens.split() if re.fullmatch(r"[a-z0-9]+", t) and not t.isdigit()})
        return [t for t in plain if t not in COMMON] or plain

    @property
    def pattern(self) -> str:
        """Over words that each have a space before and one after; without the first space."""
        out = ""
        for t in self.tokens.split():
            if t[0] == "*":
                out += f"(?: [^ ]+ ){{0,{t[1:]}}}?"
            else:
                group = t.removesuffix("?") if t.startswith("(") else t
                optional = t.endswith("?") and (t.startswith("(") or re.fullmatch(r"[a-z0-9]+\?", t) is not None)
                group = group if t.startswith("(") else t.removesuffix("?") if optional else t
                out += f"(?: {group} )?" if optional else f" {group} "
        return out[1:]


def _of_version(version: str) -> str:
    """Tokens of a version: `3.0` also stands as 3, v3 and version 3."""
    major, _, minor = version.partition(".")
    return f"version? (v|rev|ver)? (v{major}|{major})" + (f" {minor}?" if set(minor) <= {"0"} else f" {minor}")


def _rules() -> Iterator[Rule]:
    for label, phrase in BASE.items():
        yield Rule(label, NAME, phrase, True)
    for label, tokens in SENTENCES:
        yield Rule(label, SENTENCE, tokens)
    parts = lambda said: [x.strip() for x in said.split(";") if x.strip()]
    for label, (names, short, versions) in FAMILIES.items():
        names, short = parts(names), [x.removeprefix("gnu? ") for x in parts(short)]
        for name in names:
            yield Rule(label, NAME, name)
        for s in short:
            yield Rule(label, SENTENCE, f"spdx license identifier {s}")
            yield Rule(label, CONTEXT, f"{s} licen[sc]ed?")
            yield Rule(label, CONTEXT, f"licen[sc]ed? (under|by|as|is)? (the)? {s}")
        for v in versions.split():
            for name in [*names, *short, *[f"{s} licen[sc]e" for s in short]]:
                yield Rule(f"{label}-{v}", VERSION, f"{name} {_of_version(v)}")
                yield Rule(f"{label}-{v}-or-later", VERSION, f"{name} {_of_version(v)} or (at)? (your)? (option)? (any)? (later|newer)")
            major, _, minor = v.partition(".")
            for s in short:
                for glued in (f"{s.replace(' ', '')}{major}", f"{s.replace(' ', '')}v{major}"):
                    yield Rule(f"{label}-{v}", VERSION, f"{glued} {minor}" + "?" * (minor == "0"))
    for label, (rest, short) in COMMONS.items():
        yield Rule(label, NAME, f"creative commons attribution {rest}".strip())
        yield Rule(label, NAME, f"cc {short}")
        yield Rule(label, VERSION, f"creativecommons org licenses {short}")
        for v in COMMONS_VERSIONS.split():
            yield Rule(f"{label}-{v}", VERSION, f"creative commons attribution {rest} {v.replace('.', ' ')}")
            yield Rule(f"{label}-{v}", VERSION, f"cc {short} {v.replace('.', ' ')}")
            yield Rule(f"{label}-{v}", SENTENCE, f"creativecommons org licenses {short} {v.replace('.', ' ')}")
    for label, (address, versions) in ADDRESSES.items():
        yield Rule(label, VERSION, address)
        for v in versions.split():
            yield Rule(f"{label}-{v}", SENTENCE, f"{address} (v)? {v.partition('.')[0]} {v.partition('.')[2]}" + "?" * v.endswith(".0"))


RULES = list(_rules())
KEYWORDS = sorted({w for r in RULES for w in r.words})
_KIND = "array<struct<id:int,level:int,base:boolean,label:string,score:double,pattern:string,words:array<string>>>"
FOUND = "array<struct<s:int,ne:int,nl:int,id:int>>"


def rules() -> Column:
    """The table of rules as one constant."""
    body = [{"id": k, "level": r.level, "base": r.base, "label": r.label, "score": CONFIDENCE[r.level], "pattern": r.pattern, "words": r.words} for k, r in enumerate(RULES)]
    return F.from_json(F.lit(json.dumps(body)), _KIND)


def words_of(text: Column) -> Column:
    """The words, parted by one space."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(lowered, BETWEEN, " "))


def places(spaced: Column, rule: Column) -> Column:
    """s, ne, nl, id of a rule's matches, leftmost and not overlapping: first word, minus the end, minus the level."""
    pattern = F.concat(F.lit(" ("), rule["pattern"], F.lit(")"))
    parts = F.split(F.trim(F.regexp_replace(spaced, pattern, F.lit(f" {MARK}$1"))), "  ")
    starts = F.filter(F.transform(parts, lambda w, i: F.when(w.startswith(MARK), i)), lambda i: i.isNotNull())
    sizes = F.transform(F.regexp_extract_all(spaced, pattern, F.lit(0)), lambda m: ((F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit("")))) / 2).cast("int"))
    span = lambda s, n: F.struct(s.alias("s"), (-s - n).alias("ne"), (-rule["level"]).alias("nl"), rule["id"].alias("id"))
    return F.when(F.rlike(spaced, pattern), F.zip_with(starts, sizes, span)).otherwise(F.array().cast(FOUND))


def uncovered(found: Column, table: Column) -> Column:
    """Of detections in order those that no other of the same or a higher level covers, and all base ones."""

    def step(acc, x):
        level, end = -x["nl"], -x["ne"]
        kept = (F.element_at(acc["top"], level) < end) | F.element_at(table, x["id"] + 1)["base"]
        top = F.transform(acc["top"], lambda t, k: F.when(k < level, F.greatest(t, end)).otherwise(t))
        return F.struct(top.alias("top"), F.when(kept, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    def run(acc, part):
        here = F.struct(acc["top"].alias("top"), F.array().cast(FOUND).alias("out"))
        return F.aggregate(part, here, step, lambda r: F.struct(r["top"].alias("top"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(RUN)), lambda k: F.slice(found, k, F.lit(RUN)))
    zero = F.struct(F.array(*[F.lit(0)] * SENTENCE).alias("top"), F.array().cast(f"array<{FOUND}>").alias("out"))
    return F.aggregate(parts, zero, run, lambda acc: F.flatten(acc["out"]))


def scan(docs: DataFrame, text: str = "text", name: str = "licenses") -> DataFrame:
    """docs with n_words and `name`, an array of struct(start, end, label, level, score, base) of words, by start."""
    own = f"_{uuid.uuid4().hex}_"  # names that no column has
    kept = [c for c in docs.columns if c not in ("n_words", name)]
    table = rules()
    docs = docs.withColumn(f"{own}words", words_of(F.col(text)))
    docs = docs.withColumn(f"{own}list", F.split(f"{own}words", " "))
    met = F.array_intersect(f"{own}list", F.from_json(F.lit(json.dumps(KEYWORDS)), "array<string>"))
    docs = docs.withColumns({f"{own}met": met, f"{own}n": F.when(F.col(f"{own}words") == "", 0).otherwise(F.size(f"{own}list")).cast("long")})
    some = F.filter(table, lambda r: F.size(F.array_except(r["words"], F.col(f"{own}met"))) == 0)
    docs = docs.withColumn(f"{own}some", F.when(F.size(f"{own}met") > 0, some).otherwise(F.array().cast(_KIND)))
    spaced = F.concat(F.lit(" "), F.replace(F.col(f"{own}words"), F.lit(" "), F.lit("  ")), F.lit(" "))
    docs = docs.withColumn(f"{own}spaced", F.when(F.size(f"{own}some") > 0, spaced).otherwise(""))
    docs = docs.withColumn(f"{own}found", F.array_sort(F.flatten(F.transform(f"{own}some", lambda r: places(F.col(f"{own}spaced"), r)))))
    docs = docs.withColumn(f"{own}kept", F.when(F.size(f"{own}found") > 0, uncovered(F.col(f"{own}found"), table)).otherwise(F.array().cast(FOUND)))

    def said(x):
        r = F.element_at(table, x["id"] + 1)
        return F.struct(x["s"].alias("start"), (-x["ne"]).alias("end"), r["label"].alias("label"), r["level"].alias("level"), r["score"].alias("score"), r["base"].alias("base"))

    return docs.select(*kept, F.col(f"{own}n").alias("n_words"), F.transform(f"{own}kept", said).alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("licenses", lambda x: x["base"])
    each = lambda a, c: F.transform(a, lambda x: x[c])
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(each(a, "label"))), ",")
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(each("base", "start")).cast("long").alias("first_word"), F.array_max(each("base", "start")).cast("long").alias("last_word"),
        listed("base").alias("base_labels"), listed("licenses").alias("labels"), F.coalesce(F.array_max(each("licenses", "score")), F.lit(0.0)).alias("score"),
    )


def sql() -> str:
    """The same query; places by the lengths of what is between the matches, covers by pairs."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(r.label)}, {r.level}, {str(r.base).lower()}, {CONFIDENCE[r.level]}::double, {quoted(' ' + r.pattern)}, [{', '.join(map(quoted, r.words))}])" for k, r in enumerate(RULES))
    two = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    listed = "coalesce(string_agg(DISTINCT label, ',' ORDER BY label) {0}, '')"
    return f"""
WITH rules AS (SELECT * FROM (VALUES {values}) v(id, label, level, base, score, pattern, need)),
w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
met AS (SELECT rid, words, list_intersect(words, [{', '.join(map(quoted, KEYWORDS))}]) AS met FROM w),
h AS (SELECT rid, ' ' || array_to_string(words, '  ') || ' ' AS t, id, pattern FROM met, rules WHERE len(met) > 0 AND list_has_all(met, need)),
m AS (SELECT rid, id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (SELECT rid, id, regexp_extract_all(t, pattern) AS ms, regexp_split_to_array(t, pattern) AS gaps FROM h)),
p AS (SELECT rid, id, {two.format("m")} AS n, sum({two.format("gap")} + {two.format("m")}) OVER (PARTITION BY rid, id ORDER BY i ROWS UNBOUNDED PRECEDING)::bigint AS e FROM m),
d AS (SELECT rid, id, label, level, base, score, e - n AS s, e FROM p JOIN rules USING (id)),
k AS (SELECT * FROM d WHERE base OR NOT EXISTS (SELECT 1 FROM d o WHERE o.rid = d.rid AND o.s <= d.s AND o.e >= d.e AND o.level >= d.level AND (o.level > d.level OR o.e - o.s > d.e - d.s OR o.id < d.id))),
g AS (SELECT rid, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, {listed.format("FILTER (base)")} AS base_labels, {listed.format("")} AS labels, max(score) AS score FROM k GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM w LEFT JOIN g USING (rid)
"""
