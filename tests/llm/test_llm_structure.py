"""License signatures, conversation repair and the Merkle manifest against brute force, their SQL, and odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from quillspark.llm import chat_repair, license_scan, merkle, registry
from quillspark.llm.common import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, " \n\t", "en", None, 3), (4, "one\ntwo", "en", "s", 7), (4, "one\ntwo", "en", "s", 7), (None, "x\ny", "de", "t", 27), (9, "q", "en", "", 1)]
ODD += [(k, "a\nb", "en", "u", 3) for k in range(40)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", ["op11_license_signatures", "op12_viterbi_repair", "op13_merkle_manifest"])
def test_equals_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE[name])
    assert want.columns == got.columns and ordered(got.collect()) == ordered(want.fetchall())


# licenses


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER)))


def license_row(doc_id, text):
    """Every rule, word by word from every place, and covers by pairs."""
    w = words(text)
    spaced = "".join(f" {x} " for x in w)
    found = []
    for k, r in enumerate(license_scan.RULES):
        at = 0
        while m := re.compile(f" {r.pattern}").search(spaced, at):
            start, at = len(spaced[: m.start()].split()), m.end()
            found.append((start, start + len(m[0].split()), r.level, k))
    covers = lambda a, b: a[0] <= b[0] and a[1] >= b[1] and a[2] >= b[2] and (a[2] > b[2] or a[1] - a[0] > b[1] - b[0] or a[3] < b[3])
    rules = license_scan.RULES
    kept = [x for x in found if rules[x[3]].base or not any(covers(o, x) for o in found)]
    base = [x for x in kept if rules[x[3]].base]
    listed = lambda xs: ",".join(sorted({rules[x[3]].label for x in xs}))
    score = max((license_scan.CONFIDENCE[x[2]] for x in kept), default=0.0)
    return doc_id, len(w), len(base), min((x[0] for x in base), default=None), max((x[0] for x in base), default=None), listed(base), listed(kept), score


SAID = [
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "GNU General Public License, version 2 or (at your option) any later version. MIT License. gnu lesser general public licence v2.1",
    "Licensed under the Apache License, Version 2.0",
    "http://creativecommons.org/licenses/by-nc-sa/4.0/ CC BY-NC 4.0 cc by cc by",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided x. Neither the name of",
    "mit freundlichen Grüßen, ÉÀ license\u0085x",
    "\x00\x01",
    "MIT\nLicense gnu general public\tlicense.Apache license " * 3,
]


def test_licenses_equal_brute_force(spark, tmp_path):
    assert len(license_scan.RULES) > 300 and all(r.words for r in license_scan.RULES)
    rows = [(100 + k, t, "en", "s", 1) for k, t in enumerate(SAID)] + ODD
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert ordered(license_scan.query(spark, str(tmp_path)).collect()) == ordered(license_row(r[0], r[1]) for r in rows)
    assert ordered(license_scan.query(spark, SF).collect()) == ordered(license_row(*r) for r in docs)
    labels = {r["doc_id"]: r["labels"] for r in license_scan.query(spark, str(tmp_path)).collect() if r["doc_id"] in (100, 102, 104)}
    assert labels == {100: "gpl,gpl-3.0-or-later", 102: "apache,apache-2.0", 104: "bsd-3-clause"}


def test_licenses_clashing_columns_and_long_texts(spark):
    rows = [("l", "b", 7, "mit license " * 20_000), ("l", "b", 7, "word " * 400_000 + "apache license version 2.0"), ("l", "b", 7, None)]
    df = spark.createDataFrame(rows, "licenses string, base string, n_words int, text string")
    got = license_scan.scan(df).collect()
    assert [r["n_words"] for r in got] == [40_000, 400_005, 0]
    assert [sum(x["base"] for x in r["licenses"]) for r in got] == [20_000, 1, 0] and {r["base"] for r in got} == {"b"}
    assert license_scan.scan(df.limit(0)).count() == 0


# conversations


def cheapest(rows):
    """(cost, audit, turns) by a search over all edits."""
    best = []

    def go(i, state, cost, audit, turns, inserted):
        if best and cost > best[0][0]:
            return
        if i == len(rows) and state in "-a":
            best[:] = [min([(cost, audit, turns), *best], key=lambda x: x[:2])]
        need = "assistant" if state == "u" else "user"
        if inserted < 2:
            go(i, need[0], cost + 3, audit + "I", (*turns, (need, "")), inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, state, cost + 4, audit + "D", turns, 0)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                go(i + 1, need[0], cost + 3 + more, audit + "R", (*turns, (need, text)), 0)
                if role[:1] == need[0] or (role[:1] == "s" and state == "-"):
                    go(i + 1, role[:1], cost + more, audit + "K", (*turns, (role, text)), 0)

    go(0, "-", 0, "", (), 0)
    return best[0]


def test_repair_equals_search():
    rng = random.Random(1)
    for _ in range(600):
        rows = [(rng.choice(["system", "user", "assistant", "x", "", "us"]), rng.choice("pqrs") * 2, rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(6))]
        repair = chat_repair.Repair()
        for role, text, fault in rows:
            repair.row(role, text.encode(), fault)
        cost, way, sha = repair.best()
        want = cheapest(rows)
        assert (cost, chat_repair.audit(way)) == want[:2] and sha == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in want[2]).encode()).hexdigest()
        turns = []
        for k, code in enumerate(way):
            stays, roles = chat_repair.turns_of(code, k == 0)
            turns += [(role or rows[k - 1][0], rows[k - 1][1] if stays and j == 0 else "") for j, role in enumerate(roles)]
        assert tuple(turns) == want[2]


def test_repair_of_long_conversations():
    repair = chat_repair.Repair()
    for _ in range(50_000):
        repair.row("x", b"text", "")
    cost, way, _ = repair.best()
    assert cost == 150_000 and chat_repair.audit(way) == "R" * 50_000


def repair_rows(turns):
    """The whole query, row by row."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv] += []
        said = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        by[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in by.items():
        rows = sorted(rows)
        judged, seen = [], set()
        for _, _, role, text in rows:
            rest = text.rstrip(chat_repair.SPACES)
            judged.append((role, text, "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""))
            seen.add((role, text))
        known = [t for k, t, _, _ in rows if k]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        count = lambda f: sum(x[2] == f for x in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        repair = chat_repair.Repair()
        for role, text, fault in judged:
            repair.row(role, text.encode(), fault)
        cost, way, sha = repair.best()
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, chat_repair.audit(way), sha))
    return out


def test_repair_query_equals_rows(spark):
    rng = random.Random(2)
    odd = [(1, None, None, None), (1, 0, "user", "a."), (1, 0, "user", "a."), (None, 1, "user", "q?"), (None, 2, "assistant", "w."), (2, 5, "system", "x"), (2, 9, "assistant", "y.  "), (3, 7, "", "z."), (3, 8, "user", "")]
    odd += [(9, k % 7, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "c! ", "\n"])) for k in range(60)] + [(10, k, "user", "same.") for k in range(300)] + [(11, 1, "assistant", "long. " * 200_000)]
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as fault", "2 as dropped", "3 as nr")
    assert ordered(chat_repair.repairs(chat_repair.damaged(df)).collect()) == ordered(repair_rows(odd))
    assert chat_repair.repairs(chat_repair.damaged(df.limit(0))).count() == 0
    turns = defaultdict(list)
    for r in chat_repair.repaired(chat_repair.damaged(df)).collect():
        turns[r["conv_id"]].append((tuple(r["pos"]), f"{r['role']}:{r['text']}"))
    for r in chat_repair.repairs(chat_repair.damaged(df)).collect():
        assert hashlib.sha256("\n".join(t for _, t in sorted(turns[r["conv_id"]])).encode()).hexdigest() == r["repaired_sha256"]


# manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root, and for each leaf what stands before and after it, level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, path in enumerate(paths):
            run, place = runs[at[k] // 3], at[k] % 3
            path.append((run[:place], run[place + 1 :]))
            at[k] //= 3
        level = [H(*run) for run in runs]
    return level[0], paths


def manifest_rows(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(((r[0] is not None, r[0] or 0, leaf(r, r[1])), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = [sorted(by[s], key=lambda x: x[0]) for s in names]
    trees = [tree([key[2] for key, _ in part]) for part in own]
    root, top = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for part, (subroot, paths), above in zip(own, trees, top, strict=True):
        for ((_, _, digest), r), path in zip(part, paths, strict=True):
            node = digest
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = leaf(r, r[1].replace("\n", ""))
            for before, after in path + above:
                node = H(*before, node, *after)
            out.append((r[0], digest, subroot, root, H(*(x for a, b in path + above for x in a + b)), node, node == root))
    return out


@pytest.mark.parametrize("part", ["true", "source = 'u'", "doc_id = 9", "source is null", "doc_id < 0"])
def test_manifest_equals_rows(spark, part):
    df = spark.createDataFrame(ODD, DOC).where(part)
    rows = [tuple(r) for r in df.collect()]
    clash = df.selectExpr("*", "1 as grp", "2 as pos", "3 as n", "4 as node", "5 as leaf", "6 as proof")
    assert ordered(merkle.manifest(clash).collect()) == ordered(manifest_rows(rows))


def test_manifest_of_documents_and_several_files_a_task(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        got = merkle.query(spark, SF).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert ordered(got) == ordered(manifest_rows(rows))
    assert 0 < sum(r["verified"] for r in got) < len(got)
