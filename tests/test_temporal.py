"""Joins by time and sessions, against brute force, at cuts and ties, and replayed as a stream in another order."""

import datetime
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import temporal
from quillspark.streaming import sessions

DAY = datetime.datetime(2024, 1, 1)


def at(seconds):
    return DAY + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize("span", [1_000_000, 7])
def test_as_of_join(spark, span):
    rng = random.Random(1)
    left = [(k, rng.choice("aaab"), at(rng.randrange(100))) for k in range(80)] + [(80, None, at(5)), (81, "a", None), (82, "zz", at(5)), (83, "a", at(-9))]
    right = [(k, rng.choice("aaac"), at(rng.randrange(100)), f"v{k}") for k in range(60)] + [(60, None, at(1), "x"), (61, "a", None, "y")]
    a, b = spark.createDataFrame(left, "id long, k string, t timestamp"), spark.createDataFrame(right, "id long, k string, t timestamp, v string")
    got = {r["id"]: (r["right_id"], r["right_v"]) for r in temporal.as_of(a, b, ["k"], "t", "id", span=span).collect()}
    want = {}
    for i, k, t in left:
        before = [r for r in right if k is not None and r[1] == k and t is not None and r[2] is not None and r[2] <= t]
        want[i] = (lambda r: (r[0], r[3]))(max(before, key=lambda r: (r[2], r[0]))) if before else (None, None)
    assert got == want
    assert temporal.as_of(a.limit(0), b, ["k"], "t", "id").count() == 0 and temporal.as_of(a, b.limit(0), ["k"], "t", "id").where("right_id is not null").count() == 0


@pytest.mark.parametrize("kind", ["long", "double"])
def test_interval_join(spark, kind):
    rng = random.Random(2)
    number = (lambda x: x) if kind == "long" else (lambda x: x / 8)
    some = lambda n: [(k, rng.choice("ab"), number(s := rng.randrange(-300, 300)), number(s + rng.choice([0, 1, 2, 7, 50, 64, 500]))) for k in range(n)]
    a, b = [*some(120), (999, None, number(0), number(10)), (998, "a", None, number(10))], some(120)
    frame = lambda rows: spark.createDataFrame(rows, f"id long, k string, s {kind}, e {kind}")
    got = temporal.overlaps(frame(a), frame(b), ["k"], "s", "e")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and None not in x and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    assert sorted(tuple(r) for r in got.select("id", "right_id").collect()) == want and len(want) > 1000
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_sessions_of_a_stream_in_another_order(spark, tmp_path):
    """Rows arrive out of order within the delay: the sessions are those of the batch; what is later than the delay comes
    out as late, and no session has it."""
    rng = random.Random(3)
    rows = sorted(((rng.randrange(5), at(rng.randrange(20 * 86400))) for _ in range(800)), key=lambda r: r[1])
    order = [rows[k] for _, k in sorted((k + rng.random() * 60, k) for k in range(len(rows)))]
    late = [(7, at(3600)), (1, at(7200)), (1, at(7200))]  # in the middle of it, weeks behind but within the grace
    files = [order[k : k + 100] for k in range(0, 800, 100)]
    files[6] = files[6] + late
    files.append([(-1, at(400 * 86400))])  # time passes
    source = tmp_path / "in"
    source.mkdir()
    for k, part in enumerate(files):
        path = source / f"{k:03d}.parquet"
        pd.DataFrame({"user_id": [u for u, _ in part], "ts": pd.to_datetime([t for _, t in part], utc=True)}).to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    made = sessions.sessionized(stream, 3 * 3600, 5 * 86400, 60 * 86400)
    made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["user_id"], r["first"]) for r in out if r["kind"] == "late") == sorted(late)
    batch = temporal.sessions(spark.createDataFrame(rows, "user_id long, ts timestamp"), ["user_id"], "ts", 3 * 3600).collect()
    assert sorted(tuple(r) for r in batch) == sorted((r["user_id"], r["first"], r["last"], r["n"]) for r in out if r["kind"] == "session" and r["user_id"] >= 0)


def test_sessions_merge():
    open_ = []
    for t in (0, 100, 50, 25, 75):
        open_ = sessions.merged(open_, t, 30)
    assert open_ == [[0, 100, 5]]
    assert sessions.merged([[0, 10, 2]], 40, 30) == [[0, 10, 2], [40, 40, 1]]


def test_sessions_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "user_id long, ts timestamp")
    assert temporal.sessions(df, ["user_id"], "ts", 5).count() == 0 and df.select(F.count("*")).first()[0] == 1
