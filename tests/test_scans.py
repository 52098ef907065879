"""Two-level scans give the rows of the windows, and no task a whole conversation."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import chunks, messages, scans, sessions

SCHEMA = "conv_id string, original_index int, sender string, epoch double, time_str string, bytes int, session string"


@pytest.fixture(scope="module")
def hot(spark):
    """One conversation with nine tenths of all rows, small ones, and rows without conversation."""
    rng = random.Random(9)
    rows, clock = [], 1_700_000_000
    for k in range(6000):
        conv = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None, "zz"])
        clock += rng.choice([1, 60, 60, 20_000, -5])
        epoch = None if rng.random() < 0.1 else float(clock)
        rows.append((conv, k, rng.choice(["me", "me", "other"]), epoch, rng.choice([None, "2024-01-01 00:00:00", "bad"]), rng.choice([0, 1, 5, 40, 500, None]), "x"))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("time", F.try_to_timestamp("time_str").cast("timestamp_ntz"))
    df = df.withColumn("time", F.when(F.col("time").isNotNull() & F.col("epoch").isNotNull(), F.timestamp_seconds("epoch").cast("timestamp_ntz")))
    return df.cache()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda df: sorted(map(repr, map(tuple, df.select(*cols).collect())))
    assert rows(a) == rows(b)


def test_positions_turns_and_sessions(spark, hot):
    p = messages.positioned(hot)
    same(scans.positioned(hot, 16), p)
    same(scans.turns(p, 16), sessions.turns(p))
    same(scans.gap_sessions(p, ranges=16), sessions.gap_sessions(p))
    same(scans.context_sessions(p, ranges=16), sessions.context_sessions(p))
    same(scans.context_sessions(p, use_epoch=False, ranges=7), sessions.context_sessions(p, use_epoch=False))
    empty = p.limit(0)
    for f in (scans.turns, scans.gap_sessions, scans.context_sessions):
        assert f(empty).count() == 0


def test_a_hot_conversation_lies_in_many_tasks(spark, hot):
    dealt = scans.Scan.of(hot, [F.col("original_index")], ranges=16).rows
    n = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert len(n) >= 12 and max(n) < 3 * sum(n) / len(n)
    inside = scans.Scan.of(hot, [F.col("original_index")], ranges=16).numbered().rows
    plan = inside._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.count("_part") > 2


@pytest.mark.parametrize(("size", "most"), [(5, 400), (1200, 18_000), (7, 10**9), (2**31 - 1, 60), (1, 1), (50, 501)])
def test_chunks_cut_in_blocks(spark, hot, size, most):
    rows = hot.select("conv_id", F.col("original_index").alias("position"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    same(scans.chunked(rows, size, most, ranges=9, block=64), chunks.chunked(rows, size, most))
    assert scans.chunked(rows.limit(0), size, most).count() == 0
