"""Extraction that resumes, and a stream's sink that takes a batch once."""

import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.operators import extraction, scoring
from threadloom.plans import registry, stored  # noqa: F401  adds its queries to the registry
from threadloom.streaming import live


def test_extraction_resumes_with_the_missing_chunks_only(spark, tmp_path):
    rows = spark.createDataFrame([("c" if k % 3 else None, k, f"text {k}") for k in range(40)], "conv_id string, chunk_index int, transcript string").repartition(3)
    seen = tmp_path / "seen"
    seen.mkdir()

    def model(frame, attempt, down=False):
        for k in frame["chunk_index"]:
            if down and k >= 20 or k == 7 or k == 9 and attempt < 3:
                raise ValueError(f"no answer for {k}")
        for k in frame["chunk_index"]:
            (seen / f"{k}-{attempt}-{len(list(seen.glob(f'{k}-{attempt}-*')))}").touch()
        return frame.assign(answer="said " + frame["transcript"])[["conv_id", "chunk_index", "answer"]][frame["chunk_index"] != 11]

    results = extraction.Results(spark, str(tmp_path / "store"), "m1")
    assert {r.error for r in results.table(rows).collect()} == {"pending"}
    results.run(rows, lambda f, a: model(f, a, True), attempts=1, slices=2)
    first = {p.name for p in seen.iterdir()}
    got = {r.chunk_index: r for r in results.table(rows).collect()}
    assert sum(r.answer is not None for r in got.values()) == 17 and got[25].error.startswith("ValueError")
    results.run(rows, model, attempts=3, slices=2)
    got = {r.chunk_index: r for r in results.table(rows).collect()}
    assert len(got) == 40 and {k for k, r in got.items() if r.answer is None} == {7, 11}
    assert (got[7].attempts, got[9].attempts, got[25].attempts, got[3].attempts) == (3, 3, 2, 1) and got[11].error == "no answer" and got[9].answer == "said text 9"
    assert not [p for p in seen.iterdir() if int(p.name.split("-")[0]) < 20 and int(p.name.split("-")[0]) not in (7, 9, 11) and p.name not in first]
    assert results.run(rows, model, attempts=3) == 0
    changed = rows.withColumn("transcript", F.when(F.col("chunk_index") == 3, "new").otherwise(F.col("transcript")))
    assert [r.chunk_index for r in results.missing(changed, 3).collect()] == [3]
    results.run(rows.limit(0), model)


def test_a_batch_counts_once_however_often_it_comes(spark, tmp_path):
    sink = live.Sink(spark, str(tmp_path), "s")
    with pytest.raises(FileNotFoundError):
        sink.table()
    batch = lambda k: spark.range(k * 10, k * 10 + 10)
    assert [sink(batch(0), 0), sink(batch(0), 0), sink(batch(1), 1), sink(batch(0), 0)] == [True, False, True, False]
    commit = sink.at.commit
    sink.at.commit = lambda *a, **b: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        sink(batch(2), 2)  # stopped between write and commit
    sink.at.commit = commit
    again = live.Sink(spark, str(tmp_path), "s")
    assert again.table().count() == 20 and again(batch(2), 2) and again.table().count() == 30
    again.compact()
    assert sorted(r.id for r in again.table().collect()) == list(range(30)) and not again(batch(2), 2) and again(batch(3), 3)
    assert again.table().count() == 40


def test_a_stopped_stream_goes_on_without_double_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(60).repartition(6).write.parquet(source)
    sink, calls = live.Sink(spark, str(tmp_path), "s"), []

    def once(batch, k):
        sink(batch, k)
        calls.append(k)
        if len(calls) == 2:
            raise RuntimeError("stopped after the commit, before Spark's own")

    def start(f):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(source)
        return stream.writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="stopped"):
        start(once).awaitTermination()
    start(once).awaitTermination()
    assert calls[1] == calls[2] == 1 and sorted(r.id for r in sink.table().collect()) == list(range(60))


def test_hashed_draws_follow_a_poisson_law(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("profile")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(199))))
    n = {r.w: r.n for r in scoring.hashed_weights(rows).groupBy(F.col("weight").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert all(abs(n[k] / 40_000 - p) < 0.01 for k, p in enumerate([0.3679, 0.3679, 0.1839, 0.0613])) and abs(sum(k * v for k, v in n.items()) / 40_000 - 1) < 0.02


def test_paired_bootstrap_of_a_method_with_itself_and_with_a_worse_one(spark):
    rows = [(f"c{k}", f"p{k % 10}", "d", k % 3, k % 3 if k % 4 else (k + 1) % 3) for k in range(200)]
    a = spark.createDataFrame(rows, "case_id string, profile string, dim string, gold int, pred int")
    same = scoring.paired_bootstrap(a, a, repeats=50).first()
    worse = scoring.paired_bootstrap(a, a.withColumn("pred", F.lit(0)), repeats=50).first()
    assert (same.low, same.high) == (0, 0) and 0.2 < worse.low < 5 / 12 < worse.high < 0.6


def test_a_round_reads_its_chunks_once(spark, tmp_path):
    count = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            count.add(len(f))
            yield f

    rows = spark.range(40).selectExpr("'c' AS conv_id", "int(id) AS chunk_index", "string(id) AS transcript").mapInPandas(seen, "conv_id string, chunk_index int, transcript string")
    results = extraction.Results(spark, str(tmp_path / "store"), "m1")
    done = results.run(rows, lambda f, a: f.assign(answer="x")[["conv_id", "chunk_index", "answer"]][(f["chunk_index"] % 2 == 0) | (a > 1)], attempts=3, slices=4)
    assert done == 8 and count.value == 40 and results.missing(rows, 3).isEmpty()


def test_rows_tried_alone_cost_little_beside_the_extractor(spark, tmp_path):
    rows = spark.range(300).selectExpr("CASE WHEN id % 3 > 0 THEN 'c' END AS conv_id", "int(id) AS chunk_index", "string(id) AS transcript").coalesce(1)
    calls = [0]

    def count(*_):
        calls[0] += 1

    def model(frame, attempt):
        sys.setprofile(None)
        if len(frame) > 1 or frame["chunk_index"].iloc[0] == 7:
            raise ValueError("not these")
        n, calls[0] = calls[0], 0
        out = pd.DataFrame({"conv_id": frame["conv_id"], "chunk_index": frame["chunk_index"], "answer": [f"{frame['transcript'].iloc[0]} {n}" if frame["chunk_index"].iloc[0] != 9 else None]})
        if frame["chunk_index"].iloc[0] < 290:
            sys.setprofile(count)
        return out

    results = extraction.Results(spark, str(tmp_path / "store"), "m1")
    results.run(rows, model, attempts=1, slices=1)
    got = {r.chunk_index: r for r in results.table(rows).collect()}
    assert (got[7].error, got[9].error) == ("ValueError: not these", "no answer")
    told = {k: r.answer.split() for k, r in got.items() if k not in (7, 9)}
    assert len(told) == 298 and all(x[0] == str(k) for k, x in told.items())
    between = sorted(int(x[1]) for x in told.values())
    assert 0 < between[len(between) // 2] < 1500  # calls made between two rows


@pytest.mark.parametrize("some", [True, False])
def test_resumed_extraction_equals_its_sql_on_odd_rows(spark, tmp_path, some):
    """Null and empty texts, null sources and ids (last, one to a source), and no rows at all."""
    source = "CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'b' ELSE 'a' END AS source"
    rows = spark.range(600).selectExpr("nullif(id, CASE WHEN id < 3 THEN id END) AS doc_id", source, "CASE id % 13 WHEN 7 THEN NULL WHEN 8 THEN '' ELSE repeat('é', int(id % 97)) END AS text")
    rows.where(F.lit(some)).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["resumed_extraction"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(registry.ORACLES["resumed_extraction"])
        names = [d[0] for d in want.description]
        assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == sorted(map(repr, want.fetchall()))
