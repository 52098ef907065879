from threadloom.operators import scoring
from threadloom.plans import registry


def test_draws_in_spark_equal_those_of_the_driver(spark):
    names = [f"s{k:03}" for k in range(150)]
    df = spark.createDataFrame([(p,) for p in [*reversed(names), names[3], None]], "profile string")
    got, want = scoring.drawn_weights(df, 60), scoring.resample_weights(spark, names, 60)
    assert sorted(got.collect()) == sorted(want.collect())
    assert scoring.drawn_weights(df.limit(0), 5).count() == 0


def test_all_sources_are_drawn_and_2000_times(spark, sf, tmp_path, monkeypatch):
    n = 10_001  # only the last source by name has a hit
    docs = [(11 * k + 1, "en", f"s{k:05}", 1) for k in range(n)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(docs[-1][0], 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert registry.QUERIES["bootstrap_interval"](spark, str(tmp_path)).first().high > 0
    seen = []
    monkeypatch.setattr(scoring, "bootstrap_f1", lambda rows, weights: seen.append(weights.select("rep").distinct().count()))
    registry.QUERIES["bootstrap_interval"](spark, sf)
    assert seen == [scoring.REPEATS]
