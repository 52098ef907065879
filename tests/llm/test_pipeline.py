import corpus_pipeline as pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_packing import check
from tests.llm.test_passages import plain_spans
from tests.llm.test_quality import plain_verdicts
from tests.llm.test_similar import plain_components
from threadloom.llm import shared, toxicity
from threadloom.llm.queries import op2_js_quality, op7_mixture_packing

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_score(model, text):
    words = list(dict.fromkeys(text.lower().split()))
    if not words:
        return 0.0
    vector = sum(np.mean([model.embedding[g] for g in toxicity.grams(w)], axis=0) for w in words) / (8 + len(words) ** 0.75)
    logits = vector @ model.weights + model.bias
    return float(np.exp(logits[1] - logits.max()) / np.exp(logits - logits.max()).sum())


def test_every_stage_against_a_plain_version(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if k < 4:
            assert out.columns == NAMES
        got = {r.doc_id: r for r in rows}
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert got == {r.doc_id: r for r in before if plain_score(model, r.text or "") < 0.3}
        if name == "quality":
            kept = {v[0] for v in plain_verdicts(before) if v[-1]}
            assert got == {r.doc_id: r for r in before if r.doc_id in kept}
        if name == "near_duplicates":
            kept = {c for _, c in plain_components([(r.doc_id, r.text) for r in before])}  # five words, similarity of 0.8 or more
            assert got == {r.doc_id: r for r in before if r.doc_id in kept}
        if name == "passages":
            assert got.keys() == {r.doc_id for r in before}
            gone = {}
            for i, a, z, _, _ in plain_spans([(r.doc_id, r.text) for r in before]):
                gone.setdefault(i, []).append((a, z))
            for r in before:
                t = r.text
                for a, z in sorted(gone.get(r.doc_id, []), reverse=True):
                    t = t[:a] + t[z:]
                assert got[r.doc_id].text == t and got[r.doc_id].n_chars == len(t)
        if name == "packing":
            check(rows, before)
        docs = out


def test_awkward_and_empty_tables_pass_through(spark, tmp_path):
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", None, len(long)), (3, long, "en", None, len(long)), (None, long + " x", "en", "s", None), (4, long.upper() + " zz yy", None, "s", 1)]
    for k, data in enumerate((rows, [])):
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumn("token", F.lit(1)).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
        out = pipeline.run(spark, sf)
        assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
        assert (out.count() > 0) == (k == 0)


def test_a_run_leaves_other_results_alone(spark, sf):
    judged = op2_js_quality(spark, sf)
    packed = op7_mixture_packing(spark, sf)
    first = pipeline.run(spark, sf)
    second = pipeline.run(spark, sf)
    assert judged.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and packed.count() > 0
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_a_scope_frees_its_own_tables_only(spark):
    outer = shared.written(spark.range(3).toDF("x"), "outer")
    with shared.scope() as made:
        inner = shared.written(spark.range(4).toDF("x"), "inner")
    assert outer.count() == 3 and inner.count() == 4 and len(made.paths) == 1
    made.free(spark)
    assert outer.count() == 3 and not made.paths
