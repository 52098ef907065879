import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.rows import awkward, empty
from threadloom.llm import shared, toxicity
from threadloom.llm.queries import op10_subword_toxicity


def _corpus(rng, n):
    plain = [f"{a}{b}" for a in ("bel", "cor", "dan", "fir", "gol", "mer") for b in ("an", "ith", "os", "une", "ard", "ely")]
    bad = ["grumblix", "snarfule", "vexodor"]
    texts, labels = [], []
    for k in range(n):
        words = list(rng.choice(plain, rng.integers(20, 120)))
        if k % 2:
            words[rng.integers(len(words))] = str(rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(k % 2)
    return texts, np.array(labels)


def test_held_out_accuracy_and_unseen_spellings():
    rng = np.random.default_rng(2)
    texts, labels = _corpus(rng, 400)
    m = toxicity.fit(texts, labels)
    score = toxicity.Scorer(m.margins(), float(m.bias[1] - m.bias[0]))
    more, y = _corpus(rng, 300)
    p = np.array([score(t) for t in more]) >= 0.3
    assert (p == y).mean() > 0.97
    assert score("belan corith grumblixxes danos meruna golard") > 0.3 > score("belan corith danos meruna golard")
    assert score("") == 0.0


def test_one_class_and_nothing_to_learn_from():
    assert toxicity.fit([], np.array([])).margins().max() == 0
    assert toxicity.fit(["a b", "c"], np.array([0, 0])).margins().max() == 0


def test_scores_equal_plain_averages_of_embeddings():
    rng = np.random.default_rng(3)
    texts, labels = _corpus(rng, 200)
    m = toxicity.fit(texts, labels)
    score = toxicity.Scorer(m.margins(), float(m.bias[1] - m.bias[0]))
    for t in [*texts[:20], "Grumblix!! grumblix x", "é \U0001f600", "one"]:
        words = list(dict.fromkeys(t.lower().split()))
        vector = sum(np.mean([m.embedding[g] for g in toxicity.grams(w)], axis=0) for w in words) / (8 + len(words) ** 0.75)
        logits = vector @ m.weights + m.bias
        soft = np.exp(logits - logits.max())
        assert abs(score(t) - soft[1] / soft.sum()) < 1e-9


def test_counts_and_gradient_equal_plain_ones():
    rng = np.random.default_rng(4)
    texts, y = _corpus(rng, 40)
    c = toxicity._Corpus(texts)
    held = c.holding(np.array(y), 2, 7)
    sets = [{g for w in t.lower().split() for g in toxicity.grams(w)} for t in texts]
    for g in rng.choice(sorted(set.union(*sets)), 50):
        assert held[1, g] == sum(g in s for s, k in zip(sets, y, strict=True) if k == 1) and held[0, g] == sum(g in s for s, k in zip(sets, y, strict=True) if k == 0)
    q, g = rng.normal(size=toxicity.BUCKETS), rng.normal(size=len(texts))
    pull = c.pull(g)
    for k in rng.choice(sorted(set.union(*sets)), 20):
        step = np.zeros(toxicity.BUCKETS)
        step[k] = 1e-3
        assert abs((c.margins(q + step) @ g - c.margins(q) @ g) / 1e-3 - pull[k]) < 1e-6


def test_scores_do_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = []
    for n in (3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            rows = docs.repartition(n)
            got.append(sorted((r.doc_id, r.score) for r in toxicity.scores(rows, toxicity.train(rows, labels.repartition(n))).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_conflicting_labels_and_ids_have_one_rule(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (3, "c"), (3, None)], "doc_id long, text string").withColumn("toxic", F.lit("x"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, None), (3, 0), (3, 0)], "doc_id long, toxic int").withColumn("text", F.lit("y"))
    assert sorted((r.i, r.text, r.toxic) for r in toxicity.sample(docs, labels).collect()) == [(1, "a", 1), (3, "c", 0)]


def test_few_labels_find_half_of_the_held_out_toxic_texts(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in op10_subword_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    found = sum(p and t for p, t in held)
    assert found >= 0.5 * sum(t for _, t in held) and found >= 0.8 * sum(p for p, _ in held)


def test_query_rows(spark, sf):
    got = op10_subword_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (None, 1, 1), (9, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    rows = awkward(spark)
    m = toxicity.train(rows, labels)
    got = toxicity.scores(rows, m, keep=("text", "size")).collect()
    assert len(got) == rows.count() and all(r.score == 0 for r in got if not (r.text or "").split())
    assert toxicity.scores(empty(spark), m).count() == 0
    clashing = rows.withColumn("read", F.lit(1)).withColumn("score", F.lit("x")).withColumn("_read", F.lit(1))
    assert sorted(r.score for r in toxicity.scores(clashing, m, keep=("read", "_read")).collect()) == sorted(r.score for r in got)
    with pytest.raises(ValueError, match="score"):
        toxicity.scores(clashing, m, keep=("score",))
    assert toxicity.train(empty(spark), labels).margins().max() == 0


def test_a_fit_and_its_counts_hold_little_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)
    texts, y = _corpus(rng, 60)
    c, most = toxicity._Corpus(texts), []
    made = toxicity._Corpus._buckets
    monkeypatch.setattr(toxicity._Corpus, "_buckets", lambda self, words: most.append(int(self.sizes[words].sum())) or made(self, words))
    whole = c.holding(np.array(y), 2, 1 << 30)
    assert len(most) == 1
    largest = max(int(c.sizes[c.word[c.doc == k]].sum()) for k in range(60))
    assert (c.holding(np.array(y), 2, 3000) == whole).all() and max(most[1:]) <= max(3000, largest) and sum(most[1:]) == most[0]


def test_a_step_without_a_worker_object_lets_go_of_it():
    shared.worker_object("left by another step", dict)
    shared.spare()
    assert not shared._HEAVY
