import math

import numpy as np

from threadloom.llm import ann
from threadloom.llm.queries import op1_stable_kdtree


def brute(rows, every=50, k=5):
    """rows: (vec_id, vector) taking part."""
    out = {}
    m = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    norm = np.sqrt((m * m).sum(1))
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        a = int(np.flatnonzero(ids == q)[0])
        s = m @ m[a] / (norm * norm[a])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {}
    for r in op1_stable_kdtree(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    hits = 0
    vec = dict(rows)
    for q, w in want.items():
        assert sorted(got[q]) == list(range(1, 6))
        hits += len({i for i, _ in w} & {i for i, _ in got[q].values()})
        for i, s in got[q].values():
            a, b = np.array(vec[q], np.float64), np.array(vec[i], np.float64)
            assert math.isclose(s, a @ b / math.sqrt((a @ a) * (b @ b)), abs_tol=1e-12)
    assert hits >= 0.94 * 5 * len(want)


def test_several_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 100)
    monkeypatch.setattr(ann, "SHARD", 60)
    monkeypatch.setattr(ann, "BLOCK", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=24)).tolist()) for i in range(900)] + [(1000 + i, centres[0].tolist()) for i in range(300)]
    want = brute(rows)
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    same = sum(len({i for i, _ in w} & {i for _, i in got[q]}) for q, w in want.items())
    assert same >= 0.95 * 5 * len(want)
    assert [i for _, i in sorted(got[1050])] == [1000, 1001, 1002, 1003, 1004] and [i for _, i in sorted(got[1000])] == [1001, 1002, 1003, 1004, 1005]


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (1, None, "x"), (2, [0.0, 0.0], None), (3, [nan, 1.0], None), (4, [1.0, None], None), (5, [inf, 1.0], None), (6, [], None), (7, [2.0, 0.1], None), (None, [1.0, 1.0], None), (50, [1.0, 2.0, 3.0], None), (0, [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(df).collect()] == [(0, 1, 7)]
    assert ann.search(df.limit(0)).count() == 0


def test_the_stopping_test_leaves_over_half_of_the_vectors_unverified(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows)
    v = np.array([x for _, x in rows], np.float64)
    u = v / np.sqrt((v * v).sum(1))[:, None]
    p = u @ ann.projection(v.shape[1])
    tree, seen, hits = ann.Subtree(p), 0, 0
    at = {i: k for k, (i, _) in enumerate(rows)}
    for q, w in want.items():
        def verify(r, k=at[q]):
            nonlocal seen
            seen += len(r)
            return u[r] @ u[k]

        got = {rows[r][0] for r in tree.nearest(p[at[q]], verify, 6, math.inf, ann.radius())[0]}
        hits += len({i for i, _ in w} & got)
    assert seen < 0.48 * len(want) * len(rows) and hits >= 0.93 * 5 * len(want)


def test_ties_between_vectors_of_one_direction_go_by_id(spark):
    base = np.random.default_rng(5).normal(size=16)
    rows = [(50, base.tolist())] + [(i, (base * 2.0 ** ((i * 7) % 20 - 10)).tolist()) for i in range(1, 21)]
    got = sorted((r["rank"], r.vec_id) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 50").collect())
    assert got == [(k, k) for k in range(1, 6)]


def test_very_large_and_small_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1.1e-200]), (2, [1.0, -1.0]), (3, [1e308, 1e300])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [1, 3, 2] and all(math.isfinite(r.score) for r in got)


def test_chi_square_radius():
    assert abs(ann.chi_square(ann.radius(0.95)) - 0.95) < 1e-9 and abs(ann.radius(0.95, 8) - 15.507) < 1e-2
