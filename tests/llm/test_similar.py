import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from tests.llm.rows import awkward, empty
from threadloom.llm import shared, simhash, similar


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_components(rows):
    """rows: (id, text); the smallest id reachable over pairs of similarity 0.8, by an index of all shingles."""
    sets, lists, root = [plain_set(t) for _, t in rows], {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        met = {}
        for x in s:
            for j in lists.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            lists[x].append(i)
        for j, n in met.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((-1 if i is None else i, least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(similar.groups(docs)) == plain_components([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    rows = awkward(spark)
    assert got(similar.groups(rows)) == plain_components([(r.doc_id, r.text) for r in rows.collect()])
    assert similar.groups(empty(spark)).count() == 0


def _edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(5, len(words) - 5), n):
        out[at] = "".join(rng.choice("abcdefgh") for _ in range(9))
    return out


def test_stage_removes_edited_copies_and_chains(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(300)]
        chain = _edited(rng, words, 5)
        rows += [(10 * k, words), (10 * k + 1, _edited(rng, words, 4)), (10 * k + 2, chain), (10 * k + 3, _edited(rng, chain, 5)), (10 * k + 4, _edited(rng, words, 40))]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, c in plain_components([r[:2] for r in rows]) if i == c}
    assert {10 * k + 4 for k in range(40)} <= want and not {10 * k + 1 for k in range(40)} & want
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()} == want


def test_long_lists_and_large_trees_give_the_same(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(120)]
    rows = []
    for k in range(150):  # all about 0.7 alike, some more
        words = _edited(rng, base, 2 if k % 3 else 5)
        rows.append((k, " ".join(words)))
        if k % 5 == 0:
            rows.append((1000 + k, " ".join(_edited(rng, words, 1))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert 5 < len({c for _, c in want}) < len(rows) - 20
    for limit, size in ((4096, 2048), (20, 2048), (4096, 30), (10, 10)):
        assert got(similar.groups(docs, limit=limit, size=size)) == want, (limit, size)


def test_one_row_of_each_group_is_first(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(3, text), (9, text), (9, "other words altogether here now"), (3, text), (None, text + " x"), (None, "alone " * 9), (None, "alone " * 9)]
    out = similar.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((str(r.doc_id), r.component_id, r.first) for r in out), key=str) == [("3", 3, True), ("3", 3, True), ("9", 3, False), ("9", 9, True), ("None", 3, False), ("None", None, True), ("None", None, True)]


def test_stage_keeps_one_document_where_ids_repeat(spark):
    text = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(3, text), (9, text), (9, other), (9, other), (None, text + " x"), (None, "alone " * 9), (None, "alone " * 9)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_near_duplicates(spark, docs, "ids").collect()
    assert sorted((str(r.doc_id), r.text[:5]) for r in kept) == [("3", "w0 w1"), ("9", "v0 v1"), ("None", "alone")]


def test_fingerprint_links_come_first(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(2000)]
    rows = [(k, " ".join(_edited(rng, base, 1) if k else base)) for k in range(6)] + [(9, " ".join(base[:1200])), (10, "other words"), (11, "no word of those at all")]
    texts = similar._texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    marks = similar.sketches(texts).cache()
    for r in marks.collect():
        text = dict(rows)[r.doc_id].encode()
        assert r.fp & (1 << 64) - 1 == simhash.majority(similar.shingles(text))
    of = {r.node: r.doc_id for r in marks.collect()}
    met = [{of[r.a], of[r.b]} for r in similar.fingerprint_links(marks, texts).collect()]
    assert met and all(m <= set(range(6)) for m in met)
    # Where the sketches of no two texts meet, these links are still there; where they do, the classes are those of the texts.
    blind = marks.withColumn("keys", F.array(F.col("node")))
    roots = {of[r.node]: r.root for r in similar.links(blind, texts).collect()}
    assert len(roots) >= 2 and set(roots) <= set(range(6))
    assert got(similar.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_components(rows)


def test_components_stop_as_soon_as_all_are_stars(spark):
    def tables(edges):
        with shared.scope() as made:
            found = shared.components(spark.createDataFrame(edges, "a long, b long"))
            rows = sorted(tuple(r) for r in found.collect())
        names = [p.rpartition("/")[2].rpartition("-")[0] for p in made.paths]
        made.free(spark)
        return rows, names

    stars = [(1, 5), (6, 1), (7, 1), (2, 3), (3, 2), (4, 4)]
    assert tables(stars) == ([(1, 1), (2, 2), (3, 2), (5, 1), (6, 1), (7, 1)], ["edges", "least"])
    chain = [(k, k + 1) for k in range(20)] + [(40, 30), (40, 31), (31, 32)]
    assert tables(chain)[0] == [(k, 0) for k in range(21)] + [(k, 30) for k in (30, 31, 32, 40)]
    assert tables([]) == ([], ["edges", "least"])
