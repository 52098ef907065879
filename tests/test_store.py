"""Revisions, their pointer, results by key, and the stored index."""

import math
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from threadloom.operators import index, retrieval
from threadloom.sources import store


def rows(spark, n, tag):
    return spark.range(n).select("id", F.lit(tag).alias("tag"))


class Killed(BaseException):
    """Ends a writer as a lost process would: nothing is cleaned up."""


def read(pub):
    if pub.entry() is None:
        return None
    tags = {r.tag for t in ("a", "b") for r in pub.table(t).collect()}
    counts = [pub.table(t).count() for t in ("a", "b")]
    assert len(tags) == 1 and counts == [3, 4]
    return tags.pop()


def test_a_publish_killed_at_any_step_leaves_one_whole_revision(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    pub = store.Published(spark, root, "x")
    assert read(pub) is None
    pub.publish({"a": rows(spark, 3, "one"), "b": rows(spark, 4, "one")}, "one")
    steps = ["first table", "second table", "before the pointer", "draft written", "put in place"]
    for k, step in enumerate(steps):
        with monkeypatch.context() as m:
            if k < 2:
                real, seen = type(rows(spark, 1, "x").write).parquet, []

                def parquet(self, path, *a, real=real, seen=seen, k=k, **b):
                    seen.append(path)
                    if len(seen) == k + 1:
                        real(self, f"{path}/_temporary/0", *a, **b)  # some of it has been written
                        raise Killed
                    return real(self, path, *a, **b)

                m.setattr(type(rows(spark, 1, "x").write), "parquet", parquet)
            elif k == 2:
                m.setattr(store.Published, "commit", lambda *a, **b: (_ for _ in ()).throw(Killed()))
            elif k == 3:
                m.setattr(os, "link", lambda *a: (_ for _ in ()).throw(Killed()))
            else:
                link = os.link
                m.setattr(os, "link", lambda *a, link=link: (link(*a), (_ for _ in ()).throw(Killed())))
            with pytest.raises(Killed):
                pub.publish({"a": rows(spark, 3, step), "b": rows(spark, 4, step)}, step)
        assert read(pub) == ("one" if k < 4 else step)
    left = {e.name for e in tmp_path.joinpath("x").iterdir() if e.name.startswith("rev-")}
    assert len(left) == 6 and len(pub.sweep(keep=2, older_s=0)) == 4 and read(pub) == steps[-1]
    pub.publish({"a": rows(spark, 3, "two"), "b": rows(spark, 4, "two")}, "two")
    assert read(pub) == "two" and pub.generations() == [1, 2, 3]


def test_of_two_writers_of_one_generation_one_is_told(spark, tmp_path):
    pub = store.Published(spark, str(tmp_path), "x")
    pub.publish({"a": rows(spark, 3, "zero")}, "zero")
    won, told = [], []

    def write(k):
        mine = store.Published(spark, str(tmp_path), "x")
        try:
            mine.publish({"a": rows(spark, 3, f"w{k}")}, f"w{k}", expected=1)
            won.append(k)
        except store.Conflict:
            told.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(told) == 3 and {r.tag for r in pub.table("a").collect()} == {f"w{won[0]}"}
    assert {r.tag for r in pub.table("a", 1).collect()} == {"zero"}
    assert len([e for e in tmp_path.joinpath("x").iterdir() if e.name.startswith("rev-")]) == 2  # the losers' folders went
    pub.publish({"a": rows(spark, 3, "last")}, "last")
    assert pub.entry()["generation"] == 3 and not [e for e in tmp_path.joinpath("x", store.POINTER).iterdir() if e.name.endswith(".draft")]
    with pytest.raises(FileNotFoundError):
        store.Published(spark, str(tmp_path), "none").table("a")


def test_a_failed_table_takes_its_revision_along(spark, tmp_path):
    pub = store.Published(spark, str(tmp_path), "x")
    bad = rows(spark, 3, "x").select(F.raise_error(F.lit("no")).cast("int").alias("a"))
    with pytest.raises(Exception, match="no"):
        pub.publish({"a": rows(spark, 3, "x"), "b": bad}, "r")
    assert pub.entry() is None and not list(tmp_path.glob("x/rev-*"))


def test_results_are_made_once_for_a_key(spark, tmp_path):
    made, cache = [], store.Cache(spark, str(tmp_path))

    def make(tag):
        made.append(tag)
        return rows(spark, 2, tag)

    for key in ("k1", "k1", "k2", "k1"):
        assert {r.tag for r in cache.get(key, lambda key=key: make(key)).collect()} == {key}
    assert (cache.hits, cache.misses, made) == (2, 2, ["k1", "k2"])
    other = store.Cache(spark, str(tmp_path))
    threads = [threading.Thread(target=lambda: other.get("k3", lambda: make("k3"))) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert other.find("k3").count() == 2 and store.Published(spark, str(tmp_path), "k3").generations() == [1]
    other.drop("k3")
    assert other.find("k3") is None


def plain(docs, terms, limit):
    low = {i: (r, (t or "").lower()) for i, r, t in docs}
    size = {i: max(0, len(t) - 2) for i, (_, t) in low.items()}
    mean = sum(size.values()) / len(size)
    tf = {t: {i: sum(x.startswith(t, k) for k in range(len(x))) for i, (_, x) in low.items()} for t in terms}
    out = {}
    for i, (role, _) in low.items():
        if all(tf[t][i] for t in terms):
            s = 0.0
            for t in terms:
                n = sum(v > 0 for v in tf[t].values())
                raw = math.log((len(low) - n + 0.5) / (n + 0.5))
                s -= (retrieval.FLOOR if raw <= 0 else raw) * tf[t][i] * 2.2 / (tf[t][i] + 1.2 * (0.25 + 0.75 * size[i] / mean))
            out.setdefault(role, []).append((round(s, 9), i))
    return {(role, k, i): s for role, of in out.items() for k, (s, i) in enumerate(sorted(of)[:limit], 1)}


@pytest.mark.parametrize("query", ["abc", "abca", "abc bca", "aaa ABCAB", "aaaa", "zzz", "bab bab"])
def test_stored_index_equals_a_search_of_the_texts(spark, tmp_path, query):
    rng = random.Random(7)
    docs = [(k, rng.choice(["support", "counter", None]), "".join(rng.choice("aabc ") for _ in range(rng.choice([0, 2, 9, 40, 200])))) for k in range(1500)]
    docs += [(1500, "support", None), (1501, "support", "ÄBC\U0001f600abc"), (1502, "support", "aaaaaaa")]
    idx = index.TrigramIndex(spark, str(tmp_path))
    frame = lambda some: spark.createDataFrame([(*d, "x") for d in some], "id long, role string, text string, len string")
    assert [idx.append(frame(docs[:900])), idx.append(frame(docs[800:] + docs[:3] + [(None, "support", "abc")]))] == [1, 2]

    def got(first):
        return {(r.role, r["rank"], r.id): r.score for r in idx.search(query, 5, first).collect()}

    want = plain(docs, query.lower().split(), 5)
    for first in (1, 4):
        found = got(first)
        assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-8 for k in want)
    idx.merge()
    assert set(got(1)) == set(want) and len(idx.at.entry()["segments"]) == 1


def test_stored_index_passes_over_blocks_and_reads_no_text(spark, tmp_path):
    docs = [(k, "support", ("abc " * 30 if k % 997 == 0 else "abc " + "x" * 300)) for k in range(6000)] + [(k, "support", "none") for k in range(6000, 13_000)]
    idx = index.TrigramIndex(spark, str(tmp_path))
    idx.append(spark.createDataFrame(docs, "id long, role string, text string"))
    stats, mean = idx.weights(["abc"])
    some, rest = idx.chosen(["abc"], stats, mean, 3, 4)
    all_ = idx._bounds(["abc"], stats, mean).count()
    assert all_ > 40 and rest.count() < all_ // 4 and some.count() > 3
    assert [r.id for r in idx.search("abc", 3).orderBy("rank").collect()] == [0, 997, 1994]
    plan = idx.search("abcx", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "#" in plan
    with pytest.raises(ValueError, match="3 characters"):
        idx.search("ab", 3)
    with pytest.raises(FileNotFoundError):
        index.TrigramIndex(spark, str(tmp_path), "none").search("abc", 3)
    empty = index.TrigramIndex(spark, str(tmp_path), "empty")
    empty.append(spark.createDataFrame([], "id long, role string, text string"))
    assert empty.search("abc abcd", 3).count() == 0


def test_a_store_that_only_hadoop_reaches(spark, tmp_path):
    """There the pointer is put in place by a rename that refuses an existing target."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.other.link./in", f"file://{tmp_path}")
    pub = store.Published(spark, "viewfs://other/in", "x")
    assert [pub.publish({"a": rows(spark, n, "t")}, f"r{n}") for n in (3, 5)] == [1, 2] and pub.table("a").count() == 5
    with pytest.raises(store.Conflict):
        pub.publish({"a": rows(spark, 7, "t")}, "late", expected=1)
    assert pub.table("a").count() == 5 and len(pub.sweep(1, 0)) == 1 and pub.generations() == [2]


def test_stored_index_has_a_row_for_each_trigram_and_block(spark, tmp_path):
    docs = [(k, "support", f"abc \0\0{k} abc") for k in range(600)]
    idx = index.TrigramIndex(spark, str(tmp_path))
    idx.append(spark.createDataFrame(docs, "id long, role string, text string"))
    held, blocks = idx._table("postings"), idx._table("docs").select("block").distinct().count()
    want = {t[k : k + 3] for _, _, t in docs for k in range(len(t) - 2)}
    assert {r.trigram for r in held.collect()} == want and held.count() <= len(want) * blocks
    assert {(r.trigram, r.n) for r in held.where("trigram in ('abc', ' \0\0')").groupBy("trigram").agg(F.sum("df").alias("n")).collect()} == {("abc", 600), (" \0\0", 600)}
    assert {r.tf for r in idx.phrase("abc").collect()} == {2} and idx.phrase("c \0\0").count() == 600


def test_stored_index_finds_the_rows_of_a_long_term_once(spark, tmp_path):
    idx = index.TrigramIndex(spark, str(tmp_path))
    idx.append(spark.createDataFrame([(k, "support", f"abcd abc {k}") for k in range(300)], "id long, role string, text string"))
    top = idx.search("abcd abc abcd", 3)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4 and "trigram" not in plan  # the rows of the terms, and docs; no postings
    assert [r.id for r in top.orderBy("rank").collect()] == [0, 1, 2]
