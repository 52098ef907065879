import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm.rows import awkward, empty
from threadloom.llm import shards
from threadloom.llm.queries import op6_bounded_ring


def _check(rows, docs, k):
    n = len(docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((-1 if d.doc_id is None else d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    sizes = Counter(r.shard for r in rows)
    if n:
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(k)) <= 1
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_query_is_even_and_gapless(spark, sf):
    _check(op6_bounded_ring(spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").collect(), 16)


def test_awkward_rows(spark):
    rows = awkward(spark)
    _check(shards.assign(rows, 16).collect(), rows.collect(), 16)
    assert shards.assign(empty(spark)).count() == 0


def test_rows_stay_near_their_arc_and_move_little(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    k, eps = 8, 0.25
    got = {r.doc_id: r for r in shards.assign(docs, k, eps).collect()}
    sizes = Counter(r.shard for r in got.values())
    cap = -(-len(got) * 5 // (4 * k))
    assert max(sizes.values()) <= cap
    ring = [(p.at, p.shard) for p in spark.range(1).select(shards.ring(k).alias("p")).first().p]
    for r in got.values():  # every shard passed over clockwise is full
        at = r.arc
        while ring[at][1] != r.shard:
            assert sizes[ring[at][1]] == cap
            at = (at + 1) % len(ring)
    grown = {r.doc_id: r.shard for r in shards.assign(docs, k + 1, eps).collect()}
    moved = sum(grown[i] != r.shard for i, r in got.items())
    assert moved < 0.4 * len(got)


def plain_walk(rows, points, shards, capacities):
    """rows: (at, key); every row asks the shard of the first point not before it, and goes on clockwise from full ones."""
    room, placed = list(capacities), {}
    arcs = {}
    for at, key in sorted(rows):
        arc = next((k for k, p in enumerate(points) if at <= p[0]), 0)
        arcs.setdefault(arc, []).append(key)
    for arc in range(len(points)):  # arcs are served in ring order, the rows beyond the last point with those of the first
        for key in arcs.get(arc, []):
            at = arc
            while room[points[at][1]] == 0:
                at = (at + 1) % len(points)
            room[points[at][1]] -= 1
            placed[key] = points[at][1]
    return placed


def test_query_equals_a_plain_walk(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    points = [(p.at, p.shard) for p in spark.range(1).select(shards.ring(16).alias("p")).first().p]
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.crc32(text), (F.octet_length(text) + 1).cast("long")), 33).alias("at")).collect()
    n = len(rows)
    want = plain_walk([(r.at, r.doc_id) for r in rows], points, 16, [n // 16 + (s < n % 16) for s in range(16)])
    assert {r.doc_id: r.shard for r in op6_bounded_ring(spark, sf).collect()} == want
