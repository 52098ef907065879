import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from threadloom.llm import trie
from threadloom.llm.queries import op12_patricia_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string"


def rebuilt(rows, every=100, most=5):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            d = hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).hexdigest()
            own[c].append(((t is not None, t or 0, d), (r or "", x or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        out[c] = own.get(int(c / every) * every, [])[:h] + v[h:]  # % as in SQL: towards zero
    return out


def plain(rows, every=100, most=5):
    """Every node by its whole sequence of turns."""
    convs = rebuilt(rows, every, most)
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for v in members:
        own = (len(members[v]) - 1) * len(v[-1][1]) if v else 0
        for d in range(len(v) + 1):
            leaves[v[:d]] += v not in kids
            saved[v[:d]] += own
    return sorted(
        (min(m), len(v), min(members[v[:-1]]) if v else -1, len(m), len(kids.get(v, ())), leaves[v], saved[v], hashlib.sha256(",".join(map(str, sorted(ends.get(v, [])))).encode()).hexdigest())
        for v, m in members.items()
    )


def got(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    assert got(op12_patricia_trie(spark, "/root/testdata/sf0.01")) == plain(rows)


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "nobody's"), (100, None, None, None), (100, 0, "user", "é\U0001f600"), (100, 1, "a", ""), (100, 1, "a", ""), (101, 0, "user", "x"), (102, 0, "us", "erx"), (103, 0, "user", "x"),
        (200, 5, "user", "long " * 10_000), (201, 0, None, "q"), (-5, 0, "user", "neg"), (-100, 0, "user", "neg"), (104, 0, "user", "x"), (104, 1, "user", "x"), (104, 1, "user", "y"),
    ]
    assert got(trie.trie(frame(spark, rows))) == plain(rows)
    assert trie.trie(frame(spark, [])).count() == 0
    one = [(7, 0, "user", "z")]
    assert got(trie.trie(frame(spark, one))) == plain(one)


@pytest.mark.parametrize("seed", range(3))
def test_random_tries_over_many_ranges(spark, seed):
    """Copies that fill several ranges, prefixes of one another, and long unary paths across their borders."""
    r = random.Random(seed)
    rows = []
    for c in range(300):
        turns = [("u", "s")] * r.choice([0, 3, 3, 9]) + [("u", r.choice("ab")) for _ in range(r.choice([0, 1, 1, 2, 5]))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert got(trie.trie(frame(spark, rows), every=10)) == plain(rows, every=10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_walk_cut_anywhere():
    """Parts of a sorted table, cut at any place, add up to the whole."""
    keys = sorted([b"a" * 16 * n + bytes([c]) * 16 * m for n in range(4) for c in b"bc" for m in range(3)] * 2)
    rows = [(k, [1 + k[16 * j] % 3 for j in range(len(k) // 16)], c) for c, k in enumerate(keys)]

    def total(cuts):
        out, bounds = [], [0, *cuts, len(rows)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            edge = lambda i, j: trie.common(rows[i][0], rows[j][0]) if 0 <= i and j < len(rows) else -1
            w = trie.Walk(edge(a - 1, a), edge(b - 1, b), out)
            for x in rows[a:b]:
                w.row(*x)
            w.finish()
        sums = defaultdict(lambda: [0, 10**9, 0, 0, 0, 0])
        for kind, i, d, _, n, least, kids, leaves, all_, below, before, edge, _ in out:
            if kind != trie.ENDS:
                s = sums[i]
                sums[i] = [s[0] + n, min(s[1], least), s[2] + kids, s[3] + leaves, s[4] + all_ - n * before - below, d]
        return sums

    whole = total([])
    for a in range(1, len(rows)):
        for b in range(a + 1, len(rows), 3):
            cut = total([a, b])
            assert {k: cut[k] for k in whole} == dict(whole)
