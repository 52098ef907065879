import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.llm import merkle
from threadloom.llm.queries import op11_mountain_merkle

from .rows import empty

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def way(tree, i):
    out = []
    for nodes in tree[:-1]:
        a = i // 16 * 16
        out.append((nodes[a:i], nodes[i + 1 : a + 16]))
        i //= 16
    return out


def plain(rows):
    """Rows in the order of FIELDS; whole trees in memory."""
    by = defaultdict(list)
    for r in rows:
        by["" if r[1] is None else "=" + r[1]].append(r)
    order = sorted(by, key=str.encode)
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = way(trees[s], i) + way(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if bad else leaf(r)
            for a, b in path:
                node = sha("".join([*a, node, *b]))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(x for a, b in path for x in a + b)), node, node == top[-1][0]))
    return Counter(out)


def got(df):
    return Counter(tuple(r[c] for c in "doc_id leaf subroot root proof_sha256 folded_root verified".split()) for r in df.collect())


def of(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string")
    return merkle.audited(merkle.manifest(docs, list(FIELDS), {"text": F.lower("text")}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    want = plain(rows)
    assert got(op11_mountain_merkle(spark, sf)) == want and {x[-1] for x in want} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [16], [17], [2, 1], [300, 1, 33, 16], [5000], [1] * 40])
def test_sizes_over_many_ranges(spark, sizes):
    r = random.Random(len(sizes))
    rows = [(r.randrange(1000), None if k == 0 else f"s{'é' * k}", None, 3, r.choice(["Abc", "", None, "x" * 50])) for k, n in enumerate(sizes) for _ in range(n)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert got(of(spark, rows)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_awkward_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (5, "a", "x", 1, "12:A"), (5, "a", "x", 1, "12:A"), (5, "a", "x", 1, "12:a"), (-3, "B", None, -1, "Ä" * 100_000), (10, "a", "-", 2, None)]
    assert got(of(spark, rows * 3)) == plain(rows * 3)
    assert merkle.audited(merkle.manifest(empty(spark), list(FIELDS))).count() == 0


def test_ranges_cut_anywhere_leave_the_same_runs():
    """DONE and PEAK nodes of ranges cut at any two places are those of the whole, and each is left once."""
    n = 16 * 16 + 19
    whole = levels([sha(str(k)) for k in range(n)])
    for a, b in [(0, n), (1, n), (15, 33), (16, 256), (255, 272), (270, 275), (100, 101)]:
        out = []
        for lo, hi in ((0, a), (a, b), (b, n)):
            r = merkle.Range(n, 16, lambda *x: out.append(x))
            for k in range(lo, hi):
                r.push(k, {"digest": whole[0][k], "id": k, "other": None})
            r.finish()
        for kind, level, at, digest, _ in out:
            assert whole[level][at] == digest
        made = Counter((level, at) for kind, level, at, _, _ in out if kind != merkle.PEAK and level)
        assert max(made.values(), default=0) <= 2 and len([x for x in out if x[0] == merkle.PEAK]) <= 2 * 2 * 15 * 3
