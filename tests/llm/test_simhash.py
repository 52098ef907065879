import random
import re

import xxhash

from tests.llm.rows import awkward, empty
from threadloom.llm import simhash
from threadloom.llm.queries import op5_simhash_bytes


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(rows):
    """rows: (id, fp); the smallest id reachable over links of 3 bits, by trying every pair."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted((-1 if i is None else i, f, least.get(find(f))) for i, f in rows)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs])
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op5_simhash_bytes(spark, sf).collect())
    assert got == want
    assert all(len(r.fingerprint) == 16 for r in op5_simhash_bytes(spark, sf).collect())


def test_awkward_rows(spark):
    rows = awkward(spark)
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows.collect()])
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.groups(rows).collect())
    assert got == want
    assert simhash.groups(empty(spark)).count() == 0


def _flip(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


def test_long_lists_are_refined_without_losing_links(spark):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = {_flip(rng, base, rng.randint(0, 6)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:100]:
        fps.add(_flip(rng, f, 3))
    signed = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    want = {frozenset(c) for c in _classes([(a % 2**64, b % 2**64) for a, b in _pairs(fps)])}
    for limit in (4, 40, 5000):
        got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(signed, limit).collect()]
        assert all((a ^ b).bit_count() for a, b in got)
        assert {frozenset(c) for c in _classes(got)} == want, limit


def _pairs(fps):
    fps = sorted(fps)
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]


def _classes(pairs):
    of = {}
    for a, b in pairs:
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            for z in y:
                of[z] = x
    return {id(v): v for v in of.values()}.values()
