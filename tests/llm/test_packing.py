import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from tokenizers import Tokenizer

from tests.llm.rows import awkward, empty
from threadloom.llm import packing
from threadloom.llm.queries import op7_mixture_packing, tokenizer

BYTE = "byte_bpe_50k.json"


def check(rows, docs, length=2048):
    """Every id lies in one piece, sequences are gapless and full, and the pieces' ids are the library's."""
    lib = Tokenizer.from_file(tokenizer(BYTE))
    ids = defaultdict(list)
    for d in docs:
        ids[d.doc_id].append(lib.encode(d.text or "", add_special_tokens=False).ids + [1])
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(r.length for r in rows) == total
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    for v in by.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    assert sorted(by) == list(range(-(-total // length)))
    assert all(sum(r.length for r in by[k]) == length for k in sorted(by)[:-1])
    cover = Counter()
    for r in rows:
        cover[r.doc_id] += r.length
    assert cover == {i: sum(map(len, v)) for i, v in ids.items()}


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = op7_mixture_packing(spark, sf).collect()
    check(rows, docs)
    size = Counter()
    mix = defaultdict(Counter)
    for r in rows:
        size[r.source] += r.length
        mix[r.sequence_id][r.source] += r.length
    total = sum(size.values())
    for k in list(mix)[:-1]:
        if k != max(mix):
            assert all(abs(mix[k][s] - 2048 * size[s] / total) <= 2.5 for s in size)


def test_awkward_rows(spark):
    rows = awkward(spark)
    check(packing.packed(rows, tokenizer(BYTE), 64).collect(), rows.collect(), 64)
    assert packing.packed(empty(spark), tokenizer(BYTE)).count() == 0
    assert {r.source for r in packing.packed(rows, tokenizer(BYTE), 64).collect()} == {"s1", None}
    check(packing.packed(rows, tokenizer(BYTE), 64, in_jvm=False).collect(), rows.collect(), 64)


def test_every_source_keeps_its_queue_however_many_there_are(spark):
    rows = spark.createDataFrame([(k, f"word {k} " * (k % 5), f"source{k % 700}") for k in range(2100)], "doc_id long, text string, source string")
    got = packing.packed(rows, tokenizer(BYTE)).collect()
    check(got, rows.collect())
    assert {(r.doc_id, r.source) for r in got} == {(k, f"source{k % 700}") for k in range(2100)}


def plain_round_robin(sizes, length):
    """(queue, token) of every place: each window's tokens go to the queue whose next token is longest overdue."""
    served, out = [0] * len(sizes), []
    while sum(served) < sum(sizes):
        before = list(served)
        for _ in range(min(length, sum(sizes) - sum(served))):
            s = min((s for s in range(len(sizes)) if served[s] < sizes[s]), key=lambda s: (Fraction(2 * served[s] + 1, 2 * sizes[s]), s))
            served[s] += 1
        out += [(s, t) for s in range(len(sizes)) for t in range(before[s], served[s])]
    return out


def test_pieces_equal_a_plain_round_robin_token_by_token():
    rng = np.random.default_rng(1)
    for sizes, length in (([1], 8), ([5, 5, 5], 8), ([1, 1, 1000], 64), (rng.integers(1, 100, 30).tolist(), 32), ([700, 3, 900], 100), ([2, 3, 5, 7, 11], 4), (rng.integers(1, 9, 100).tolist(), 16)):
        docs = []
        for s, size in enumerate(sizes):
            at = 0
            while at < size:
                n = int(min(size - at, rng.integers(1, 40)))
                docs.append((s, at, n))
                at += n
        queue, at, n = (np.array(x, np.int64) for x in zip(*docs, strict=True))
        got = {}
        for d, start, size, window, offset in zip(*(x.tolist() for x in packing.Rounds(np.array(sizes), length).pieces(queue, at, n)), strict=True):
            for k in range(size):
                got[window * length + offset + k] = (docs[d][0], docs[d][1] + start + k)
        want = plain_round_robin(sizes, length)
        assert sorted(got.values()) == sorted(want)
        due = lambda place: Fraction(2 * place[1] + 1, 2 * sizes[place[0]])
        for k in range(0, len(want), length):  # each window takes what the plain loop takes, but for the order of ties
            window = [got[x] for x in range(k, min(k + length, len(want)))]
            assert window == sorted(window) and sorted(map(due, window)) == sorted(map(due, want[k : k + length]))


def test_grants_of_very_large_corpora_sum_and_never_fall():
    sizes = np.array([7 * 10**12, 2 * 10**12, 10**12, 5], np.int64)
    rounds = packing.Rounds(sizes)
    tokens = np.sort(np.random.default_rng(2).integers(0, int(sizes.sum()), 500))
    for w in (tokens // 2048 * 2048, tokens // 2048 * 2048 + 2048):
        n = rounds.granted(w)
        assert (n.sum(axis=1) == w).all() and (np.diff(n, axis=0) >= 0).all() and np.abs(n - w[:, None] * (sizes / sizes.sum())).max() < 2
