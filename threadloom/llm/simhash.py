"""SimHash near-duplicates through an inverted index over positional bytes, with count filtering.

Fingerprints that differ in at most 3 of 64 bits differ in at most 3 of their 8 bytes, so they share at least 5
positional bytes. That guaranteed minimum drives the search: of any 5 of 8 positions at least 3 lie in the same half, so
posting lists are kept for the triples of positions inside a half (8 lists per fingerprint, 24 bits each). The pairs
that meet in a list are tallied over all 8 positions, those below the minimum are dropped, and the rest are verified.

Lists grow with the corpus where texts share templates. A list longer than ``LIST_ROWS`` is therefore refined, exactly:
its pairs share 5 positions including the triple, which gives 10 lists of 5 bytes; what is still long is refined by the
half bytes of the other 3 positions, of which a pair must share 3 of 6, and such a list has at most 4096 members.
Equal fingerprints are one row throughout, and a list emits links to local minima, never all its pairs.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, ship, written

#: Words of a shingle, seed of the shingle hash, bits that a link may differ in.
SHINGLE, SEED, BITS = 3, 42, 3
#: Positional bytes that linked fingerprints share at least.
SHARED = 8 - BITS
#: Longest posting list that is worked on in one piece.
LIST_ROWS = 2048


def fingerprint(raw: bytes) -> int:
    """The 64-bit fingerprint of one text in UTF-8; 0 for a text without a word."""
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(text, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-SHINGLE] + 1)).tolist()
    cuts = map(slice, starts, ends[SHINGLE - 1 :].tolist())
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(text.__getitem__, cuts), repeat(SEED)), np.uint64, len(starts))
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes ``h``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp long`` (the fingerprint's 64 bits) of every row; a null text has no words."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"") for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _mask(positions, width: int = 8) -> int:
    m = sum(((1 << width) - 1) << (width * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _halves() -> list[int]:
    return [_mask(c) for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]


def _fives() -> dict[int, list[int]]:
    return {_mask(c): [_mask(c + d) for d in combinations([p for p in range(8) if p not in c], SHARED - 3)] for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)}


def _nibbles() -> dict[int, list[int]]:
    out = {}
    for c in combinations(range(8), SHARED):
        fixed, free = [n for p in c for n in (2 * p, 2 * p + 1)], [n for p in range(8) if p not in c for n in (2 * p, 2 * p + 1)]
        out[_mask(c)] = [_mask(fixed + list(d), 4) for d in combinations(free, 3)]
    return out


def _finer(table: dict[int, list[int]]):
    """The masks that follow a mask, as an array expression."""
    return F.create_map(*[x for m, finer in table.items() for x in (F.lit(m), F.array(*[F.lit(f) for f in finer]))])[F.col("mask")]


def local_links(a: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys: each linked member and the first member of its component within the run."""
    i = np.arange(len(a) - 1)
    left, right = [], []
    step = 1
    while len(i):
        i = i[i + step < len(a)]
        i = i[key[i] == key[i + step]]
        x = a[i] ^ a[i + step]
        ok = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= SHARED  # the tally of shared positional bytes
        ok[ok] = np.bitwise_count(x[ok]) <= BITS
        left.append(i[ok])
        right.append(i[ok] + step)
        step += 1
    if not left:
        return a[:0], a[:0]
    u, v = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(a))
    while True:
        low = np.minimum(root[u], root[v])
        was = root.copy()
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        root = root[root]
        if (root == was).all():
            break
    linked = np.flatnonzero(root != np.arange(len(a)))
    return a[linked], a[root[linked]]


def _links(postings: DataFrame) -> DataFrame:
    """Links of lists of bounded length. ``postings``: mask, part (the fingerprint under the mask), fp."""
    dealt = postings.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")

    def run(batches):
        kept_key = kept = None
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column("mask").to_numpy(zero_copy_only=False)
            p = b.column("part").to_numpy(zero_copy_only=False)
            a = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            k = np.stack([m, p], axis=1)
            if kept is not None:
                a, k = np.concatenate([kept, a]), np.concatenate([kept_key, k])
            new = np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)])
            run_of = np.cumsum(new)
            cut = int(np.flatnonzero(new)[-1])
            kept_key, kept = k[cut:], a[cut:]  # the last list may go on in the next batch
            yield emit(a[:cut], run_of[:cut])
        if kept is not None:
            yield emit(kept, np.zeros(len(kept), np.int64))

    def emit(a, key):
        u, v = local_links(a, key)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, limit: int = LIST_ROWS) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fps (fp)`` that connect exactly what Hamming distance 3 does."""
    at = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in _halves()])).alias("mask"))
    found = None
    for finer in (_fives(), _nibbles(), None):
        at = at.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
        if finer is None:
            return found.union(_links(at))
        long = at.groupBy("mask", "part").count().where(F.col("count") > limit).select("mask", "part")
        long = written(long, "longlists")
        some = _links(at.join(long, ["mask", "part"], "left_anti"))
        found = some if found is None else found.union(some)
        if long.isEmpty():
            return found
        at = at.join(long, ["mask", "part"], "left_semi").select("fp", F.explode(_finer(finer)).alias("mask")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIST_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the smallest doc_id reachable over links, its own included.

    Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows give repeated results;
    a row without doc_id takes part and is never anyone's component_id; other columns are ignored; empty in, empty out.
    """
    marks = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), limit))
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "roots")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(named.join(best, "root").select("fp", "component_id"), "classes")
    return marks.join(of, "fp").select("doc_id", "fp", "component_id")
