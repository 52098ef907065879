"""The near-duplicate operator for a similarity of shingle sets: positional bytes, count filtering, verification.

The bits of a 64-bit SimHash cannot carry a Jaccard limit of 0.8: such pairs differ in some ten bits of 64, where hardly a
positional byte is shared. So this form of the operator keeps the byte-position index, the tally and the verification of
:mod:`.simhash` and takes other bytes: a sketch of ``BYTES`` positional bytes, the low bytes of as many min-wise hashes, of
which two texts of similarity s share s * BYTES on average. Pairs meet in the lists of ``BANDS`` groups of ``ROWS``
positions, their shared positional bytes are tallied, pairs below ``SHARED`` are dropped, and the rest are verified on
their real sets. At a similarity of 0.8 a pair meets in no list with probability 5e-8 and misses the tally with 4e-8.

Equal texts are one node throughout. In each list all members are first compared with its smallest one. Only where that
leaves several components in a list are its other members tallied, inside one pass over the list, which gives a forest of
those that might be linked, never its pairs. Each tree of all lists' forests together is then settled where its texts are
brought together: pairs of different components that reach the tally are compared on their real sets, and the links that
join components come out. Lists too long for one pass are refined by a second group of positions, of which a pair at the
limit shares 13 of 32 on average; trees too large for one task are dealt in blocks, every two of which meet.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import components, ship, spare, written

#: Words of a shingle, seed of its hash, least similarity of a link.
SHINGLE, SEED, LEAST = 5, 42, 0.8
#: Groups of positions, positions of a group, bytes of a sketch, bytes that linked texts share at least.
BANDS, ROWS = 32, 4
BYTES, SHARED = BANDS * ROWS, 78
#: Members of a list that are compared in one pass, and members and bytes of a tree that come together in one task.
LIST_ROWS, TREE_ROWS, TREE_BYTES = 4096, 2048, 1 << 25

_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BYTES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text in UTF-8; a shorter text is one shingle."""
    words = raw.lower().split()
    text = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-SHINGLE] + 1)).tolist()
    cuts = map(slice, starts, ends[SHINGLE - 1 :].tolist())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(text.__getitem__, cuts), repeat(SEED)), np.uint64, len(starts)))


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list keys of a shingle set and its positional bytes, as longs."""
    least = np.array([(found * a).min() for a in _ODD], np.uint64)
    keys = np.array([xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)], np.uint64)
    return keys.view(np.int64), (least >> np.uint64(40)).astype(np.uint8).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def tally(a: str, b: str) -> Column:
    """Positional bytes that two sketches (columns ``a`` and ``b``, arrays of longs) share."""
    differ = None
    for k in range(BYTES // 8):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        one = F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
        differ = one if differ is None else differ + one
    return F.lit(BYTES) - differ


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("node"), text.cast("binary").alias("text"))


def sketches(rows: DataFrame) -> DataFrame:
    """``doc_id, node, keys, bytes, fp`` of every row of ``rows (doc_id, node, text)``; ``fp``: the SimHash of the shingles."""
    ship(rows.sparkSession)

    def run(batches):
        spare()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                made, fps = [], []
                for t in b.column("text"):
                    found = shingles(t.as_py())
                    made.append(sketch(found))
                    fps.append(simhash.majority(found))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), *[pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (0, 1)], pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "node", "keys", "bytes", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long, keys array<long>, bytes array<long>, fp long")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b`` of those of ``pairs (a, b)`` whose similarity, from the texts themselves, reaches ``LEAST``."""
    pairs = written(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = written(rows.join(wanted, "node", "left_semi").select("node", "text").dropDuplicates(["node"]), "texts")
    one, two = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))

    def run(batches):
        last, of_b = None, None
        for batch in batches:
            near = []
            for b, s, t in zip(batch.column("b"), batch.column("text_a"), batch.column("text_b"), strict=True):
                if last != b:
                    last, of_b = b, shingles(t.as_py())
                near.append(similarity(shingles(s.as_py()), of_b) >= LEAST - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return written(pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long"), "verified")


def _runs(batches, key: str):
    """The rows of each run of equal ``key`` in sorted batches, as one table each; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for first, stop in zip(cuts, cuts[1:], strict=False):
            part = b.slice(first, stop - first)
            if held and held[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _bytes(t: pa.Table) -> np.ndarray:
    flat = t.column("bytes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(np.uint8).reshape(t.num_rows, BYTES)


def _joins(label: np.ndarray, marks: np.ndarray, near=None):
    """Pairs (i, j) that join components, starting from ``label``, of members that reach the tally and, if given, ``near(i, j)``."""
    for i in range(len(label) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        j = j[(marks[j] == marks[i]).sum(axis=1) >= SHARED] if len(j) else j
        for k in j.tolist():
            if label[k] != label[i] and (near is None or near(i, k)):
                label[label == label[k]] = label[i]
                yield i, k


def forest(members: DataFrame) -> DataFrame:
    """``a, b``: for each list of ``members (list, node, root, bytes)`` a forest that joins what the tally and the roots join."""
    dealt = members.select("list", "node", "root", "bytes").repartition("list").sortWithinPartitions("list", "root", "node")

    def run(batches):
        for t in _runs(batches, "list"):
            node = _numbers(t, "node")
            found = list(_joins(_numbers(t, "root").copy(), _bytes(t)))
            i, j = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def settled(members: DataFrame, rows: DataFrame, size: int = TREE_ROWS, volume: int = TREE_BYTES) -> DataFrame:
    """``a, b``: links that connect what all links between members of a tree connect, but for what ``root`` connects already.

    ``members``: tree, node, root, bytes. Trees of more than ``size`` members or ``volume`` bytes are dealt in blocks.
    """
    texts = rows.join(members.select("node"), "node", "left_semi").select("node", "text").dropDuplicates(["node"])
    of = written(members.join(texts, "node"), "trees")
    count = of.groupBy("tree").agg(F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum(F.octet_length("text")) / volume), F.lit(1)).alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks"))
    rows_ = of.join(count, "tree").withColumn("own", block).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows_ = rows_.withColumn("at", F.xxhash64("tree", F.least("own", "other"), F.greatest("own", "other")))
    dealt = rows_.select("at", "node", "root", "bytes", "text").repartition("at").sortWithinPartitions("at", "root", "node")

    def run(batches):
        for t in _runs(batches, "at"):
            node, sets = _numbers(t, "node"), [shingles(x.as_py()) for x in t.column("text")]
            sizes = np.array([len(x) for x in sets])

            def near(i, j):
                return min(sizes[i], sizes[j]) >= LEAST * max(sizes[i], sizes[j]) - 1e-9 and similarity(sets[i], sets[j]) >= LEAST - 1e-9

            found = list(_joins(_numbers(t, "root").copy(), _bytes(t), near))
            i, j = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def fingerprint_links(marks: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b``: texts whose fingerprints the SimHash operator links (``marks (node, fp)``) and whose sets reach ``LEAST``.

    Of the texts of one fingerprint each is compared with the smallest, and of linked fingerprints the smallest ones, so there
    are no more pairs than texts and links. Those that fail stay apart until the sketches settle them.
    """
    of = written(marks.groupBy("fp").agg(F.min("node").alias("hub")), "fingerprints")
    one, two = (of.select(F.col("fp").alias(c), F.col("hub").alias(f"hub_{c}")) for c in ("a", "b"))
    across = simhash.links(of.select("fp")).join(one, "a").join(two, "b").select(F.col("hub_a").alias("a"), F.col("hub_b").alias("b"))
    within = marks.select("node", "fp").join(of, "fp").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return verified(across.union(within).distinct(), rows)


def joined(known: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``known (node, root)`` after the links ``more (a, b)``, a written table; ``known`` itself if there are none."""
    return known if more.isEmpty() else components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def links(marks: DataFrame, rows: DataFrame, limit: int = LIST_ROWS, size: int = TREE_ROWS) -> DataFrame:
    """``node, root`` of every text that has a near-duplicate. ``marks``: node, keys, bytes, fp, a row a node; ``rows``: node, text."""
    sure = fingerprint_links(marks, rows)
    known = components(sure)  # from here on links are added to its stars, not to the links that made them
    postings = marks.select("node", F.explode("keys").alias("list"))
    lists = postings.groupBy("list").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("list", "hub")
    shared = written(postings.join(lists, "list"), "lists")
    of = marks.select("node", "bytes")
    first = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    for c in ("a", "b"):
        first = first.join(known.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    first = first.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    first = first.join(of.select(F.col("node").alias("a"), F.col("bytes").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("bytes").alias("y")), "b")
    roots = joined(known, verified(first.where(tally("x", "y") >= SHARED).select("a", "b"), rows))
    member = written(shared.select("list", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
    several = member.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y").select("list", "n")
    member = member.join(several, "list")
    long = member.where(F.col("n") > limit)
    finer = long.join(marks.select("node", F.explode("keys").alias("more")), "node").where("more <> list")
    member = member.where(F.col("n") <= limit).select("list", "node", "root").union(finer.select(F.xxhash64("list", "more").alias("list"), "node", "root"))
    met = written(forest(member.join(of, "node")), "forest")
    if met.isEmpty():
        return roots
    trees = joined(roots, met).withColumnRenamed("root", "tree")
    inside = trees.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = inside.groupBy("tree").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("tree")
    more = written(settled(inside.join(open_, "tree", "left_semi").join(of, "node"), rows, size), "settled")
    return joined(roots, more)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIST_ROWS, size: int = TREE_ROWS) -> DataFrame:
    """``doc_id, node, component_id, first`` for every row: the smallest doc_id reachable over links, its own included.

    ``node`` is the hash of the text, a null text counting as empty; texts without words are equal to each other. ``first``
    marks the rows of one (doc_id, node) in each group: the smallest doc_id, and of its texts the smallest node; rows without
    doc_id come last and are never anyone's component_id. Repeated rows give repeated results; other columns are ignored,
    whatever their names; empty in, empty out.
    """
    rows = _texts(docs, id_col, text_col)
    marks = written(sketches(rows), "sketches")
    roots = links(marks.select("node", "keys", "bytes", "fp").dropDuplicates(["node"]), rows, limit, size)
    least = marks.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = written(least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "roots")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("f"))
    of = written(named.join(best, "root").select("node", "component_id", F.col("f.node").alias("f")), "classes")
    same = (F.col("f") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return marks.select("doc_id", "node").join(of, "node").select("doc_id", "node", "component_id", same.alias("first"))
