"""Prefix trie of conversations, built as a Patricia tree from sorted rows.

A rebuilt conversation is one row: the digests of its turns, joined (``WIDTH`` bytes each, so bytes sort as turns do and a
prefix of turns is a prefix of bytes), and its turns' lengths. The rows are sorted over the whole table and dealt by range
of (turns, conv_id), so one conversation that many repeat is split too. A task walks its range once and keeps the path of
the row at hand: only points where conversations branch or end are made, and the turns between two points are an edge.

What lies across the border of two ranges can only be a prefix of a range's first or last row. Those prefixes leave the
walk as parts, a row for each depth, and are summed by their node afterwards. All aggregates are sums or minima over
rows, so parts add up: with T a member's code points and B the code points of the nodes below, the tokens saved below a
point are T - n * (code points down to it) - B. Unary nodes are filled in last, from the suffix sums of their edge.

Bounds: texts never leave the first step; one conversation's digests (20 bytes a turn) are one row; a range's ids are in
one task. The digest of a node's ends is one SHA-256 stream by definition: the ids of a node that many ranges share are
joined to long pieces first, and one task hashes the pieces.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, written

WIDTH = 16
#: Ids in one piece of a node's ends.
PIECE = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
POINT, PART, ENDS = 0, 1, 2
SCHEMA = "kind int, id binary, depth int, parent binary, n long, conv_id long, kids long, leaves long, total long, below long, before long, edge array<long>, ends string"
ARROW = pa.schema([
    ("kind", pa.int32()), ("id", pa.binary()), ("depth", pa.int32()), ("parent", pa.binary()), ("n", pa.int64()), ("conv_id", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()),
    ("total", pa.int64()), ("below", pa.int64()), ("before", pa.int64()), ("edge", pa.list_(pa.int64())), ("ends", pa.string()),
])


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order (null turn first, ties by digest) as (turn, t, points).

    ``t`` is the hex digest of role and text, ``points`` the code points of the text; null role or text count as empty.
    Rows without conv_id are of no conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("t"), F.char_length(text).alias("points")).alias("x"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))


def rebuilt(own: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Conversations of :func:`sequences` that open with turns of another one: the first of each ``every`` ids.

    How many turns they take over is the crc32 of the decimal id modulo ``most`` + 1; as many of their own go.
    """
    own = written(own, "turns")
    heads = own.where(f"conv_id % {every} = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    both = own.withColumn("base", F.expr(f"conv_id - conv_id % {every}")).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")).join(heads, "base", "left")
    return both.select("conv_id", F.expr("concat(slice(coalesce(head, slice(turns, 1, 0)), 1, h), slice(turns, h + 1, greatest(size(turns) - h, 0)))").alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """How many turns two rows open with alike."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    """A point on the path of the row at hand; ``open``: it began in an earlier range."""

    __slots__ = ("depth", "open", "n", "least", "total", "below", "kids", "leaves", "ends")

    def __init__(self, depth: int, open_: bool = False):
        self.depth, self.open = depth, open_
        self.n = self.total = self.below = self.kids = self.leaves = 0
        self.least, self.ends = None, []

    def add(self, other: Node, edge: int) -> None:
        """Takes over a closed child whose edge has so many code points; what began earlier has been counted there."""
        self.n, self.total, self.leaves, self.below = self.n + other.n, self.total + other.total, self.leaves + other.leaves, self.below + other.below
        self.least = other.least if self.least is None else min(self.least, other.least)
        if not other.open:
            self.kids, self.below = self.kids + 1, self.below + edge


class Walk:
    """One range's rows in order; ``before`` and ``after``: turns that its first and last row share with the neighbouring
    ranges' (-1 for none)."""

    def __init__(self, before: int, after: int, out: list):
        self.before, self.after, self.out = before, after, out
        self.key, self.ids, self.sums, self.path = None, [hashlib.sha256(b"").digest()[:WIDTH]], [0], []

    def row(self, key: bytes, points: list[int], conv: int) -> None:
        depth = len(key) // WIDTH
        if self.key is None:
            same = 0
            self.path = [Node(d, True) for d in range(self.before + 1)] or [Node(0)]
        elif key == self.key:
            same = depth
        else:
            same = common(self.key, key)
            self.close(same)
        ids, sums = self.ids, self.sums
        del ids[same + 1 :], sums[same + 1 :]
        for k in range(same, depth):
            ids.append(hashlib.sha256(ids[-1] + key[k * WIDTH : (k + 1) * WIDTH]).digest()[:WIDTH])
            sums.append(sums[-1] + points[k])
        if self.path[-1].depth < depth:
            self.path.append(Node(depth))
        end = self.path[-1]
        end.n, end.total, end.least = end.n + 1, end.total + sums[depth], conv if end.least is None else min(end.least, conv)
        end.ends.append(conv)
        self.key = key

    def close(self, same: int) -> None:
        """Close the points deeper than what the next row shares; one more is made where it leaves an edge."""
        path, sums = self.path, self.sums
        if same < path[-1].depth:
            path[-1].leaves += 1
        while path and path[-1].depth > same:
            node = path.pop()
            if same >= 0 and path[-1].depth < same:
                path.append(Node(same))
            up = path[-1].depth if path else -1
            if node.open:
                self.part(node, node.depth)
            else:
                self.point(node, up)
            if path:
                path[-1].add(node, sums[node.depth] - sums[up])

    def finish(self) -> None:
        if self.key is None:
            return
        self.close(self.after)
        sums = self.sums
        while self.path:  # what is left goes on in the next range
            node = self.path.pop()
            up = self.path[-1].depth if self.path else node.depth - 1
            self.part(node, node.depth)
            for d in range(node.depth - 1, up, -1):
                unary = Node(d)
                unary.add(node, sums[d + 1] - sums[d])
                self.part(unary, d)
                node = unary
            if self.path:
                self.path[-1].add(node, sums[up + 1] - sums[up])

    def point(self, node: Node, up: int) -> None:
        d, sums = node.depth, self.sums
        edge = [sums[d] - sums[k] for k in range(up, d)] if d else [0]
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else NO_ENDS
        self.out.append((POINT, self.ids[d], d, self.ids[up] if d else None, node.n, node.least, node.kids, node.leaves, node.total, node.below, sums[d], edge, ends))

    def part(self, node: Node, d: int) -> None:
        sums = self.sums
        self.out.append((PART, self.ids[d], d, self.ids[d - 1] if d else None, node.n, node.least, node.kids, node.leaves, node.total, node.below, sums[d], [sums[d] - sums[d - 1] if d else 0], None))
        for k in range(0, len(node.ends), PIECE):
            some = node.ends[k : k + PIECE]
            self.out.append((ENDS, self.ids[d], d, None, None, some[0], None, None, None, None, None, None, ",".join(map(str, some))))


def _walked(batches):
    walk, part, out = None, None, []

    def made():
        rows = out[:]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    for b in batches:
        cols = (b.column(c).to_pylist() for c in ("part", "before", "after", "key", "points", "conv_id"))
        for p, before, after, key, points, conv in zip(*cols, strict=True):
            if p != part:
                if walk:
                    walk.finish()
                walk, part = Walk(before, after, out), p
            walk.row(key, points, conv)
            if len(out) >= 5000:
                yield made()
    if walk:
        walk.finish()
    if out:
        yield made()


def _ends(batches):
    """Digests of the ends of nodes, whose pieces come one after another."""
    node, h = None, None
    for b in batches:
        done = []
        for i, text in zip(b.column("id").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if i == node:
                h.update(b",")
            else:
                if h:
                    done.append((node, h.hexdigest()))
                node, h = i, hashlib.sha256()
            h.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["id", "hashed"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["id", "hashed"])


def ranges(rebuilt_: DataFrame) -> DataFrame:
    """``part, before, after, key, points, conv_id``: rows dealt by range, with what a range shares with its neighbours."""
    key = F.expr("unhex(array_join(transform(turns, x -> x.t), ''))")
    rows = written(rebuilt_.select(key.alias("key"), F.expr("transform(turns, x -> x.points)").alias("points"), "conv_id"), "keys")
    dealt = written(rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id()), "sorted")
    order = Window.orderBy("part")  # a row for each range
    ends = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    ends = ends.select("part", "first", "last", F.lag("last").over(order).alias("left"), F.lead("first").over(order).alias("right"))

    def run(batches):
        for b in batches:
            first, last, left, right = (b.column(c).to_pylist() for c in ("first", "last", "left", "right"))
            shared = lambda x, y: [-1 if p is None else common(p, q) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(shared(left, first), pa.int32()), pa.array(shared(right, last), pa.int32())], ["part", "before", "after"])

    borders = written(ends.mapInArrow(run, "part int, before int, after int"), "borders")
    return dealt.join(F.broadcast(borders), "part")  # three numbers for each range


def points(rebuilt_: DataFrame) -> DataFrame:
    """The compressed tree: ``id, depth, parent, n, conv_id, kids, leaves, rest, edge, ends`` of each point.

    ``edge`` has the suffix sums of the code points of the turns from the one after the parent's depth down to this one,
    ``rest`` the tokens saved below the point.
    """
    ship(rebuilt_.sparkSession)
    dealt = ranges(rebuilt_).repartition("part").sortWithinPartitions("part", "key", "conv_id")
    walked = written(dealt.select("part", "before", "after", "key", "points", "conv_id").mapInArrow(_walked, SCHEMA), "walked")
    rest = (F.col("total") - F.col("n") * F.col("before") - F.col("below")).alias("rest")
    names = ["id", "depth", "parent", "n", "conv_id", "kids", "leaves"]
    whole = walked.where(f"kind = {POINT}").select(*names, rest, "edge", "ends")
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "total", "below")]
    parts = walked.where(f"kind = {PART}").groupBy("id", "depth", "parent", "before", "edge").agg(*sums, F.min("conv_id").alias("conv_id"))
    pieces = walked.where(f"kind = {ENDS}").select("id", "conv_id", "ends").repartition("id").sortWithinPartitions("id", "conv_id")
    parts = parts.join(pieces.mapInArrow(_ends, "id binary, hashed string"), "id", "left")
    return whole.union(parts.select(*names, rest, "edge", F.coalesce("hashed", F.lit(NO_ENDS)).alias("ends")))


def nodes(rebuilt_: DataFrame) -> DataFrame:
    """All nodes of the trie of ``conv_id, turns`` (see :func:`sequences`), unary ones filled in.

    ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    Conversations without turns are members of the root; an empty table has no nodes.
    """
    tree = written(points(rebuilt_), "points")
    above = tree.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    each = tree.join(above, "parent", "left").select("*", F.size("edge").alias("m"), F.posexplode("edge").alias("k", "suffix"))
    last = F.col("k") == F.col("m") - 1
    return each.select(
        "conv_id", (F.col("depth") - F.col("m") + 1 + F.col("k")).cast("long").alias("depth"), F.when(F.col("k") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("rest") + (F.col("n") - 1) * F.col("suffix")).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """:func:`nodes` of the conversations (conv_id, turn, role, text) rebuilt with shared openings.

    Rows without conv_id take no part; a null turn comes first, null role or text is empty; of several rows of one turn
    all count, in the order of their digests; other columns are ignored; an empty table gives an empty result.
    """
    return nodes(rebuilt(sequences(conversations), every, most))
