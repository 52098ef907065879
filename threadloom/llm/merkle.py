"""Merkle manifest of a dataset: a tree over the rows of each source, one over the sources, and proofs of every row.

Rows are dealt by range of (source, order), and each range knows the index of its first row within its source. A task
feeds its rows to a mountain range: a stack with the open run of every level, where a run of ``fanout`` nodes that begins
and ends in the range is hashed and carried to the level above. What is left are peaks whose run began in an earlier range
or goes on in a later one: at most two runs a level, range and source. Peaks meet by their run, level by level, so merging
handles a run of at most ``fanout`` nodes at a time. Nothing pads a short run: the last one of a level hashes what it has.

Proofs go the other way: every run hands its nodes what lies left and right of them, and the way of the node above.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, written

FANOUT = 16
DONE, PEAK, TOP = 0, 1, 2


def leaf(*fields: Column) -> Column:
    """SHA-256 of fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    each = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*each).cast("binary"), 256)


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as sources do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


class Range:
    """The mountain range of one source's rows in one range of the order: rows ``first``, ``first`` + 1, ... of ``n``."""

    def __init__(self, n: int, fanout: int, emit):
        self.n, self.fanout, self.emit = n, fanout, emit
        self.open: list[list[tuple[int, dict]]] = []
        self.counts = [n]
        while self.counts[-1] > 1:
            self.counts.append(-(-self.counts[-1] // fanout))

    def push(self, index: int, node: dict, level: int = 0) -> None:
        """``node``: digest, id and other, the latter two for rows."""
        count = self.counts[level]
        if count == 1:
            self.emit(TOP, level, index, node["digest"], [node])
            return
        while len(self.open) <= level:
            self.open.append([])
        run = self.open[level]
        run.append((index, node))
        place = index % self.fanout
        if place < self.fanout - 1 and index < count - 1:
            return
        if len(run) == place + 1:
            kids = [x for _, x in run]
            digest = hashlib.sha256("".join([k["digest"] for k in kids]).encode()).hexdigest()
            self.emit(DONE, level + 1, index // self.fanout, digest, kids)
            run.clear()
            self.push(index // self.fanout, {"digest": digest, "id": None, "other": None}, level + 1)
        else:
            self.peaks(level)

    def peaks(self, level: int) -> None:
        for index, node in self.open[level]:
            self.emit(PEAK, level, index, node["digest"], [node])
        self.open[level].clear()

    def finish(self) -> None:
        for level in range(len(self.open)):
            self.peaks(level)


@dataclass
class Forest:
    """Trees by ``key``. ``runs``: key, n, level, at, digest, kids (the nodes of level - 1 in order: digest, id, other);
    ``tops``: key, n, level, digest, kids, the root of each tree (of a tree of one row its leaf)."""

    runs: DataFrame
    tops: DataFrame
    fanout: int


def forest(leaves: DataFrame, fanout: int = FANOUT) -> Forest:
    """A tree for each ``key`` of ``leaves`` (key, ord, digest, id, other), in the order of ord (null first), then digest.

    ``id`` and ``other`` travel with the leaf. Equal rows are leaves of their own. Keys must not be null.
    """
    spark = leaves.sparkSession
    ship(spark)
    order = ["key", "ord", "digest", "salt"]  # the salt deals rows that are equal in everything
    dealt = leaves.select("key", "ord", "digest", "id", "other").withColumn("salt", F.monotonically_increasing_id())
    dealt = written(dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "leaves")
    counts = dealt.groupBy("part", "key").agg(F.count("*").alias("m"))
    of = Window.partitionBy("key")
    before = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "key", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"), F.sum("m").over(of).alias("n"))
    rows = dealt.join(starts, ["part", "key"]).repartition("part", "key").sortWithinPartitions("part", *order).select("part", "key", "first", "n", "digest", "id", "other")
    id_type = leaves.schema["id"].dataType.simpleString()
    schema = f"kind int, key string, n long, level int, at long, digest string, kids array<struct<digest:string,id:{id_type},other:string>>"

    def run(batches):
        out, tree, now, index = [], None, None, 0

        def made():
            cols = list(zip(*out, strict=True))
            out.clear()
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=False)]
            kids = [x for k in cols[6] for x in k]
            at = [0]
            for k in cols[6]:
                at.append(at[-1] + len(k))
            node = pa.StructArray.from_arrays([pa.array([x["digest"] for x in kids], pa.string()), pa.array([x["id"] for x in kids], kind), pa.array([x["other"] for x in kids], pa.string())], ["digest", "id", "other"])
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(at, pa.int32()), node)], ["kind", "key", "n", "level", "at", "digest", "kids"])

        for b in batches:
            kind = b.schema.field("id").type
            cols = (b.column(c).to_pylist() for c in ("part", "key", "first", "n", "digest", "id", "other"))
            for part, key, first, n, digest, id_, other in zip(*cols, strict=True):
                if now != (part, key):
                    if tree:
                        tree.finish()
                    now, index = (part, key), first
                    tree = Range(n, fanout, lambda kind, level, at, digest, kids, key=key, n=n: out.append((kind, key, n, level, at, digest, kids)))
                tree.push(index, {"digest": digest, "id": id_, "other": other})
                index += 1
                if len(out) >= 5000:
                    yield made()
        if tree:
            tree.finish()
        if out:
            yield made()

    ranged = written(rows.mapInArrow(run, schema), "ranges")
    done, tops = [ranged.where(f"kind = {DONE}")], [ranged.where(f"kind = {TOP}")]
    most = ranged.agg(F.max("n")).first()[0] or 0
    carried, level, count = None, 0, most
    while count > 1:
        peaks = ranged.where(f"kind = {PEAK} AND level = {level}").select("key", "n", "at", "kids")
        peaks = peaks.union(carried) if carried is not None else peaks
        run_ = peaks.groupBy("key", "n", F.expr(f"at div {fanout}").alias("at")).agg(F.expr("flatten(transform(sort_array(collect_list(struct(at, kids))), x -> x.kids))").alias("kids"))
        level, count = level + 1, -(-count // fanout)
        digest = F.sha2(F.array_join(F.transform("kids", lambda x: x["digest"]), "").cast("binary"), 256)
        merged = written(run_.select(F.lit(DONE).alias("kind"), "key", "n", F.lit(level).alias("level"), "at", digest.alias("digest"), "kids"), "merged")
        own = F.array(F.struct(F.col("digest").alias("digest"), F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("string").alias("other")))
        done.append(merged)
        is_top = F.col("n") <= fanout**level
        tops.append(merged.where(is_top).withColumn("kids", own))
        carried = merged.where(~is_top).select("key", "n", "at", own.alias("kids"))
    return Forest(reduce(DataFrame.union, done).drop("kind"), reduce(DataFrame.union, tops).drop("kind", "at"), fanout)


def proofs(trees: Forest, above: DataFrame | None = None) -> DataFrame:
    """``key, digest, id, other, top, path`` of every leaf: its way to the top of its tree, an array of (l, r).

    Hashing l, the node and r, level by level, gives the top. ``above``: key, path; that way follows at the tree's top.
    """
    kind = "array<struct<l:string,r:string>>"
    tops = trees.tops.select("key", "level", F.col("digest").alias("top"), "kids")
    tops = tops.withColumn("path", F.array().cast(kind)) if above is None else tops.join(above.select("key", "path"), "key")
    tops = written(tops, "tops")
    most = tops.agg(F.max("level")).first()[0] or 0
    way, runs = None, written(trees.runs, "runs")
    for level in range(most, 0, -1):
        here = tops.where(f"level = {level}").select("key", F.lit(0).cast("long").alias("at"), "top", "path")
        way = here if way is None else way.union(here)
        each = runs.where(f"level = {level}").select("key", "at", "kids").join(way, ["key", "at"])
        side = lambda part: f"array_join(transform(slice(kids, {part}), x -> x.digest), '')"
        each = each.select("key", "at", "top", "path", "kids", F.size("kids").alias("m"), F.posexplode("kids").alias("k", "x"))
        step = F.array(F.struct(F.expr(side("1, k")).alias("l"), F.expr(side("k + 2, m")).alias("r")))
        each = each.select("key", (F.col("at") * trees.fanout + F.col("k")).alias("at"), F.col("x.digest").alias("digest"), F.col("x.id").alias("id"), F.col("x.other").alias("other"), "top", F.concat(step, "path").alias("path"))
        way = each if level == 1 else each.select("key", "at", "top", "path")
    alone = tops.where("level = 0").select("key", F.col("kids")[0]["digest"].alias("digest"), F.col("kids")[0]["id"].alias("id"), F.col("kids")[0]["other"].alias("other"), "top", "path")
    return alone if way is None else way.select(*alone.columns).union(alone)


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf and its way give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]).cast("binary"), 256))


def proof_digest(path: str = "path") -> Column:
    """SHA-256 of all siblings on a way, left to right and level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, fields: list[str], changed: dict[str, Column] | None = None, tampered: Column | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``doc_id, leaf, subroot, root, path, found`` of every row; ``found`` is the leaf of the row as it is ``changed``.

    A leaf is made of ``fields``; ``changed`` gives other values of some of them for the rows where ``tampered`` holds. Rows
    without id come first in their source, rows without source are a source of their own, and the first one. Rows of one
    id are ordered by their leaves, and repeated rows are leaves of their own. Null fields and empty ones differ. Other
    columns are ignored; an empty table gives an empty result.
    """
    own = leaf(*[F.col(c) for c in fields])
    other = leaf(*[(changed or {}).get(c, F.col(c)) for c in fields])
    found = F.when(F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False), other)
    leaves = written(docs.select(source_key(F.col(source_col)).alias("key"), F.col(id_col).alias("ord"), own.alias("digest"), F.col(id_col).alias("id"), found.alias("other")), "digests")
    trees = forest(leaves)
    tops = trees.tops.select(F.lit("").alias("key"), F.col("key").alias("ord"), "digest", F.col("key").alias("id"), F.lit(None).cast("string").alias("other"))
    sources = forest(tops)
    root = sources.tops.select("digest").first()  # the one root of all
    ways = written(proofs(sources).select(F.col("id").alias("key"), "path"), "ways")
    each = proofs(trees, ways)
    return each.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root[0] if root else None).cast("string").alias("root"), "path", F.coalesce("other", "digest").alias("found"))


def audited(made: DataFrame) -> DataFrame:
    """What the rows of :func:`manifest` prove: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    again = folded(F.col("found"))
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), again.alias("folded_root"), (again == F.col("root")).alias("verified"))
