"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame expressions only.

Every shard owns ``vnodes`` points of a ring; a row hashes to one of the arcs between them and asks for the shard whose
point ends the arc. A shard that is full passes the row clockwise to the next point. Rows arrive in ring order, so how
many of an arc's rows end where depends on the arcs' counts alone: the walk runs over one bounded array (shards * vnodes
counts), and each row finds its place by its rank in its arc. With ``epsilon`` 0 the capacities are the two whole numbers
around the mean, so counts differ by one at most; a larger epsilon moves fewer rows off their own arc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VNODES = 256


def ring(shards: int, vnodes: int = VNODES) -> Column:
    """The ring's points in clockwise order: array of (at, shard); positions are the upper 31 bits of a hash."""
    one = "transform(sequence(0, {n}), k -> struct(shiftrightunsigned(xxhash64(s, k, 'point'), 33) AS at, s AS shard))"
    return F.expr(f"array_sort(flatten(transform(sequence(0, {shards - 1}), s -> {one.format(n=vnodes - 1)})))")


def assign(docs: DataFrame, shards: int = 16, epsilon: float = 0.0, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, arc, shard, slot`` of every row.

    size: UTF-8 bytes of the text plus 1; a null text counts as empty (size 1, crc32 0). Rows are spread by a hash of id
    and text, so rows without an id are spread too; fully equal rows are interchangeable and numbered in any order.
    slot: 0, 1, ... within the shard. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    arcs = shards * vnodes
    hashed = F.xxhash64("doc_id", "text_crc32", "size")
    spark = docs.sparkSession
    points = spark.range(1).select(ring(shards, vnodes).alias("points"))
    # The arc that a row falls in, from a table of the ring's ends: 2^16 steps of the ring, each with its first arc.
    at = F.shiftrightunsigned(hashed, 33)
    ends = points.select(F.posexplode("points").alias("arc", "p")).select("arc", F.col("p.at").alias("end"), F.col("p.shard").alias("owner"))
    begins = ends.withColumn("begin", F.lag("end", 1, -1).over(Window.orderBy("arc")))
    slices = begins.union(points.select(F.lit(0), F.lit((1 << 31) - 1).cast("long"), F.element_at("points", 1)["shard"], F.element_at("points", -1)["at"]))
    slices = slices.where("end > begin").select("arc", "owner", "begin", "end", F.explode(F.expr("sequence((begin + 1) >> 15, end >> 15)")).alias("cell"))
    placed = rows.withColumn("at", at).withColumn("cell", F.expr("at >> 15")).join(F.broadcast(slices), "cell").where("at > begin and at <= end")

    counts = placed.groupBy("arc").agg(F.count("*").alias("n"))
    full = ends.join(F.broadcast(counts), "arc", "left").select("arc", "owner", F.coalesce("n", F.lit(0)).alias("n"))
    state = full.agg(F.array_sort(F.collect_list(F.struct("arc", "owner", "n"))).alias("arcs"), F.sum("n").alias("total"))
    state = state.withColumn("room", F.expr(
        f"transform(sequence(0, {shards - 1}), s -> CASE WHEN {float(epsilon)} > 0 THEN cast(ceil(total * (1 + {float(epsilon)}D) / {shards}) AS bigint) "
        f"ELSE cast(total div {shards} AS bigint) + CASE WHEN s < total % {shards} THEN 1 ELSE 0 END END)"))  # fmt: skip
    # Clockwise order of distinct shards from each arc on.
    state = state.withColumn("owners", F.expr("transform(arcs, x -> x.owner)"))
    state = state.withColumn("twice", F.expr("concat(owners, owners)"))
    near = min(arcs, 12 * shards)
    order = f"array_distinct(concat(slice(twice, cast(x.arc AS int) + 1, {near}), slice(twice, cast(x.arc AS int) + 1, {arcs})))"
    walk = f"""aggregate(arcs,
      named_struct('room', room, 'parts', cast(array() AS array<struct<arc:int,shard:int,first:bigint,n:bigint>>)),
      (acc, x) -> CASE WHEN x.n = 0 THEN acc
        WHEN element_at(acc.room, x.owner + 1) >= x.n THEN named_struct(
          'room', transform(acc.room, (r, i) -> r - CASE WHEN i = x.owner THEN x.n ELSE 0L END),
          'parts', concat(acc.parts, array(named_struct('arc', x.arc, 'shard', x.owner, 'first', 0L, 'n', x.n))))
        ELSE aggregate({order},
          named_struct('room', acc.room, 'parts', acc.parts, 'first', 0L),
          (b, s) -> CASE WHEN b.first >= x.n OR element_at(b.room, s + 1) = 0 THEN b ELSE named_struct(
            'room', transform(b.room, (r, i) -> r - CASE WHEN i = s THEN least(element_at(b.room, s + 1), x.n - b.first) ELSE 0L END),
            'parts', concat(b.parts, array(named_struct('arc', x.arc, 'shard', s, 'first', b.first, 'n', least(element_at(b.room, s + 1), x.n - b.first)))),
            'first', b.first + least(element_at(b.room, s + 1), x.n - b.first)) END,
          b -> named_struct('room', b.room, 'parts', b.parts)) END,
      acc -> acc.parts)"""
    parts = state.select(F.explode(F.expr(walk)).alias("p")).select("p.*")
    before = Window.partitionBy("shard").orderBy("arc", "first").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("at", "doc_id", "text_crc32", "size")) - 1)
    out = ranked.drop("owner").join(F.broadcast(parts), "arc").where("rank >= first and rank < first + n")
    return out.select("doc_id", "size", "text_crc32", "arc", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
