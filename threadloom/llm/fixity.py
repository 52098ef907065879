"""Fixity of web archives: WARC records, Merkle trees over their ordered offset ranges, and the audit of a replica.

The manifest orders all records by (page_id, digest) and lays them out in files of at most ``FILE`` records by ranges of that
order, so a record has a file, an offset and a length. A leaf is the SHA-256 of a record's bytes; a node hashes its
``FANOUT`` children in order, together with the range of offsets that each covers.

A replica is a folder of WARC files, written by whoever and cut and ordered in any way. Its records are read back, hashed
as they lie there, and make a tree of their own, over ranges of an order that both sides share (by a hash of the record id,
so that a record left out or put in shifts no other one). The manifest makes the same tree. Where roots differ, children of
differing nodes are compared, level by level; only records of ranges that differ meet: altered, missing, or added.

Two replicas of one layout can be compared by :func:`tree` and :func:`differing`, over the offset ranges of each file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import claim, shared_dir, ship, written

FANOUT, FILE = 16, 4096
#: Records of a range that an audit's tree hashes together, about.
RANGE = 16
#: The date and the header lines of the records written here.
DATE = "2024-01-01T00:00:00Z"
_CHUNK = 1 << 20


def record_id(key: Column, url: Column, body: Column) -> Column:
    name = F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("")).cast("binary"), F.coalesce(url, F.lit("")).cast("binary"), F.coalesce(body.cast("binary"), F.lit(b""))), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(name, 1, 8), F.lit("-"), F.substring(name, 9, 4), F.lit("-5"), F.substring(name, 14, 3), F.lit("-8"), F.substring(name, 18, 3), F.lit("-"), F.substring(name, 21, 12), F.lit(">"))


def record(key: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """The bytes of one WARC/1.1 resource record, its closing blank lines included; nulls count as empty."""
    data = F.coalesce(body.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", ""), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: "), record_id(key, url, body),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(data).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), data, F.lit(b"\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``page_id, record_id, sha256, length`` of every page's record, without its bytes. Repeated rows are records of their own."""
    parts = F.col(id_col), F.col(url_col), F.col(body_col)
    made = pages.select(F.col(id_col).alias("page_id"), record_id(*parts).alias("record_id"), record(*parts).alias("r"))
    return made.select("page_id", "record_id", F.sha2("r", 256).alias("sha256"), F.octet_length("r").cast("long").alias("length"))


def laid_out(found: DataFrame, per_file: int = FILE) -> DataFrame:
    """The manifest: ``file, seq, offset`` for each of :func:`records`, and ``copy``, its number among equal ones.

    The order is cut into files, and offsets start anew in each. Ranks come from ranges of page_id: rows are dealt by range,
    ranked inside their partition, and the partitions' counts are summed, so no task holds the whole order. Rows without
    page_id come first.
    """
    order = ["page_id", "sha256", "record_id"]
    dealt = written(found.repartitionByRange("page_id", "sha256").sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "records")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "base")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    ranked = dealt.withColumn("rank", rank).join(F.broadcast(starts), "part").withColumn("at", F.col("base") + F.col("rank"))  # a row per partition
    ranked = ranked.select("page_id", "record_id", "sha256", "length", "at", F.expr(f"at div {per_file}").alias("file"), F.expr(f"cast(at % {per_file} AS int)").alias("seq"))
    upto = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ranked = written(ranked.withColumn("offset", F.coalesce(F.sum("length").over(upto), F.lit(0)).cast("long")), "ranked")
    many = ranked.groupBy("record_id").agg(F.min("at").alias("first"), F.count("*").alias("copies")).where("copies > 1")  # equal records stand in a row
    return ranked.join(many, "record_id", "left").withColumn("copy", F.coalesce(F.col("at") - F.col("first"), F.lit(0))).withColumn("copies", F.coalesce("copies", F.lit(1))).drop("first", "at")


def tree(leaves: DataFrame, per_file: int = FILE, fanout: int = FANOUT) -> DataFrame:
    """``file, l0, l1, ...``: each file's nodes by level, arrays of (begin, end, digest); the last level has one node.

    ``leaves``: file, seq (0, 1, ... without gaps), begin, end, digest. A file has ``per_file`` leaves at most, so it is one row.
    """
    leaf = F.sort_array(F.collect_list(F.struct("seq", "begin", "end", "digest")))
    out = leaves.groupBy("file").agg(leaf.alias("l0")).withColumn("l0", F.expr("transform(l0, x -> struct(x.begin AS begin, x.end AS end, x.digest AS digest))"))
    level, width = 0, per_file
    while width > 1:
        width = -(-width // fanout)
        own = f"slice(l{level}, i * {fanout} + 1, {fanout})"
        text = f"array_join(transform({own}, x -> concat_ws(':', x.begin, x.end, x.digest)), '|')"
        node = f"struct(l{level}[i * {fanout}].begin AS begin, element_at({own}, -1).end AS end, sha2({text}, 256) AS digest)"
        out = out.withColumn(f"l{level + 1}", F.expr(f"transform(sequence(0, cast((size(l{level}) - 1) div {fanout} AS int)), i -> {node})"))
        level += 1
    return out


def differing(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``file, seq``: the leaves at which two :func:`tree` tables of the same files differ.

    Roots are compared first; of files whose roots differ, children of differing nodes only.
    """
    top = max(int(c[1:]) for c in left.columns if c != "file")
    root = lambda t, name: t.select("file", F.col(f"l{top}")[0]["digest"].alias(name))
    bad = written(root(left, "a").join(root(right, "b"), "file").where("a <> b").select("file"), "roots")
    a, b = (t.join(bad, "file", "left_semi") for t in (left, right))
    both = a.join(b.select("file", *[F.col(f"l{k}").alias(f"r{k}") for k in range(top + 1)]), "file").withColumn(f"bad{top}", F.array(F.lit(0)))
    for k in range(top - 1, -1, -1):
        below = f"flatten(transform(bad{k + 1}, i -> sequence(i * {fanout}, least(i * {fanout} + {fanout - 1}, size(l{k}) - 1))))"
        both = both.withColumn(f"bad{k}", F.expr(f"filter({below}, j -> l{k}[j].digest <> r{k}[j].digest)"))
    return both.select("file", F.explode("bad0").alias("seq"))


def place(record_id: Column) -> Column:
    """Where a record stands in the order that trees of any two layouts share: 32 bits of its id's hash."""
    return F.conv(F.substring(F.sha2(F.coalesce(record_id, F.lit("")).cast("binary"), 256), 1, 8), 16, 10).cast("long")


def range_tree(held: DataFrame, depth: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of one side's tree, root first, each ``at, digest``. ``held``: record_id, sha256, n, long.

    The order of :func:`place` falls into fanout ** depth ranges. A leaf of the tree hashes the records of one range in order,
    each with the offsets that it begins and ends at in the range and its number of copies; a node hashes its children.
    Ranges without a record have no node.
    """
    p = place(F.col("record_id"))
    at = F.expr(f"cast((_p * {fanout**depth}) div 4294967296 as long)")
    rows = held.withColumn("_p", p).withColumn("at", at)
    order = F.sort_array(F.collect_list(F.struct("_p", "record_id", "sha256", "long", "n")))
    text = """aggregate(x, struct(cast(0 as long) as o, array('') as t),
      (s, r) -> struct(s.o + r.long * r.n as o, array(concat(s.t[0], s.o, ':', s.o + r.long * r.n, ':', r.n, ':', coalesce(r.record_id, ''), ':', r.sha256, '|')) as t)).t[0]"""
    out = [written(rows.groupBy("at").agg(order.alias("x")).select("at", F.sha2(F.expr(text), 256).alias("digest")), "tree")]
    for _ in range(depth):
        kids = F.sort_array(F.collect_list(F.struct("at", "digest")))  # fanout at most
        node = F.array_join(F.transform("x", lambda k: F.concat_ws(":", k["at"].cast("string"), k["digest"])), "|")
        up = out[0].groupBy(F.expr(f"at div {fanout}").alias("up")).agg(kids.alias("x")).select(F.col("up").alias("at"), F.sha2(node, 256).alias("digest"))
        out.insert(0, written(up, "tree"))
    return out


def suspects(ours: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """``at`` of the ranges in which two trees differ: roots are compared first, then only children of differing nodes."""
    bad = None
    for a, b in zip(ours, theirs, strict=True):
        if bad is not None:
            below = bad.select(F.col("at").alias("up"))
            a, b = (t.withColumn("up", F.expr(f"at div {fanout}")).join(below, "up", "left_semi").drop("up") for t in (a, b))
        both = a.join(b.select("at", F.col("digest").alias("other")), "at", "full")
        bad = written(both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("at"), "differing")
    return bad


def audit(manifest: DataFrame, replica: DataFrame, per_range: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """``page_id, file, seq, offset, length, sha256, status`` of every record of ``manifest`` and every added one.

    ``replica``: record_id, sha256, length of the records that a replica holds, see :func:`read_warc`. status: ``ok``,
    ``altered``, ``missing``, or ``added``: a record that the manifest does not have, or has fewer of; its page_id, file, seq
    and offset are null. Of equal records the first ones count as held. Empty tables on either side are allowed.

    Each side is hashed into its own tree, over ranges of about ``per_range`` records; records of the two sides meet in the
    ranges whose digests differ, and nowhere else.
    """
    count = lambda t: t.groupBy("record_id", "sha256").agg(F.count("*").alias("n"), F.min("length").alias("long"))
    ours, theirs = written(count(manifest), "known"), written(count(replica), "held")
    depth, ranges = 0, ours.count() / per_range
    while fanout**depth < ranges:
        depth += 1
    bad = suspects(range_tree(ours, depth, fanout), range_tree(theirs, depth, fanout), fanout)
    at = F.expr(f"cast((_p * {fanout**depth}) div 4294967296 as long)")
    dealt = lambda t: t.withColumn("_p", place(F.col("record_id"))).withColumn("at", at).drop("_p")
    rows = dealt(manifest)
    doubted = written(rows.join(bad, "at", "left_semi").drop("at"), "doubted")
    held = written(dealt(theirs).join(bad, "at", "left_semi").drop("at"), "found")
    good = held.withColumnRenamed("n", "intact").drop("long")
    total = held.groupBy("record_id").agg(F.sum("n").alias("there"))
    both = doubted.join(good, ["record_id", "sha256"], "left").join(total, "record_id", "left")
    intact, there = F.coalesce("intact", F.lit(0)), F.coalesce("there", F.lit(0))
    status = F.when(F.col("copy") < intact, "ok").when(F.col("copy") < there, "altered").otherwise("missing")
    columns = ["page_id", "file", "seq", "offset", "length", "sha256"]
    kept = both.select(*columns, status.alias("status")).union(rows.join(bad, "at", "left_anti").select(*columns, F.lit("ok").alias("status")))
    known = doubted.groupBy("record_id").agg(F.max("copies").alias("copies"))
    own = doubted.groupBy("record_id", "sha256").agg(F.count("*").alias("own"))
    stray = held.join(known, "record_id", "left").join(own, ["record_id", "sha256"], "left").join(total, "record_id", "left")
    # Beyond the manifest's copies: all of an unknown id, else what is over of the intact ones, then of the others.
    over = F.when(F.col("copies").isNull(), F.col("n")).otherwise(F.greatest(F.lit(0), F.least(F.col("there") - F.col("copies"), F.col("n") - F.coalesce("own", F.lit(0)))))
    stray = stray.withColumn("over", over.cast("int")).where("over > 0").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("over"))))
    null = lambda c: F.lit(None).cast(manifest.schema[c].dataType).alias(c)
    return kept.union(stray.select(null("page_id"), null("file"), null("seq"), null("offset"), F.col("long").alias("length"), "sha256", F.lit("added").alias("status")))


def write_warc(made: DataFrame, path: str, per_file: int = FILE, gzip: bool = True) -> None:
    """Write records (column ``r``: bytes, blank lines included) as WARC files through Spark's own writer, any store it reaches."""
    body = F.expr("cast(substring(r, 1, octet_length(r) - 4) AS string)")  # the writer closes each with the blank lines
    out = made.select(body.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file)
    out.option("compression", "gzip" if gzip else "none").option("zlib.compress.level", "BEST_SPEED").text(path)


def parse(data) -> list[tuple[int, int, str | None, str | None, str]]:
    """offset, length, record id, target and SHA-256 of each record of a WARC file (plain, or gzip in any number of members).

    Lengths come from headers. Where a header cannot be read, or the file ends early, the rest of it is one record without id.
    """
    out, buffer, base = [], b"", 0
    for part in _inflated(data):
        buffer = buffer + part if part is not None else buffer
        at = 0
        while True:
            head = buffer.find(b"\r\n\r\n", at)
            if head < 0 or not buffer.startswith(b"WARC/", at):
                break
            fields = dict(x.split(b": ", 1) for x in buffer[at:head].split(b"\r\n")[1:] if b": " in x)
            size = fields.get(b"Content-Length", b"")
            if not size.isdigit():
                break
            end = head + 8 + int(size)
            if end > len(buffer) or buffer[end - 4 : end] != b"\r\n\r\n":
                break
            name = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None  # noqa: B023, E731
            out.append((base + at, end - at, name(b"WARC-Record-ID"), name(b"WARC-Target-URI"), hashlib.sha256(memoryview(buffer)[at:end]).hexdigest()))
            at = end
        buffer, base = buffer[at:], base + at
    if buffer:
        out.append((base, len(buffer), None, None, hashlib.sha256(buffer).hexdigest()))
    return out


def _inflated(data):
    """A file's bytes in chunks, unpacked where it is gzip; a broken member ends it."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield bytes(data)
        return
    unpack, at, rest = zlib.decompressobj(31), 0, b""
    while at < len(data) or rest:
        if not rest:
            rest, at = bytes(data[at : at + _CHUNK]), at + _CHUNK
        try:
            yield unpack.decompress(rest)
        except zlib.error:
            return
        rest = unpack.unused_data
        if unpack.eof:
            unpack = zlib.decompressobj(31)


def read_warc(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    """``path, offset, length, record_id, url, sha256`` of every record of the WARC files in a folder, as they lie there."""
    ship(spark)

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = parse(memoryview(data.as_buffer()))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["path", "offset", "length", "record_id", "url", "sha256"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, "path string, offset long, length long, record_id string, url string, sha256 string")


def damaged(pages: DataFrame, altered: Column, missing: Column, added: Column, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Records ``r`` of a replica with faults: the last byte of the body changed, the record left out, a stray one after it.

    A record without a body has no byte to change and stays whole.
    """
    parts = F.col(id_col), F.col(url_col), F.col(body_col)
    rows = pages.select(record(*parts).alias("r"), altered.alias("a"), missing.alias("m"), added.alias("s"), F.coalesce(F.octet_length(F.col(body_col)), F.lit(0)).alias("n"), F.col(id_col).cast("string").alias("k"))
    last = F.expr("substring(r, octet_length(r) - 4, 1)")
    broken = F.concat(F.expr("substring(r, 1, octet_length(r) - 5)"), F.when(last == F.lit(b"~"), F.lit(b"!")).otherwise(F.lit(b"~")), F.lit(b"\r\n\r\n"))
    own = F.when(F.coalesce("m", F.lit(False)), None).when(F.coalesce("a", F.lit(False)) & (F.col("n") > 0), broken).otherwise(F.col("r"))
    stray = F.when(F.coalesce("s", F.lit(False)), record(F.lit(None), F.concat(F.lit("http://stray.example/"), F.coalesce("k", F.lit(""))), F.lit(None).cast("string")))
    return rows.select(F.explode(F.array(own, stray)).alias("r")).where("r IS NOT NULL")


def drill(pages: DataFrame, altered: Column, missing: Column, added: Column, per_file: int = FILE, fanout: int = FANOUT, **names) -> DataFrame:
    """Write a replica of all pages' records with known faults as WARC files, read it back, and :func:`audit` it.

    Pages with null or empty url or html are records with an empty part; repeated rows are records of their own; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    manifest = written(laid_out(records(pages, **names), per_file), "manifest")
    path = claim(spark, f"{shared_dir(spark)}/threadloom/replica-{uuid.uuid4().hex}")
    write_warc(damaged(pages, altered, missing, added, **names), path, per_file)
    return audit(manifest, read_warc(spark, path), fanout=fanout)
