"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Every id is coded as binary decisions; for each decision the order-0, order-1 and order-2 predictions are mixed in the
logistic domain with weights that learn, and the mixed chance drives the range coder. A block starts from the same state as
any other, so each can be decoded, and checked, alone. The coder itself is scalar and sequential, which neither columns nor
numpy can hide, so it is a Java function (``MixingCoder.java``, see :mod:`.jvm`), as is the plain merge loop that most texts
are encoded with (``WordBpe.java``).

A file holds segments of whole documents, each a header, the directory of its documents and the coded ids::

    "TLS1" | file, seg, n_docs, n_ids, size of the directory (5 x u32) | directory (zlib: doc_id steps i64, lengths u64,
    flags u8 that are 0 for a null doc_id) | u32 CRC-32 of all so far | u64 big-endian size | coded ids | newline
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, jvm
from .shared import claim, shared_dir, ship

#: The id after each document, and the ids of a block.
END, BLOCK = 2, 1 << 17
#: Ids after which a segment is closed (a bound of memory), and segments of a file.
SEGMENT, FILE_SEGMENTS = 1 << 20, 32
_MAGIC, _HEAD = b"TLS1", struct.Struct("<4s5I")


def directory(file: int, seg: int, doc_ids: list, lengths: list[int]) -> bytes:
    """Header and directory of a segment, checksummed; ``doc_ids`` may hold nulls."""
    known = np.array([i is not None for i in doc_ids], np.uint8)
    names = np.array([0 if i is None else i for i in doc_ids], "<i8")
    listing = zlib.compress(np.diff(names, prepend=0).astype("<i8").tobytes() + np.array(lengths, "<u8").tobytes() + known.tobytes(), 1)
    body = _HEAD.pack(_MAGIC, file, seg, len(doc_ids), sum(lengths), len(listing)) + listing
    return body + struct.pack("<I", zlib.crc32(body))


def read_directory(data: bytes) -> tuple[list, list[int]]:
    """doc_ids and lengths; ValueError where it is damaged."""
    _, _, _, n, _, _ = _HEAD.unpack_from(data)
    if zlib.crc32(data[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise ValueError("the segment's header or directory is damaged")
    listing = zlib.decompress(data[_HEAD.size : -4])
    names, known = np.cumsum(np.frombuffer(listing, "<i8", n)), np.frombuffer(listing, np.uint8, n, 16 * n)
    return [int(i) if ok else None for i, ok in zip(names, known, strict=True)], np.frombuffer(listing, "<u8", n, 8 * n).tolist()


def split(data) -> list[tuple[int, int, int, bytes, bytes]]:
    """file, seg, n_ids, directory and coded ids of every segment of a file."""
    out, at = [], 0
    while at < len(data):
        magic, file, seg, _, n_ids, listing = _HEAD.unpack_from(data, at)
        if magic != _MAGIC:
            raise ValueError("not a file of token ids")
        stop = at + _HEAD.size + listing + 4
        end = stop + 8 + int.from_bytes(data[stop : stop + 8], "big")
        if end >= len(data) or data[end] != 10:
            raise ValueError("a segment is cut short")
        out.append((file, seg, n_ids, bytes(data[at:stop]), bytes(data[stop + 8 : end])))
        at = end + 1
    return out


def segments(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", size: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """``data binary``, a segment a row: all documents in ascending doc_id order, file by file and segment by segment.

    ``path``: the tokenizer file. A null text counts as empty (the end id alone); rows without doc_id come first; rows of
    equal doc_id keep any order and may lie in several files; other columns are ignored, whatever their names; an empty
    table gives no segment.
    """
    spark = docs.sparkSession
    ship(spark)
    jvm.register(spark)
    spec = bpe.load(spark, path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id")  # the place parts the rows of a hot doc_id
    rows, width = jvm.encoded(rows.select("doc_id", "text"), spec.value)  # a text that is not plain is left to the workers

    def run(batches):
        stop = end.to_bytes(width, "little")
        file, seg, names, lengths, parts, held, encoder = TaskContext.get().partitionId(), 0, [], [], [], 0, None

        def close():
            return pa.RecordBatch.from_arrays([pa.array([directory(file, seg, names, lengths)], pa.binary()), pa.array([b"".join(parts)], pa.binary())], ["directory", "ids"])

        for b in batches:
            for i, t, known in zip(b.column("doc_id"), b.column("text"), b.column("ids"), strict=True):
                if known.is_valid:
                    raw = known.as_py() + stop
                else:
                    encoder = encoder or bpe.model(spec.value, bpe.RankBpe)
                    raw = encoder.ids_bytes(t.as_py()) + stop
                names.append(i.as_py())
                lengths.append(len(raw) // len(stop))
                parts.append(raw)
                held += lengths[-1]
                if held >= size:
                    yield close()
                    seg, names, lengths, parts, held = seg + 1, [], [], [], 0
        if names:
            yield close()

    made = rows.mapInArrow(run, "directory binary, ids binary")
    made = made.select("directory", F.expr(f"threadloom_encode{width}(ids, {int(block)})").alias("coded"))
    return made.select(F.concat("directory", F.unhex(F.lpad(F.hex(F.octet_length("coded")), 16, "0")), "coded").alias("data"))


def write(docs: DataFrame, path: str, out: str, **names) -> None:
    """Write :func:`segments` as files under ``out``, through Spark's own writer (any store that Spark reaches)."""
    made = segments(docs, path, **names).select(F.col("data").cast("string").alias("value"))  # bytes as they are; a line is a segment
    made.write.mode("append").option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", FILE_SEGMENTS).text(out)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files under ``path``, decoded and checked.

    ``start``: ids of all documents before it, in the files' order. A damaged directory, block or index raises. A folder
    without segments gives an empty result.
    """
    ship(spark)
    jvm.register(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")

    def sizes(batches):
        for b in batches:
            for data in b.column("content"):
                found = split(memoryview(data.as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64())], ["file", "seg", "n_ids"])

    def parts(batches):
        for b in batches:
            for data in b.column("content"):
                for file, seg, _, listing, coded in split(memoryview(data.as_buffer())):
                    yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([seg], pa.int32()), pa.array([listing], pa.binary()), pa.array([coded], pa.binary())], ["file", "seg", "directory", "coded"])

    def cut(batches):
        for b in batches:
            for f, s, listing, raw in zip(b.column("file"), b.column("seg"), b.column("directory"), b.column("ids"), strict=True):
                names, lengths = read_directory(listing.as_py())
                width = len(raw.as_buffer()) // max(1, sum(lengths))
                ids = memoryview(np.frombuffer(raw.as_buffer(), "<u4" if width == 4 else "<u2").astype("<u4")).cast("B")
                stops = np.cumsum(np.array(lengths, np.int64))
                starts = stops - lengths
                sums = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(starts.tolist(), stops.tolist(), strict=True)]
                k = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([f.as_py()] * k, pa.int32()), pa.array([s.as_py()] * k, pa.int32()), pa.array(names, pa.int64()), pa.array(starts), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["file", "seg", "doc_id", "local", "n_tokens", "ids_crc32"])

    counts = files.mapInArrow(sizes, "file int, seg int, n_ids long")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_file = counts.groupBy("file").agg(F.sum("n_ids").alias("n_ids")).select("file", before(Window.orderBy("file")).alias("first"))  # a row per file
    of_seg = counts.select("file", "seg", before(Window.partitionBy("file").orderBy("seg")).alias("base")).join(of_file, "file")
    held = files.mapInArrow(parts, "file int, seg int, directory binary, coded binary").select("file", "seg", "directory", F.expr("threadloom_decode(coded)").alias("ids"))
    rows = held.mapInArrow(cut, "file int, seg int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(of_seg, ["file", "seg"]).select("doc_id", (F.col("first") + F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, **names) -> DataFrame:
    """Write every document's ids to files in the shared folder and report what reading them back gives.

    Nulls, repeated rows, empty tables and other columns as in :func:`segments`.
    """
    spark = docs.sparkSession
    out = claim(spark, f"{shared_dir(spark)}/threadloom/token-files-{uuid.uuid4().hex}")
    write(docs, path, out, **names)
    return documents(spark, out)
