"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens; a window of ``length`` tokens is a round that visits the queues in turn. A queue's deficit
is what it has been granted less than its share of all tokens served so far, and a round's tokens go, one by one, to the
queue whose next token is longest overdue: token t of a queue of T_s of all T tokens is due at (t + 1/2) / T_s. So every
window is filled and holds each source at its target to within a token or so, and only the last window is padded.

What the queues have been granted after M tokens depends on M alone, so deficits carry over windows and partitions without
anybody playing the rounds from the start: a partition that knows where its documents stand in their queues finds their
windows, and cuts them there. Tests hold the grants against the plain loop, token by token.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, jvm
from .shared import ship, spare, written

LENGTH, END = 2048, 1
#: Sources whose totals the driver and every worker hold (a bound of memory); more raise.
SOURCES = 1_000_000
#: Windows times sources that are worked on at a time, and documents.
_CELLS, _DOCS = 1 << 21, 2000


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end: int = END, in_jvm: bool = True) -> DataFrame:
    """``doc_id, source, part, local, n, width, ids``: ids with the end id; ``local``: tokens of its source before it in its part.

    ``in_jvm``: encode plain texts there, by functions that come as a jar; else the workers encode all. The ids are the same.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = bpe.load(spark, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if in_jvm:
        rows, width = jvm.encoded(rows, spec.value)  # a text that is not plain is left to the workers
    else:
        rows, width = rows.withColumn("ids", F.lit(None).cast("binary")), bpe.width_of(spec.value)

    def run(batches):
        last, encoder = end.to_bytes(width, "little"), None
        part, served = TaskContext.get().partitionId(), {}
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                c = b.slice(at, 1000)
                ids = []
                for t, known in zip(c.column("text"), c.column("ids"), strict=True):
                    if known.is_valid:
                        ids.append(known.as_py() + last)
                    else:
                        encoder = encoder or bpe.model(spec.value, bpe.RankBpe)
                        ids.append(encoder.ids_bytes(t.as_py()) + last)
                n = [len(x) // width for x in ids]
                local = []
                for q, k in zip(c.column("source").to_pylist(), n, strict=True):
                    local.append(served.get(q, 0))
                    served[q] = local[-1] + k
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("source"), pa.array([part] * len(n), pa.int32()), pa.array(local, pa.int64()), pa.array(n, pa.int64()), pa.array([width] * len(n), pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "source", "part", "local", "n", "width", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, source string, part int, local long, n long, width int, ids binary")


class Rounds:
    """The round-robin over queues of ``sizes`` tokens: where in the windows each token is served."""

    def __init__(self, sizes: np.ndarray, length: int = LENGTH):
        self.sizes, self.length = np.asarray(sizes, np.int64), length
        self.total = int(self.sizes.sum())

    def _due(self, time: np.ndarray) -> np.ndarray:
        return np.floor(time[:, None] * self.sizes + 0.5)

    def granted(self, tokens: np.ndarray) -> np.ndarray:
        """What the queues (columns) have been granted after so many tokens in all (rows).

        Bisection looks for a time by which just as many tokens are due; queues due together are served in either order, but the
        same one for everybody who asks.
        """
        sizes, total = self.sizes, self.total
        tokens = np.minimum(tokens, total)
        lo, hi = np.maximum(0, (tokens - len(sizes) - 1) / total), np.minimum(1, (tokens + len(sizes) + 1) / total)
        for _ in range(64):
            mid = (lo + hi) / 2
            n = self._due(mid).sum(axis=1)
            hi, lo = np.where(n >= tokens, mid, hi), np.where(n <= tokens, mid, lo)
            if (lo == hi).all():
                break
        base = self._due(lo)
        extra = self._due(hi) - base
        before = np.cumsum(extra, axis=1) - extra
        out = base + np.clip((tokens - base.sum(axis=1))[:, None] - before, 0, extra)
        out[tokens == total] = sizes
        return out.astype(np.int64)

    def rank(self, token: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """About how many tokens are served before a queue's token: off by one for each queue at most."""
        out, step = np.empty(len(token), np.int64), max(1, _CELLS // len(self.sizes))
        for k in range(0, len(token), step):
            part = slice(k, k + step)
            out[part] = self._due((token[part] + 0.5) / self.sizes[queue[part]]).sum(axis=1)
        return out

    def pieces(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray):
        """Pieces of documents that stand at ``at`` in their queues: index, start, length, window and offset of each."""
        off = len(self.sizes) + 2
        first = np.maximum(0, self.rank(at, queue) - off) // self.length
        last = np.minimum(self.total - 1, self.rank(at + n - 1, queue) + off) // self.length
        count = last - first + 1
        doc = np.repeat(np.arange(len(at)), count)
        window = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(doc))
        low, high, ahead = (np.empty(len(doc), np.int64) for _ in range(3))
        some, which = np.unique(window, return_inverse=True)
        order, step = np.argsort(which, kind="stable"), max(1, _CELLS // len(self.sizes))
        for k in range(0, len(some), step):
            w = some[k : k + step]
            begin, stop = self.granted(w * self.length), self.granted((w + 1) * self.length)
            before = np.cumsum(stop - begin, axis=1) - (stop - begin)
            own = order[np.searchsorted(which[order], k) : np.searchsorted(which[order], k + len(w))]
            cell = which[own] - k, queue[doc[own]]
            low[own], high[own], ahead[own] = begin[cell], stop[cell], before[cell]
        begin, stop = np.maximum(at[doc], low), np.minimum((at + n)[doc], high)
        live = stop > begin
        doc, begin, stop = doc[live], begin[live], stop[live]
        return doc, begin - at[doc], stop - begin, window[live], ahead[live] + begin - low[live]


def pieces(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Where every document of a :func:`tokenised` table goes, one row per piece."""
    spark = rows.sparkSession
    totals = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(totals.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("source").alias("_s"), F.col("part").alias("_p"), "base", "n"), "starts")
    found = starts.groupBy("_s").agg(F.sum("n").alias("n")).orderBy(F.col("_s").asc_nulls_first()).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: map them to fewer first")
    sent = spark.sparkContext.broadcast(({r["_s"]: k for k, r in enumerate(found)}, Rounds(np.array([r.n for r in found], np.int64), length)))  # SOURCES entries at most
    both = rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))).select("doc_id", "source", (F.col("base") + F.col("local")).alias("at"), rows["n"], "width", "ids")

    def run(batches):
        place_of, rounds = sent.value
        spare()
        for b in batches:
            for first in range(0, b.num_rows, _DOCS):
                c = b.slice(first, _DOCS)
                at, n = (c.column(x).to_numpy(zero_copy_only=False) for x in ("at", "n"))
                queue = np.array([place_of[q] for q in c.column("source").to_pylist()], np.int64)
                doc, start, size, window, offset = rounds.pieces(queue, at, n)
                ids, width = c.column("ids"), c.column("width").to_pylist()
                crc, seen, raw = [], -1, b""
                for r, s, m in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True):
                    if r != seen:
                        seen = r
                        raw = memoryview(np.frombuffer(ids[r].as_buffer(), "<u2" if width[r] == 2 else "<u4").astype("<u4")).cast("B")
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + m)]))
                rows_ = pa.array(doc)
                yield pa.RecordBatch.from_arrays([c.column("doc_id").take(rows_), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(window), pa.array(offset), c.column("source").take(rows_)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def packed(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, **names) -> DataFrame:
    """Pack every document: one row per piece, with its source queue. ``path``: the tokenizer file.

    A null text counts as empty, so it is the end id alone; a null source is a queue of its own; repeated rows are packed
    as often as they occur; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    return pieces(written(tokenised(docs, path, end=end, **names), "tokens"), length)
