"""Ordered scans in two levels, for conversations that no single task should hold.

Rows are dealt by range of (conversation, order), so a long conversation lies in many ranges, one after another. What a
window over the whole conversation would see is put together from a window inside a range and what the ranges before it
hand on: their counts, sums and last values, one row for each range and conversation. Results are those of the windows in
``messages`` and ``sessions``; those are the shorter way where conversations are many and none is long.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions import times
from ..functions.ship import ship
from ..sources.store import written
from .chunks import BYTES, SIZE
from .sessions import GAP

#: Rows of a conversation that are cut into chunks together, at least.
BLOCK = 4096


@dataclass(frozen=True)
class Scan:
    """``rows`` with ``_part`` (the range) and ``_at`` (the place inside it), in the order of conversation and ``order``."""

    rows: DataFrame
    key: str = "conv_id"

    @classmethod
    def of(cls, rows: DataFrame, order: list[Column], key: str = "conv_id", ranges: int | None = None) -> Scan:
        """Deal ``rows`` by range. A null conversation is one of its own; rows equal in order and key stay together in any order."""
        names = [f"_o{k}" for k in range(len(order))]
        keyed = rows.withColumns(dict(zip(names, order, strict=True))).withColumn("_salt", F.monotonically_increasing_id())
        by = [key, *names, "_salt"]
        dealt = (keyed.repartitionByRange(ranges, *by) if ranges else keyed.repartitionByRange(*by)).sortWithinPartitions(*by)
        place = F.expr("monotonically_increasing_id() & 8589934591").alias("_at")  # without the partition's number
        return cls(written(dealt.select(*rows.columns, F.spark_partition_id().alias("_part"), place), "scan"), key)

    @property
    def _inside(self):
        return Window.partitionBy("_part", self.key).orderBy("_at")

    def _carry(self, value: Column, before: Column) -> DataFrame:
        """``_p, _k, carried``: for each range and conversation what ``before`` (a window function over ``v``) says of the ranges before it."""
        each = self.rows.groupBy("_part", self.key).agg(value.alias("v"))
        return each.select(F.col("_part").alias("_p"), F.col(self.key).alias("_k"), before.alias("carried"))

    def _with(self, carry: DataFrame, name: str, value: Column) -> Scan:
        r = self.rows
        both = r.join(carry, (r["_part"] == carry["_p"]) & r[self.key].eqNullSafe(carry["_k"])).drop("_p", "_k")
        return replace(self, rows=both.withColumn(name, value).drop("carried"))

    def _ranges(self):
        return Window.partitionBy(self.key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def numbered(self, name: str = "position") -> Scan:
        """Places from 1 in each conversation."""
        carry = self._carry(F.struct(F.count("*").alias("n"), F.min("_at").alias("a")), F.struct(F.coalesce(F.sum("v.n").over(self._ranges()), F.lit(0)).alias("n"), F.col("v.a").alias("a")))
        # Written, so that its true size is known: where conversations are few, the rows stay where they are.
        return self._with(written(carry, "handed-on"), name, (F.col("carried.n") + F.col("_at") - F.col("carried.a") + 1).cast("int"))

    def running(self, flag: Column, name: str) -> Scan:
        """The sum of ``flag`` over all rows up to this one."""
        one = replace(self, rows=self.rows.withColumn("_f", flag.cast("long")))
        carry = one._carry(F.sum("_f"), F.coalesce(F.sum("v").over(self._ranges()), F.lit(0)))
        inside = F.sum("_f").over(self._inside.rowsBetween(Window.unboundedPreceding, 0))
        out = one._with(carry, name, F.coalesce(inside, F.lit(0)) + F.col("carried"))
        return replace(out, rows=out.rows.drop("_f"))

    def before(self, value: Column, name: str, known: bool = False) -> Scan:
        """``value`` of the row before (null for the first), or of the last row before where it is not null (``known``)."""
        one = replace(self, rows=self.rows.withColumn("_v", value).withColumn("_b", F.struct("_v")))
        here = self._inside.rowsBetween(Window.unboundedPreceding, -1)
        if known:  # a struct, so that a null value and no value are told apart
            last, mine = F.max_by("_b", F.when(F.col("_v").isNotNull(), F.col("_at"))), F.last(F.when(F.col("_v").isNotNull(), F.col("_b")), True).over(here)
        else:
            last, mine = F.max_by("_b", "_at"), F.lag("_b").over(self._inside)
        carry = one._carry(last, F.last("v", True).over(self._ranges()))
        out = one._with(carry, name, F.coalesce(mine, F.col("carried"))["_v"])
        return replace(out, rows=out.rows.drop("_v", "_b"))

    def result(self) -> DataFrame:
        return self.rows.drop("_part", "_at")


def positioned(messages: DataFrame, ranges: int | None = None) -> DataFrame:
    """``messages.positioned``, a conversation in many tasks."""
    tier = F.when(F.col("epoch").isNotNull(), 0).when(F.col("time").isNotNull(), 1).otherwise(2)
    key = F.coalesce(F.col("epoch"), times.seconds(F.col("time")).cast("double"), F.col("original_index").cast("double"))
    return Scan.of(messages, [tier, key, F.col("original_index")], ranges=ranges).numbered().result()


def turns(messages: DataFrame, ranges: int | None = None) -> DataFrame:
    """``sessions.turns``, a conversation in many tasks."""
    s = Scan.of(messages, [F.col("position")], ranges=ranges).before(F.col("sender"), "_s")
    return s.running(F.col("_s").isNull() | (F.col("_s") != F.col("sender")), "turn").result().drop("_s")


def gap_sessions(messages: DataFrame, gap: int = GAP, ranges: int | None = None) -> DataFrame:
    """``sessions.gap_sessions``, a conversation in many tasks."""
    seconds = times.seconds(F.col("time"))
    s = Scan.of(messages, [F.col("position")], ranges=ranges).before(seconds, "_l", known=True)
    out = s.running(F.coalesce(seconds - F.col("_l") > gap, F.lit(False)), "session").result().drop("_l")
    return out.withColumn("session", F.col("session") + 1)


def context_sessions(messages: DataFrame, gap: int = GAP, use_epoch: bool = True, ranges: int | None = None) -> DataFrame:
    """``sessions.context_sessions``, a conversation in many tasks."""
    local = times.epoch_utc8(F.col("time")).cast("double")
    clock = F.coalesce(F.col("epoch"), local) if use_epoch else local
    s = Scan.of(messages.withColumn("_c", clock), [F.col("position")], ranges=ranges).before(F.col("_c"), "_l")
    split = F.col("_l").isNull() | F.col("_c").isNull() | (F.abs(F.col("_c") - F.col("_l")) > gap)
    return s.running(split, "session").result().drop("_c", "_l")


def _cuts(costs: np.ndarray, size: int, most: int) -> np.ndarray:
    """For each row the row that opens the next chunk if this one opens one."""
    n = len(costs)
    sums = np.concatenate([[0], np.cumsum(costs)])
    fit = np.searchsorted(sums, sums[:-1] + most, "right") - 1  # rows before it fit together
    at = np.arange(n)
    return np.maximum(at + 1, np.minimum(np.minimum(fit, at + size), n))


def chunked(rows: DataFrame, size: int = SIZE, most: int = BYTES, ranges: int | None = None, block: int = BLOCK) -> DataFrame:
    """``chunks.chunked``: the same greedy cut, of one conversation in many tasks.

    A conversation falls into blocks of rows. Where a chunk opens decides where all later ones do, so a block is a function
    from the row that opens its first chunk to the row that opens the first one after the block, with the chunks between; it
    is computed for every row at once, by pointers to the next cut, and is a step function. Then a task for each conversation
    walks over its blocks, a row for each, and the blocks are cut, each from its own first row on. A chunk holds at most
    min(size, most) rows, as each costs a byte or more, so a block looks so far ahead. A null size counts as 0 bytes.
    """
    spark = rows.sparkSession
    ship(spark)
    ahead = min(size, most)
    block = max(block, ahead)
    slim = rows.select("conv_id", "position", F.col("bytes").cast("long").alias("bytes"))
    numbered = Scan.of(slim, [F.col("position")], ranges=ranges).numbered("_n").result()
    at = numbered.withColumn("_n", F.col("_n").cast("long") - 1).withColumn("_b", F.floor(F.col("_n") / block))
    own = written(at, "blocks")
    # A row also stands behind the block before, if that one looks so far.
    extra = own.where((F.col("_b") > 0) & (F.col("_n") % block < ahead)).withColumn("_b", F.col("_b") - 1)
    kind = own.schema["conv_id"]

    def groups(batches, names):
        """The columns of each (conv_id, _b), which come in order; a block is all that is held."""
        now, held = None, None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "_b", *names)), strict=True):
                if row[:2] != now:
                    if now is not None:
                        yield now, held
                    now, held = row[:2], [[] for _ in names]
                for h, x in zip(held, row[2:], strict=True):
                    h.append(x)
        if now is not None:
            yield now, held

    conv_type = lambda b: b.schema.field("conv_id").type

    def mapped(batches):
        first = next(batches, None)
        if first is None:
            return
        kind_ = conv_type(first)
        for (conv, b), (n, size_) in groups((x for part in ([first], batches) for x in part), ("_n", "bytes")):
            cut = _cuts(np.array([(x or 0) + 1 for x in size_]), size, most)
            inside = min(block, len(n))
            after, count = [0] * inside, [0] * inside
            for i in range(inside - 1, -1, -1):
                j = int(cut[i])
                after[i], count[i] = (j, 1) if j >= inside else (after[j], count[j] + 1)
            upto = [i for i in range(inside) if i == inside - 1 or (after[i], count[i]) != (after[i + 1], count[i + 1])]
            one = lambda xs: pa.array([xs], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind_), pa.array([b], pa.int64()), one([n[0] + i for i in upto]), one([n[0] + after[i] for i in upto]), one([count[i] for i in upto])], ["conv_id", "_b", "upto", "after", "count"])

    steps_type = StructType([kind, StructField("_b", LongType()), *[f for f in StructType.fromDDL("upto array<long>, after array<long>, count array<long>")]])
    steps = own.union(extra).repartition("conv_id", "_b").sortWithinPartitions("conv_id", "_b", "_n").select("conv_id", "_b", "_n", "bytes").mapInArrow(mapped, steps_type)

    def walked(batches):
        conv, entry, chunk, started = None, 0, 1, False
        for b in batches:
            out = []
            for c, k, upto, after, count in zip(*(b.column(x).to_pylist() for x in ("conv_id", "_b", "upto", "after", "count")), strict=True):
                if not started or c != conv:
                    conv, entry, chunk, started = c, 0, 1, True
                out.append((c, k, entry, chunk))
                i = int(np.searchsorted(upto, entry))
                entry, chunk = after[i], chunk + count[i]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], conv_type(b)), *[pa.array([o[j] for o in out], pa.int64()) for j in (1, 2, 3)]], ["_c", "_k", "entry", "chunk"])

    entry_type = StructType([StructField("_c", kind.dataType), *[f for f in StructType.fromDDL("_k long, entry long, chunk long")]])
    entries = steps.repartition("conv_id").sortWithinPartitions("conv_id", "_b").mapInArrow(walked, entry_type)

    def cut(batches):
        now, chunk, n, held = None, 0, 0, 0
        for b in batches:
            out = []
            for conv, k, at_, x, entry, first in zip(*(b.column(c).to_pylist() for c in ("conv_id", "_b", "_n", "bytes", "entry", "chunk")), strict=True):
                if (conv, k) != now:
                    now, chunk = (conv, k), first - 1
                cost = (x or 0) + 1
                if at_ == entry or at_ > entry and (n >= size or held + cost > most):
                    chunk, n, held = chunk + 1, 0, 0
                n, held = n + 1, held + cost
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("conv_id", "position", "bytes")] + [pa.array(out, pa.int32())], ["conv_id", "position", "bytes", "chunk_index"])

    both = own.join(entries, own["conv_id"].eqNullSafe(entries["_c"]) & (own["_b"] == entries["_k"]))
    dealt = both.select("conv_id", "position", "bytes", "_b", "_n", "entry", "chunk").repartition("conv_id", "_b").sortWithinPartitions("conv_id", "_b", "_n")
    return dealt.mapInArrow(cut, StructType([*slim.schema.fields, StructField("chunk_index", IntegerType())]))
