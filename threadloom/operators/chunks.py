"""Contiguous chunks under two budgets, their manifest and checks.

The packing is sequential within a conversation: rows are dealt by conversation, sorted, and streamed through one pass that
holds a few counters, so a long conversation costs time in its task but no memory.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Messages, transcript bytes and prompt bytes of a chunk; floors and factor of the shrink schedule.
SIZE, BYTES, PROMPT, FLOORS, FACTOR = 1200, 18_000, 32_000, (1, 12_000, 18_000), 0.55


def chunked(rows: DataFrame, size: int = SIZE, most: int = BYTES) -> DataFrame:
    """``rows`` (conv_id, position, bytes) with ``chunk_index`` from 1: a row that would exceed either budget opens a chunk.

    A row counts its bytes and one for its line end. One that alone exceeds the budget is a chunk of its own.
    """
    slim = rows.select("conv_id", "position", F.col("bytes").cast("long").alias("bytes"))

    def run(batches):
        conv, chunk, n, held = object(), 0, 0, 0
        for b in batches:
            out = []
            for c, x in zip(b.column("conv_id").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                if c != conv:
                    conv, chunk, n, held = c, 1, 0, 0
                if n and (n >= size or held + x + 1 > most):
                    chunk, n, held = chunk + 1, 0, 0
                n, held = n + 1, held + x + 1
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], [*b.schema.names, "chunk_index"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(run, f"{types}, chunk_index int")


def manifest(chunks: DataFrame) -> DataFrame:
    """One row per chunk; transcript bytes without the last line's end."""
    return chunks.groupBy("conv_id", "chunk_index").agg(F.min("position").alias("start_message"), F.max("position").alias("end_message"), F.count("*").alias("message_count"), (F.sum(F.col("bytes") + 1) - 1).alias("transcript_bytes"))


def coverage(found: DataFrame, messages: DataFrame) -> DataFrame:
    """Per conversation: whether the chunks tile all its messages."""
    w = Window.partitionBy("conv_id").orderBy("chunk_index")
    joined = F.coalesce(F.lag("end_message").over(w) + 1, F.lit(1)) == F.col("start_message")
    each = found.withColumn("ok", joined & (F.col("end_message") - F.col("start_message") + 1 == F.col("message_count")))
    got = each.groupBy("conv_id").agg(F.count("*").alias("n_chunks"), F.sum("message_count").alias("covered"), F.bool_and("ok").alias("tiles"))
    all_ = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    return all_.join(got, "conv_id", "left").select("conv_id", "n_messages", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce(F.col("tiles") & (F.col("covered") == F.col("n_messages")), F.lit(False)).alias("complete"))


def split_to_budget(costs: list[int], head: int, most: int) -> list[tuple[int, int]]:
    """Ranges of rows, halved until head plus the rows' costs fit or a single row is left."""
    out, todo = [], [(0, len(costs))]
    while todo:
        a, z = todo.pop()
        if z - a <= 1 or head + sum(costs[a:z]) <= most:
            if z > a:
                out.append((a, z))
            continue
        mid = (a + z) // 2
        todo += [(mid, z), (a, mid)]
    return out


def prompt_split(chunks: DataFrame, head: int, most: int = PROMPT) -> DataFrame:
    """Chunks split further by prompt bytes; ``chunk_index`` stays and ``part`` counts from 1. A chunk is small by budget."""
    def run(key, pdf):
        pdf = pdf.sort_values("position")
        pdf["part"] = 0
        for k, (a, z) in enumerate(split_to_budget(pdf["bytes"].tolist(), head, most), 1):
            pdf.iloc[a:z, pdf.columns.get_loc("part")] = k
        return pdf

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.groupBy("conv_id", "chunk_index").applyInPandas(run, f"{types}, part int")


def shrink(size: int, most: int, prompt: int) -> tuple[int, int, int] | None:
    """The next, smaller budgets after a failure; null when nothing can shrink any more."""
    now = (size, most, prompt)
    then = tuple(max(floor, min(x - 1, int(x * FACTOR))) if x > floor else x for x, floor in zip(now, FLOORS, strict=True))
    return None if then[1:] == now[1:] and now[1] <= FLOORS[1] and now[2] <= FLOORS[2] else then


def missing(planned: DataFrame, cached: DataFrame) -> DataFrame:
    """Planned chunks without a valid cached result."""
    return planned.join(cached, [c for c in planned.columns if c in cached.columns], "left_anti")


def batches_by_bytes(rows: DataFrame, most: int) -> DataFrame:
    """Greedy batches of summaries under a prompt budget: the same recurrence without a count limit."""
    return chunked(rows, size=2**31 - 1, most=most)


def in_chunks(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (conv_id, position) with the ``chunk_index`` of the chunk (conv_id, chunk_index, start_message, end_message)
    that holds them, null outside all of them. One sort by position serves both sides, so there is no range join."""
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("conv_id", "position")]
    marks = found.select("conv_id", F.col("start_message").cast(rows.schema["position"].dataType).alias("position"), *none, F.struct(F.col("chunk_index").alias("k"), F.col("end_message").alias("z")).alias("_chunk"), F.lit(0).alias("_side"))
    both = marks.select(*rows.columns, "_chunk", "_side").unionByName(rows.withColumn("_chunk", F.lit(None).cast(marks.schema["_chunk"].dataType)).withColumn("_side", F.lit(1)))
    last = F.last("_chunk", True).over(Window.partitionBy("conv_id").orderBy("position", "_side").rowsBetween(Window.unboundedPreceding, 0))
    held = both.withColumn("_in", last).where("_side = 1")
    return held.withColumn("chunk_index", F.when(F.col("position") <= F.col("_in.z"), F.col("_in.k"))).drop("_chunk", "_side", "_in")
