"""Extraction that resumes: answers by chunk in a keyed store, with retries, and failures set aside.

A chunk's key is the revision of its text and of the model, so a changed chunk or model is another one. Each round reads the
store, sets the planned chunks without an answer aside, and commits slice after slice; a run that is stopped loses its running
slice at most. Inside a slice Spark repeats the tasks of lost executors; a batch that the extractor fails on is tried row
by row, so one bad chunk costs no other one its answer.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..sources.store import Published, written
from .retrieval import revision


ANSWERS = "key string, answer string, error string, attempt int"


class Results:
    """The answers of one model (or its stand-in), under ``root``."""

    def __init__(self, spark: SparkSession, root: str, model: str):
        self.spark, self.model, self.at = spark, model, Published(spark, root, "answers")

    def _stored(self) -> DataFrame | None:
        entry = self.at.entry()
        return self.spark.read.schema(ANSWERS).parquet(*[f"{self.at.path}/{s}/answers" for s in entry["segments"]]) if entry else None

    def _keyed(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("conv_id", "chunk_index", "transcript", revision(F.lit(self.model), F.col("conv_id"), F.col("chunk_index"), F.col("transcript")).alias("key"))

    def _last(self) -> DataFrame | None:
        """``key, answer, error, attempts``: for each key its answer, or else the error of its last attempt."""
        stored = self._stored()
        if stored is None:
            return None
        got = F.struct(F.col("error").isNull().alias("ok"), "attempt", "answer", "error")
        each = stored.groupBy("key").agg(F.max(got).alias("x"), F.max("attempt").alias("attempts"))
        return each.select("key", "x.answer", "x.error", "attempts")

    def missing(self, chunks: DataFrame, attempts: int) -> DataFrame:
        """Planned chunks without an answer that have had fewer than ``attempts``: conv_id, chunk_index, transcript, key, tried."""
        plan, last = self._keyed(chunks).dropDuplicates(["key"]), self._last()
        if last is None:
            return plan.withColumn("tried", F.lit(0))
        both = plan.join(last.select("key", "error", "attempts"), "key", "left")
        return both.where(F.col("attempts").isNull() | (F.col("error").isNotNull() & (F.col("attempts") < attempts))).select(*plan.columns, F.coalesce("attempts", F.lit(0)).alias("tried"))

    def run(self, chunks: DataFrame, extractor: Callable[[pd.DataFrame, int], pd.DataFrame], attempts: int = 3, slices: int = 4) -> int:
        """Extract what is missing of ``chunks`` (conv_id, chunk_index, transcript); how many slices were committed.

        ``extractor`` takes a frame of chunks and the number of the attempt, and gives conv_id, chunk_index, answer. A chunk
        that it gives no answer for, or raises on, is tried again in the next round, up to ``attempts`` rounds in all.
        """
        ship(self.spark)
        done = 0
        for _ in range(attempts):
            # Once a round; what a later round finds missing is among what this one has tried.
            chunks = written(self.missing(chunks, attempts).withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices))), "missing", "slice")
            if chunks.isEmpty():
                break
            for k in range(slices):
                entry = self.at.entry() or {"generation": 0, "segments": []}
                folder = self.at.write({"answers": self._answers(chunks.where(F.col("slice") == k), extractor)})
                self.at.commit(folder, self.model, ["answers"], entry["generation"], {"segments": [*entry["segments"], folder]})
                done += 1
        return done

    def _answers(self, todo: DataFrame, extractor) -> DataFrame:
        names = ["conv_id", "chunk_index"]
        same = lambda a, b: a == b or (pd.isna(a) and pd.isna(b))
        told = lambda e: f"{type(e).__name__}: {e}"[:500]

        def alone(row: pd.DataFrame, conv_id, chunk_index, attempt: int) -> tuple[str | None, str | None]:
            try:
                got = extractor(row, attempt)
                for c, k, answer in zip(got["conv_id"], got["chunk_index"], got["answer"], strict=True):
                    if same(c, conv_id) and same(k, chunk_index):
                        return (None, "no answer") if pd.isna(answer) else (answer, None)
                return None, "no answer"
            except Exception as e:
                return None, told(e)

        def one(frame: pd.DataFrame, attempt: int) -> pd.DataFrame:
            try:
                got = extractor(frame[[*names, "transcript"]], attempt)[[*names, "answer"]].drop_duplicates(names)
                out = frame[[*names, "key"]].merge(got, "left", names)
                out["error"] = out["answer"].isna().map({True: "no answer", False: None})
            except Exception as e:
                # Row by row the answers are only listed: a frame is made of them once.
                chunks = frame[[*names, "transcript"]]
                each = [(None, told(e))] if len(frame) == 1 else [alone(chunks.iloc[k : k + 1].copy(), c, i, attempt) for k, (c, i) in enumerate(zip(frame["conv_id"], frame["chunk_index"], strict=True))]
                out = frame[["key"]].assign(answer=[a for a, _ in each], error=[e for _, e in each])
            return out[["key", "answer", "error"]].assign(attempt=attempt)

        def run(frames):
            for frame in frames:
                for tried, some in frame.groupby("tried"):
                    yield one(some, int(tried) + 1)

        return todo.mapInPandas(run, ANSWERS)

    def table(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` with ``answer, error, attempts``: error tells why there is none (``pending``: not tried yet)."""
        plan, last = self._keyed(chunks), self._last()
        if last is None:
            return plan.drop("key").withColumns({"answer": F.lit(None).cast("string"), "error": F.lit("pending"), "attempts": F.lit(0)})
        both = plan.join(last, "key", "left").drop("key")
        return both.withColumn("error", F.when(F.col("attempts").isNull(), "pending").otherwise(F.col("error"))).fillna(0, ["attempts"])
