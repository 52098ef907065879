"""Structured Streaming forms of the same roll-ups (an extension: the batch operators define the semantics).

Messages arrive as (conv_id, time, sender); rows later than the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from ..functions.ship import ship
from ..operators import usage
from ..operators.sessions import GAP
from ..sources.store import Published


def sessions(stream: DataFrame, late: str = "1 hour", gap: int = GAP) -> DataFrame:
    """Sessions by event time; a gap of exactly ``gap`` seconds still belongs."""
    w = F.session_window("time", f"{gap} seconds")
    return stream.withWatermark("time", late).groupBy("conv_id", w).agg(F.count("*").alias("message_count"), F.count_if(F.col("sender") == "me").alias("me_count"), F.max("time").alias("last_time")).select("conv_id", F.col("session_window.start").alias("first_time"), "last_time", "message_count", "me_count")


def daily(stream: DataFrame, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("time", late).groupBy("conv_id", F.window("time", "1 day")).agg(F.count("*").alias("total")).select("conv_id", F.col("window.start").alias("day"), "total")


def tumbling(stream: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Messages by conversation, sender and window of ``length``."""
    w = F.window("time", length)
    return stream.withWatermark("time", late).groupBy("conv_id", "sender", w).agg(F.count("*").alias("total")).select("conv_id", "sender", F.col("window.start").alias("start"), "total")


def out_of_order(stream: DataFrame) -> DataFrame:
    """``conv_id, time, sender, late``: whether a later message of its conversation has come before it."""
    def step(key, batches, state):
        newest = state.get[0] if state.exists else None
        out = []
        for pdf in batches:
            for s, t in pdf[["sender", "time"]].itertuples(index=False):
                out.append((key[0], t, s, newest is not None and t < newest))
                newest = t if newest is None else max(newest, t)
        state.update((newest,))
        yield pd.DataFrame(out, columns=["conv_id", "time", "sender", "late"])

    return stream.groupBy("conv_id").applyInPandasWithState(step, "conv_id string, time timestamp, sender string, late boolean", "newest timestamp", "append", "NoTimeout")


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """The running roll-up by stage of an append-only usage log (JSON lines); for output mode ``complete``."""
    schema = "session_id string, time string, stage string, model string, usage struct<prompt_tokens: string, completion_tokens: string, total_tokens: string, prompt_cache_hit_tokens: string, prompt_cache_miss_tokens: string, reasoning_tokens: string>"
    return usage.normalised(spark.readStream.schema(schema).json(path)).groupBy("stage").agg(*usage.measures())


class _Ordered(StatefulProcessor):
    """Speaker turns in event order: rows wait until the watermark has passed them, and a timer wakes the earliest."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, seq long, sender string")
        self.turn = handle.getValueState("turn", "sender string, n int, first long, last long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802  names of the interface
        for frame in rows:
            ms = frame["time"].astype("datetime64[ms]").astype("int64")
            new = list(zip(ms.tolist(), frame["seq"].astype("int64").tolist(), frame["sender"].tolist(), strict=True))
            if new:
                self.waiting.appendList(new)
                self.handle.registerTimer(min(r[0] for r in new))
        yield _turn_frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        sender, n, first, last = self.turn.get() if self.turn.exists() else (None, 0, None, None)
        out = []
        for ms, _, who in ready:
            if n and who != sender:
                out.append((sender, n, first, last))
                n = 0
            sender, n, first, last = who, n + 1, ms if not n else first, ms
        if n and not rest and now >= last + self.idle:  # nobody has gone on: the turn ends, and nothing is kept
            out.append((sender, n, first, last))
            n = 0
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.waiting.clear()
        if n:
            self.turn.update((sender, n, first, last))
            if not rest:
                self.handle.registerTimer(last + self.idle)
        else:
            self.turn.clear()
        yield _turn_frame(key, out)

    def close(self) -> None:
        pass


def _turn_frame(key, turns_: list) -> pd.DataFrame:
    when = lambda k: pd.to_datetime(pd.Series([t[k] for t in turns_], dtype="int64"), unit="ms").astype("datetime64[us]")
    return pd.DataFrame({"conv_id": pd.Series([key[0]] * len(turns_), dtype="object"), "sender": pd.Series([t[0] for t in turns_], dtype="object"), "n_messages": pd.Series([t[1] for t in turns_], dtype="int32"), "first_time": when(2), "last_time": when(3)})


def ordered_turns(stream: DataFrame, late: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """Speaker turns of ``stream`` (conv_id, time, seq, sender) as the batch operator gives them, whatever order rows come in.

    Rows wait as state until the watermark (``late`` behind the newest time) has passed them and are then taken by (time,
    seq); rows later than that are dropped by the engine. A turn is given out when another sender goes on, or when the
    watermark is ``idle`` past it; then the conversation has no state left, and whatever comes later opens a new turn. Needs
    the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    ship(stream.sparkSession)
    schema = f"conv_id {stream.schema['conv_id'].dataType.simpleString()}, sender string, n_messages int, first_time timestamp, last_time timestamp"
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return stream.withWatermark("time", late).groupBy("conv_id").transformWithStateInPandas(_Ordered(ms), schema, "Append", "EventTime")


class Progress(StreamingQueryListener):
    """Keeps the last events of queries: (event, query's name or id, batch, input rows)."""

    def __init__(self, most: int = 1000):
        self.events: deque = deque(maxlen=most)

    def onQueryStarted(self, event):  # noqa: N802  names of the interface
        self.events.append(("started", event.name or str(event.id), None, None))

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.events.append(("progress", p.name or str(p.id), p.batchId, p.numInputRows))

    def onQueryIdle(self, event):  # noqa: N802
        self.events.append(("idle", str(event.id), None, None))

    def onQueryTerminated(self, event):  # noqa: N802
        self.events.append(("failed" if event.exception else "ended", str(event.id), None, None))


class Sink:
    """For ``foreachBatch``: appends each batch to a published table exactly once.

    A batch is written as a segment and counts only by the pointer's move, which also says how far the stream has come. A
    batch that is played again after a stop, or twice, finds its number passed and does nothing; one that was written but
    not committed is written anew, and what it left is swept. One stream writes to one name.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.at = Published(spark, root, name)

    def __call__(self, batch: DataFrame, batch_id: int) -> bool:
        """Whether the batch was new."""
        entry = self.at.entry() or {"generation": 0, "segments": [], "batch": -1}
        if batch_id <= entry["batch"]:
            return False
        folder = self.at.write({"rows": batch})
        self.at.commit(folder, f"batch {batch_id}", ["rows"], entry["generation"], {"segments": [*entry["segments"], folder], "batch": batch_id})
        return True

    def table(self) -> DataFrame:
        entry = self.at.entry()
        if entry is None:
            raise FileNotFoundError(f"no batch has come to {self.at.path}")
        return self.at.spark.read.parquet(*[f"{self.at.path}/{s}/rows" for s in entry["segments"]])

    def compact(self) -> None:
        """All segments as one; the place in the stream stays."""
        entry = self.at.entry()
        folder = self.at.write({"rows": self.table()})
        self.at.commit(folder, "compacted", ["rows"], entry["generation"], {"segments": [folder], "batch": entry["batch"]})


def turns(stream: DataFrame) -> DataFrame:
    """Finished speaker turns, with the running one kept as state per conversation."""
    def step(key, batches, state):
        sender, n, first, last = state.get if state.exists else (None, 0, None, None)
        out = []
        for pdf in batches:
            for s, t in pdf.sort_values("time")[["sender", "time"]].itertuples(index=False):
                if sender is not None and s != sender:
                    out.append((key[0], sender, n, first, last))
                    n, first = 0, None
                sender, n, first, last = s, n + 1, first if first is not None else t, t
        state.update((sender, n, first, last))
        yield pd.DataFrame(out, columns=["conv_id", "sender", "n_messages", "first_time", "last_time"])

    return stream.groupBy("conv_id").applyInPandasWithState(step, "conv_id string, sender string, n_messages int, first_time timestamp, last_time timestamp", "sender string, n int, first_time timestamp, last_time timestamp", "append", "NoTimeout")
