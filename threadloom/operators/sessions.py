"""Order-dependent operators: speaker turns, sessions by gaps, windows around anchors and units of them.

All are windows per conversation over ``conv_id, position, sender, time`` (and ``epoch`` where said), as gaps and islands.
The definitions of a session differ on purpose and are separate functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times

#: The session gap and the two reply windows, in seconds; steps of a context window.
GAP, REPLY, SESSION_REPLY, RADIUS = 4 * 3600, (5, 7200), (5, 14400), 16


def _by(*keys: str):
    return Window.partitionBy("conv_id", *keys).orderBy("position")


def _running(flag: Column, *keys: str) -> Column:
    return F.sum(flag.cast("int")).over(_by(*keys).rowsBetween(Window.unboundedPreceding, 0))


def turns(messages: DataFrame, *keys: str) -> DataFrame:
    """``turn``: 1, 2, ... for runs of one sender, within ``keys`` too if given."""
    before = F.lag("sender").over(_by(*keys))
    return messages.withColumn("turn", _running(before.isNull() | (before != F.col("sender")), *keys))


def speaker_turns(messages: DataFrame) -> DataFrame:
    return turns(messages).groupBy("conv_id", "turn").agg(F.first("sender").alias("sender"), F.count("*").alias("n_messages"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))


def gap_sessions(messages: DataFrame, gap: int = GAP) -> DataFrame:
    """Statistics sessions: a new one when a valid time is more than ``gap`` after the last valid one.

    Rows without a time stay in the running session and don't move its clock; gaps that go back never split.
    """
    s = times.seconds(F.col("time"))
    last = F.last("_s", True).over(_by().rowsBetween(Window.unboundedPreceding, -1))
    rows = messages.withColumn("_s", s)
    return rows.withColumn("session", F.lit(1) + _running(F.coalesce(F.col("_s") - last > gap, F.lit(False)))).drop("_s")


def segment_sessions(messages: DataFrame, gap: int = GAP) -> DataFrame:
    """Sessions for representative segments: rows before the first valid time take no part."""
    seen = F.max(F.col("time").isNotNull()).over(_by())
    return gap_sessions(messages.withColumn("_seen", seen).where("_seen").drop("_seen"), gap)


def context_sessions(messages: DataFrame, gap: int = GAP, use_epoch: bool = True) -> DataFrame:
    """Context sessions: neighbours more than ``gap`` apart in either direction, or of unknown time, are separated.

    The epoch counts before the local time, unless ``use_epoch`` is off (the sessions that coverage counts).
    """
    local = times.epoch_utc8(F.col("time")).cast("double")
    rows = messages.withColumn("_c", F.coalesce(F.col("epoch"), local) if use_epoch else local)
    before = F.lag("_c").over(_by())
    split = before.isNull() | F.col("_c").isNull() | (F.abs(F.col("_c") - before) > gap)
    return rows.withColumn("session", _running(split)).drop("_c")


def reply_deltas(messages: DataFrame, *keys: str) -> DataFrame:
    """``delta``: seconds since the row before, where the sender changes and both times are valid."""
    d = times.seconds(F.col("time")) - F.lag(times.seconds(F.col("time"))).over(_by(*keys))
    return messages.withColumn("delta", F.when(F.lag("sender").over(_by(*keys)) != F.col("sender"), d))


def session_summary(messages: DataFrame, gap: int = GAP) -> DataFrame:
    """One row per session: size, counts by sender, initiator, closer, duration in minutes, replies inside the session."""
    lo, hi = SESSION_REPLY
    rows = reply_deltas(gap_sessions(messages, gap), "session")
    reply = F.when((F.col("delta") > lo) & (F.col("delta") < hi), F.col("delta"))
    s = times.seconds(F.col("time"))
    return rows.withColumn("_s", s).withColumn("_r", reply).groupBy("conv_id", "session").agg(
        F.count("*").alias("message_count"), F.count_if(F.col("sender") == "me").alias("me_count"), F.count_if(F.col("sender") == "other").alias("other_count"),
        F.min_by("sender", "position").alias("initiator"), F.max_by("sender", "position").alias("closer"), F.min("position").alias("first_position"), F.max("position").alias("last_position"),
        times.round1(F.greatest(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("position"))) - F.min_by("_s", F.when(F.col("_s").isNotNull(), F.col("position"))), F.lit(0)) / 60.0).alias("duration_minutes"),
        F.count("_r").alias("reply_count"), times.round1(F.avg("_r")).alias("reply_avg"),
    )


def anchor_windows(messages: DataFrame, anchors: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``conv_id, position, left, right``: the context window of each anchor.

    It reaches ``radius`` rows to each side and on to the end of the turn met there, inside the context session. Bounds
    are columns of the messages, so no row is visited twice; ``anchors`` holds conv_id and position.
    """
    rows = turns(context_sessions(messages), "session")
    whole = Window.partitionBy("conv_id", "session")
    turn = Window.partitionBy("conv_id", "session", "turn")
    inside = _by("session")
    rows = rows.withColumn("_a", F.min("position").over(whole)).withColumn("_z", F.max("position").over(whole))
    rows = rows.withColumn("_ta", F.min("position").over(turn)).withColumn("_tz", F.max("position").over(turn))
    left = F.coalesce(F.lag("_ta", radius).over(inside), F.col("_a"))
    right = F.coalesce(F.lead("_tz", radius).over(inside), F.col("_z"))
    return rows.withColumn("left", left).withColumn("right", right).join(anchors.select("conv_id", "position").distinct(), ["conv_id", "position"], "left_semi").select("conv_id", "position", "session", "left", "right")


def candidate_units(windows: DataFrame) -> DataFrame:
    """Anchors whose windows touch inside a session, merged: ``unit, n_anchors, first_anchor, left, right``."""
    w = Window.partitionBy("conv_id", "session").orderBy("left", "position").rowsBetween(Window.unboundedPreceding, -1)
    edge = F.max("right").over(w)
    rows = windows.withColumn("new", (edge.isNull() | (F.col("left") > edge + 1)).cast("int"))
    unit = F.sum("new").over(Window.partitionBy("conv_id").orderBy("session", "left", "position").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("unit", unit).groupBy("conv_id", "unit").agg(F.count("*").alias("n_anchors"), F.min("position").alias("first_anchor"), F.min("left").alias("left"), F.max("right").alias("right"))


def unit_metrics(units: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds sender changes and seconds across each unit's rows (a range join per conversation)."""
    rows = messages.withColumn("_change", F.coalesce(F.lag("sender").over(_by()) != F.col("sender"), F.lit(False)))
    both = units.join(rows.select("conv_id", "position", "_change", times.seconds(F.col("time")).alias("_s")), "conv_id").where("position between left and right")
    got = both.groupBy("conv_id", "unit").agg(F.count_if(F.col("_change") & (F.col("position") > F.col("left"))).alias("turn_changes"), (F.max("_s") - F.min("_s")).alias("seconds"), F.count("*").alias("n_rows"))
    return units.join(got, ["conv_id", "unit"])


def contiguous_ranges(positions: DataFrame) -> DataFrame:
    """Runs of adjacent positions inside a session: ``conv_id, session, start, end``."""
    rn = F.row_number().over(Window.partitionBy("conv_id", "session").orderBy("position"))
    return positions.withColumn("_g", F.col("position") - rn).groupBy("conv_id", "session", "_g").agg(F.min("position").alias("start"), F.max("position").alias("end")).drop("_g")


def unit_labels(units: DataFrame, anchors: DataFrame) -> DataFrame:
    """``conv_id, unit, categories, directions, contrast``: the labels of each unit's anchors (conv_id, position, category, direction).

    There is contrast where something is said for and something against: support, mixed or an event on one side, against,
    mixed or counter-evidence on the other. An anchor belongs to the unit that its position lies in.
    """
    a = anchors.select("conv_id", F.col("position").alias("_p"), "category", "direction")
    both = units.select("conv_id", "unit", "left", "right").join(a, "conv_id").where(F.col("_p").between(F.col("left"), F.col("right")))
    got = both.groupBy("conv_id", "unit").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("direction")).alias("directions"))
    any_ = lambda c, *names: F.exists(c, lambda x: x.isin(*names))
    against = any_("directions", "against", "mixed") | any_("categories", "counter_evidence")
    for_ = any_("directions", "support", "mixed") | any_("categories", "events")
    return got.withColumn("contrast", for_ & against)
