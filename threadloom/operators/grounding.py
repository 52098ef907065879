"""Literal grounding of quotes in the messages of their chunk, roles of evidence, and the ledger's checks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as tx
from ..functions.ship import ship
from ..sources.store import written

#: References kept when a quote is ambiguous; categories, their required fields and enumerations.
CANDIDATES = 20
FIELDS = {
    "events": ("summary", "evidence", "confidence"),
    "relation_signals": ("model", "direction", "signal", "evidence", "confidence"),
    "persona_signals": ("trait", "signal", "evidence", "stability", "confidence"),
    "counter_evidence": ("against", "evidence", "confidence"),
    "uncertainties": ("question", "reason"),
}
ENUMS = {"confidence": ("high", "medium", "low"), "direction": ("support", "against", "mixed"), "stability": ("local", "repeated", "unclear")}
#: Characters of a window that can be an anchor, one in how many is, and into how many blocks a chunk's messages fall.
GRAM, EVERY, BLOCKS = 12, 32, 64
STATUSES = ("matched", "unmatched", "ambiguous", "not_applicable")


def anchors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, anchor long``: hashes of those of a text's ``GRAM``-character windows that fall on a mark, each once; no text.

    Whether a window falls on a mark depends on its characters alone, so whatever contains a quote has all of its anchors.
    About one window in ``EVERY`` is one; a text without any, all short ones among them, gives no row.
    """
    ship(rows.sparkSession)
    power = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(GRAM)], np.uint64)

    def of(t: str | None) -> np.ndarray:
        c = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if len(c) < GRAM:
            return np.zeros(0, np.int64)
        h = sum((c[k : len(c) - GRAM + 1 + k] + np.uint64(1)) * power[k] for k in range(GRAM))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(h[h % np.uint64(EVERY) == 0]).view(np.int64)

    def run(batches):
        for b in batches:
            found = [of(t.as_py()) for t in b.column(text)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            hashes = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in keys], pa.array(hashes, pa.int64())], [*keys, "anchor"])

    kept = rows.select(*keys, text)
    return kept.mapInArrow(run, StructType([*[kept.schema[k] for k in keys], StructField("anchor", LongType())]))


def _equal(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Names are equal, or null on both sides."""
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def candidates(quotes: DataFrame, messages: DataFrame, on: list[str]) -> DataFrame:
    """``on, quote_id, position, message_id``: pairs of quotes and messages of one chunk that may match, each once.

    They share the quote's rarest anchor, and the chunk holds all anchors of the quote. Anchors are posted with the keys of
    their messages only, so nothing that is dealt out or sent has a text for each anchor. An anchor that many messages
    hold is met block by block (``BLOCKS`` of a chunk's messages), and a quote without an anchor meets its whole chunk so.
    """
    key = [*on, "position", "message_id"]
    block = F.expr(f"pmod(xxhash64(position, message_id), {BLOCKS})").alias("block")
    wanted = written(anchors(quotes, [*on, "quote_id"], "quote").distinct(), "wanted")
    named = wanted.select(*on, "anchor").distinct()
    posted = anchors(messages, key, "content")
    posted = written(posted.join(named, _equal(posted, named, [*on, "anchor"]), "left_semi").select("*", block), "posted")
    counts = posted.groupBy(*on, "anchor", "block").agg(F.count("*").alias("n")).groupBy(*on, "anchor").agg(F.sum("n").alias("n"), F.collect_set("block").alias("blocks"))
    each = wanted.join(counts.withColumnsRenamed({c: f"_{c}" for c in [*on, "anchor"]}), reduce(lambda x, y: x & y, [wanted[c].eqNullSafe(F.col(f"_{c}")) for c in [*on, "anchor"]]), "left")
    # An anchor that no message holds: the quote cannot occur, since a message that contains it has all of its anchors.
    rarest = each.groupBy(*on, "quote_id").agg(F.min(F.when(F.col("n").isNotNull(), F.struct("n", "anchor", "blocks"))).alias("r"), F.bool_and(F.col("n").isNotNull()).alias("held")).where("held")
    rarest = rarest.select(*on, "quote_id", F.col("r.anchor").alias("anchor"), F.explode("r.blocks").alias("block"))
    both = [*on, "anchor", "block"]
    by_anchor = rarest.join(posted, _equal(rarest, posted, both)).select(*[rarest[c] for c in on], "quote_id", "position", "message_id")
    bare = quotes.select(*on, "quote_id").distinct()
    having = wanted.select(*on, "quote_id").distinct()
    bare = bare.join(having, _equal(bare, having, [*on, "quote_id"]), "left_anti")
    listed = messages.select(*key, block)
    there = listed.select(*on, "block").distinct()
    bare = bare.join(there, _equal(bare, there, on)).select(*[bare[c] for c in on], "quote_id", "block")
    short = bare.join(listed, _equal(bare, listed, [*on, "block"])).select(*[bare[c] for c in on], "quote_id", "position", "message_id")
    return by_anchor.union(short).distinct()


def ground(quotes: DataFrame, messages: DataFrame, keys: tuple[str, ...] = ("conv_id", "chunk_index")) -> DataFrame:
    """Adds ``status, candidate_count, source_refs`` to quotes (``keys``, quote_id, quote, optional hint).

    messages: keys, message_id, position, content, type-filtered to what may be quoted. A quote without text is not
    applicable. Occurrences may overlap; one is a match, several are ambiguous (the first CANDIDATES references are kept).
    A quote meets only messages of its own chunk, and of those only the ones that :func:`candidates` finds; then each
    text is read once. A null key is a chunk of its own, and one quote_id may stand in several chunks; rows that agree in
    keys, quote_id and quote (and hint) are answered alike. A message row that repeats counts once.
    """
    on, hinted = list(keys), ["hint"] if "hint" in quotes.columns else []
    named = [*on, "quote_id"]
    q = quotes.where("quote is not null and quote <> ''").select(*named, "quote", *hinted).distinct()
    m = messages.select(*on, "message_id", "position", "content").where("content is not null").distinct()
    one = F.struct("quote_id", F.sha2("quote", 256).alias("of"))  # an id may have several quotes
    pairs = candidates(q.select(*on, one.alias("quote_id"), "quote"), m, on)
    own = q.withColumn("_one", one).withColumnsRenamed({c: f"_{c}" for c in on})
    asked = pairs.withColumnRenamed("quote_id", "_q").join(own, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], F.col("_q") == F.col("_one")))
    if hinted:
        asked = asked.where("hint is null or hint = message_id")
    asked = asked.select(*named, "quote", *hinted, "position", "message_id")
    at = [*on, "position", "message_id"]
    texts = m.withColumnsRenamed({c: f"_{c}" for c in at})
    both = asked.join(texts, reduce(lambda x, y: x & y, [asked[c].eqNullSafe(F.col(f"_{c}")) for c in at])).where(F.contains("content", "quote"))
    row = [*named, "quote", *hinted]
    hits = both.select(*row, "position", "message_id", F.explode(F.expr(tx.offsets("content", "quote"))).alias("start"))
    whole = hits.withColumn("r", F.row_number().over(Window.partitionBy(*row).orderBy("position", "start", "message_id"))).where(F.col("r") <= CANDIDATES)
    end = F.col("start") + F.char_length("quote")
    refs = whole.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("position", "start", end.alias("end"), "message_id"))).alias("source_refs"))
    counts = hits.groupBy(*row).agg(F.count("*").alias("candidate_count"))
    found = counts.join(refs, _equal(counts, refs, row)).select(*[counts[c].alias(f"_{c}") for c in row], "candidate_count", "source_refs")
    status = F.when(F.col("quote").isNull() | (F.col("quote") == ""), "not_applicable").when(F.col("candidate_count") == 1, "matched").when(F.col("candidate_count") > 1, "ambiguous").otherwise("unmatched")
    out = quotes.join(found, reduce(lambda x, y: x & y, [quotes[c].eqNullSafe(F.col(f"_{c}")) for c in row]), "left").select(*quotes.columns, "candidate_count", "source_refs")
    return out.fillna(0, ["candidate_count"]).withColumn("status", status)


def status_counts(grounded: DataFrame, *by: str) -> DataFrame:
    return grounded.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def role(category: str = "category", direction: str = "direction", status: str = "status") -> Column:
    return (
        F.when(F.col(status).isin("unmatched", "ambiguous"), "quarantine").when(F.col(category) == "uncertainties", "uncertainty")
        .when((F.col(category) == "counter_evidence") | (F.col(direction) == "against"), "counter").when(F.col(direction) == "mixed", "mixed").otherwise("support")
    )


def violations(evidence: DataFrame) -> DataFrame:
    """Rows of an evidence table that break its schema, with the field: ``chunk_index, category, field``."""
    rules = []
    for category, fields in FIELDS.items():
        for f in fields:
            bad = F.coalesce(F.trim(F.col(f)), F.lit("")) == ""
            if f in ENUMS:
                bad = bad | ~F.col(f).isin(*ENUMS[f])
            rules.append(F.when((F.col("category") == category) & bad, f))
    rules.append(F.when(~F.col("category").isin(*FIELDS) | F.col("category").isNull(), "category"))
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return evidence.select("*", F.explode(found).alias("field"))


def aliases(quotes: DataFrame, messages: DataFrame) -> DataFrame:
    """``mN`` in ``hint`` becomes the id of the chunk's N-th message; anything else stays."""
    n = F.row_number().over(Window.partitionBy("conv_id", "chunk_index").orderBy("position"))
    known = messages.select("conv_id", "chunk_index", F.concat(F.lit("m"), n).alias("hint"), F.col("message_id").alias("_id"))
    return quotes.join(known, ["conv_id", "chunk_index", "hint"], "left").withColumn("hint", F.coalesce("_id", "hint")).drop("_id")


def issues(grounded: DataFrame) -> DataFrame:
    return grounded.where(F.col("status").isin("unmatched", "ambiguous"))


def ledger_audit(chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """Per conversation: positions run 1..n without holes, ids are unique, chunks tile all of them."""
    m = messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("position").alias("a"), F.max("position").alias("z"), F.count_distinct("position").alias("d"), F.count_distinct("message_id").alias("ids"))
    w = Window.partitionBy("conv_id").orderBy("chunk_index")
    c = chunks.withColumn("ok", F.coalesce(F.lag("end_message").over(w) + 1, F.lit(1)) == F.col("start_message")).groupBy("conv_id").agg(F.bool_and("ok").alias("tiles"), F.max("end_message").alias("last"))
    return m.join(c, "conv_id", "left").select("conv_id", ((F.col("a") == 1) & (F.col("z") == F.col("n")) & (F.col("d") == F.col("n"))).alias("positions_ok"), (F.col("ids") == F.col("n")).alias("ids_ok"), F.coalesce(F.col("tiles") & (F.col("last") == F.col("n")), F.lit(False)).alias("chunks_ok"))


def balanced(items: DataFrame, limit: int, *by: str) -> DataFrame:
    """Items (conv_id, chunk_index, depth from 0) chosen by depth round-robin, for each conversation (and ``by``).

    More chunks than ``limit``: evenly spaced ones (the last for a limit of 1). In the level that does not fit whole, the
    chosen are evenly spaced too (the middle one if one place is left).
    """
    keys = ["conv_id", *by]
    w = Window.partitionBy(*keys)
    chunk = F.dense_rank().over(w.orderBy("chunk_index")) - 1
    rows = items.withColumn("g", chunk).withColumn("groups", F.max("g").over(w) + 1)
    if limit == 1:
        rows = rows.where("g = groups - 1")
    else:
        rows = rows.where((F.col("groups") <= limit) | F.array_contains(F.expr(f"transform(sequence(0, {limit - 1}), i -> cast(bround(i * (groups - 1) / {limit - 1}) as int))"), F.col("g")))
    level = Window.partitionBy(*keys, "depth")
    rows = rows.withColumn("at_", F.row_number().over(level.orderBy("chunk_index")) - 1).withColumn("of_", F.count("*").over(level))
    sizes = rows.groupBy(*keys, "depth").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.select(*keys, "depth", (F.lit(limit) - before).alias("left_")), [*keys, "depth"]).where("left_ > 0")
    some = F.expr("CASE WHEN of_ <= left_ THEN true WHEN left_ = 1 THEN at_ = (of_ - 1) div 2 ELSE array_contains(transform(sequence(0, cast(left_ - 1 as int)), i -> cast(bround(i * (of_ - 1) / (left_ - 1)) as int)), at_) END")
    return rows.where(some).drop("g", "groups", "at_", "of_", "left_")


def evenly_spaced(rows: DataFrame, k: int, order: str) -> DataFrame:
    """k rows per conv_id at even ranks, halves rounded to even; the middle one for k = 1."""
    w = Window.partitionBy("conv_id")
    rows = rows.withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    if k == 1:
        return rows.where("_r = (_n - 1) div 2").drop("_r", "_n")
    pick = F.expr(f"transform(sequence(0, {k - 1}), i -> cast(bround(i * (_n - 1) / {k - 1}) as int))")
    return rows.where((F.col("_n") <= k) | F.array_contains(pick, F.col("_r"))).drop("_r", "_n")
