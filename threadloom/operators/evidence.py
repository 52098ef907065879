"""Evidence documents from model answers, the ledger made of them, and the summaries that reports are written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import grounding, selection

#: Titles of the categories, items of a category in a summary, chunks of a phase, and what an answer that
#: cannot be read becomes.
TITLES = {"events": "事件证据", "relation_signals": "关系建模证据", "persona_signals": "人物建模证据", "counter_evidence": "反证与边界", "uncertainties": "存疑问题"}
SUMMARY, PHASE = 60, 8
UNREAD = "结构化证据未能从模型输出中可靠解析"
FIELD_NAMES = tuple(dict.fromkeys(f for fields in grounding.FIELDS.values() for f in fields))
_ITEM = "array<struct<" + ", ".join(f"{f}: variant" for f in (*FIELD_NAMES, "time")) + ", source_message_ids: variant>>"


def normalised(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and items of ``answers (conv_id, chunk_index, answer)``.

    Documents: conv_id, chunk_index, parse_status (``ok`` or ``fallback``), evidence_status (``signals``, ``insufficient``,
    null for a fallback). Items: conv_id, chunk_index, category, at and the fields, as text. An answer without a JSON object,
    or whose object breaks the schema, falls back to one uncertainty; a null answer too.
    """
    j = F.call_function("try_parse_json", tx.extract_json(F.col("answer")))
    rows = answers.select("conv_id", "chunk_index", j.alias("j"))
    for c in grounding.FIELDS:
        rows = rows.withColumn(c, F.expr(f"try_variant_get(j, '$.{c}', '{_ITEM}')"))
    text = lambda x: F.call_function("schema_of_variant", x) == "STRING"

    def good(category: str) -> Column:
        def item(x: Column) -> Column:
            out = F.lit(True)
            for f in grounding.FIELDS[category]:
                t = F.call_function("try_variant_get", x[f], F.lit("$"), F.lit("string"))
                ok = x[f].isNotNull() & text(x[f]) & (tx.stripped(t) != "")
                out = out & (ok & t.isin(*grounding.ENUMS[f]) if f in grounding.ENUMS else ok)
            return F.coalesce(out, F.lit(False))

        return F.coalesce(F.forall(F.col(category), item), F.lit(False))

    ok = F.lit(True)
    for c in grounding.FIELDS:
        ok = ok & good(c)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    any_ = F.lit(False)
    for c in grounding.FIELDS:
        any_ = any_ | (F.size(c) > 0)
    documents = rows.select("conv_id", "chunk_index", F.when(F.col("ok"), "ok").otherwise("fallback").alias("parse_status"), F.when(F.col("ok") & any_, "signals").when(F.col("ok"), "insufficient").alias("evidence_status"))
    each = None
    for c in grounding.FIELDS:
        one = rows.where("ok").select("conv_id", "chunk_index", F.lit(c).alias("category"), F.posexplode(c).alias("at", "x"))
        one = one.select("conv_id", "chunk_index", "category", "at", *[(F.call_function("try_variant_get", F.col("x")[f], F.lit("$"), F.lit("string")) if f in grounding.FIELDS[c] else F.lit(None).cast("string")).alias(f) for f in FIELD_NAMES])
        each = one if each is None else each.union(one)
    said = {"question": F.lit(UNREAD), "reason": F.lit("缺少合法 JSON 证据块")}
    lost = rows.where("not ok").select("conv_id", "chunk_index", F.lit("uncertainties").alias("category"), F.lit(0).alias("at"), *[said.get(f, F.lit(None).cast("string")).alias(f) for f in FIELD_NAMES])
    return documents, each.union(lost)


def identified(items: DataFrame, source_id: str) -> DataFrame:
    """Grounded items with ``evidence_id``, once for each id in a chunk.

    The id is ``E_`` and 32 digits over the source, the category, the fields and the grounding, so equal items of a chunk are
    one, and a changed binding is another id. Uncertainties are no evidence and have nothing to ground.
    """
    body = F.to_json(F.struct(F.lit(source_id).alias("source"), "category", *FIELD_NAMES, "status", "source_refs"), {"ignoreNullFields": "false"})
    rows = items.withColumn("evidence_id", F.concat(F.lit("E_"), F.substring(F.sha2(body, 256), 1, 32)))
    first = F.row_number().over(Window.partitionBy("conv_id", "chunk_index", "category", "evidence_id").orderBy("at"))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first")


def tampered(items: DataFrame, grounded_again: DataFrame, source_id: str) -> DataFrame:
    """Items (conv_id, chunk_index, category, at, evidence_id) whose id is not what grounding the same fields again gives."""
    again = identified(grounded_again, source_id).select("conv_id", "chunk_index", "category", "evidence_id").withColumn("_same", F.lit(True))
    keys = ["conv_id", "chunk_index", "category", "evidence_id"]
    return items.join(again, keys, "left").where("_same is null").select("conv_id", "chunk_index", "category", "at", "evidence_id")


def store_counts(items: DataFrame) -> DataFrame:
    """Per conversation: distinct pieces of evidence, their occurrences, and how many distinct ones are quarantined."""
    bad = F.col("status").isin("unmatched", "ambiguous")
    return items.groupBy("conv_id").agg(F.count_distinct("evidence_id").alias("evidence"), F.count("*").alias("occurrences"), F.count_distinct(F.when(bad, F.col("evidence_id"))).alias("quarantined"))


def _qualified(items: DataFrame) -> DataFrame:
    """``grounded``: bound to a source; ``usable``: that, and of the persona only what the other one said."""
    grounded = F.col("status").isin("matched", "not_applicable")
    own = (F.col("category") != "persona_signals") | F.coalesce(F.col("sender") == "other", F.lit(False))
    return items.withColumn("grounded", grounded).withColumn("usable", grounded & own)


def recurrence(items: DataFrame) -> DataFrame:
    """``conv_id, category, label, n_chunks, n_days`` of models and traits, over matched items (``day`` may be null)."""
    label = F.when(F.col("category") == "relation_signals", F.coalesce(F.nullif(tx.stripped("model"), F.lit("")), F.lit("未标注模型"))).when(F.col("category") == "persona_signals", F.coalesce(F.nullif(tx.stripped("trait"), F.lit("")), F.lit("未标注维度")))
    rows = _qualified(items).where("usable and status = 'matched'").withColumn("label", label).where("label is not null")
    return rows.groupBy("conv_id", "category", "label").agg(F.count_distinct("chunk_index").alias("n_chunks"), F.count_distinct("day").alias("n_days"))


def summary_counts(items: DataFrame, limit: int = SUMMARY) -> DataFrame:
    """Per conversation and category: items in all, bound, usable, and chosen for a summary of at most ``limit``."""
    q = _qualified(items)
    chosen = grounding.balanced(_deep(q), limit, "category").groupBy("conv_id", "category").agg(F.count("*").alias("chosen"))
    counts = q.groupBy("conv_id", "category").agg(F.count("*").alias("total"), F.count_if("grounded").alias("grounded"), F.count_if("usable").alias("usable"))
    return counts.join(chosen, ["conv_id", "category"], "left").fillna(0, ["chosen"])


def _deep(q: DataFrame) -> DataFrame:
    depth = F.row_number().over(Window.partitionBy("conv_id", "category", "chunk_index").orderBy("at", "evidence_id")) - 1
    return q.where("usable").withColumn("depth", depth)


def described() -> Column:
    """What an item says, in a line."""
    c = lambda f: tx.compact(F.col(f))
    return (
        F.when(F.col("category") == "relation_signals", F.concat(F.coalesce("model", F.lit("未标注模型")), F.lit(" / "), F.coalesce("direction", F.lit("mixed")), F.lit(": "), c("signal")))
        .when(F.col("category") == "persona_signals", F.concat(F.coalesce("trait", F.lit("未标注维度")), F.lit(": "), c("signal")))
        .when(F.col("category") == "counter_evidence", F.concat(F.lit("反驳 "), F.coalesce("against", F.lit("未标注判断")), F.lit(": "), c("evidence")))
        .when(F.col("category") == "uncertainties", F.concat(c("question"), F.lit("；原因："), c("reason"))).otherwise(c("summary"))
    )


def summary(items: DataFrame, limit: int = SUMMARY) -> DataFrame:
    """``conv_id, category, title, body``: a section of the evidence summary, a line for each chosen item, in chunk order.

    ``items`` also hold sender and time of the bound source (null without one) and the chunk's time_range.
    """
    chosen = grounding.balanced(_deep(_qualified(items)), limit, "category")
    who = F.when(F.col("sender") == "me", "我").when(F.col("sender") == "other", "对方").otherwise("发言者未核验")
    quote = tx.compact(F.col("evidence"))
    line = F.concat(
        F.lit("- "), "evidence_id", F.when(quote != "", F.concat(F.lit(" / "), who)).otherwise(""), F.lit(" / "), F.coalesce("time", "time_range"), F.lit(": "), described(),
        F.when(quote != "", F.concat(F.lit("；证据："), quote)).otherwise(""), F.when(F.coalesce("confidence", F.lit("")) != "", F.concat(F.lit("；可信度："), "confidence")).otherwise(""),
    )
    rows = chosen.withColumn("line", line).groupBy("conv_id", "category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "depth", "line"))), lambda x: x["line"]), "\n").alias("body"))
    title = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])[F.col("category")]
    return summary_counts(items, limit).join(rows, ["conv_id", "category"], "left").select("conv_id", "category", title.alias("title"), F.coalesce("body", F.lit("- 暂无结构化条目。")).alias("body"))


def phases(items: DataFrame, size: int = PHASE) -> DataFrame:
    """``conv_id, phase, category, n_items, first_chunk, last_chunk``: batches of ``size`` chunks and what was bound in them."""
    rows = _qualified(items).where("usable").withColumn("phase", F.floor((F.col("chunk_index") - 1) / size) + 1)
    return rows.groupBy("conv_id", "phase", "category").agg(F.count("*").alias("n_items"), F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk"))


def phase_measures(texts: DataFrame) -> DataFrame:
    """What can be seen of summaries ``texts (conv_id, name, body)``: bytes, ids, dates, and whether parts are there."""
    found = lambda p: F.size(F.array_distinct(F.regexp_extract_all("body", F.lit(p), F.lit(0))))
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("body", w))
    return texts.select(
        "conv_id", "name", F.octet_length("body").alias("bytes"), found(r"\bE_[0-9a-f]{32}\b").alias("n_ids"), found(r"\b\d{4}-\d{2}-\d{2}\b").alias("n_dates"),
        (has("【我】", " / 我 / ") & has("【对方】", " / 对方 / ")).alias("has_speakers"), has("反证").alias("has_counter"), has("验证的问题", "存疑").alias("has_open"),
    )


def extracted(chunks: DataFrame, extractor) -> DataFrame:
    """``conv_id, chunk_index, answer``: what a model (or its stand-in) says of each chunk's transcript.

    ``extractor`` takes and gives pandas frames, a batch at a time, in the Python workers: conv_id, chunk_index, transcript
    in, conv_id, chunk_index, answer out.
    """
    rows = chunks.select("conv_id", "chunk_index", "transcript")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(lambda frames: (extractor(f) for f in frames), f"conv_id {kinds['conv_id']}, chunk_index {kinds['chunk_index']}, answer string")


def artefact_audit(documents: DataFrame, items: DataFrame, manifest: DataFrame) -> DataFrame:
    """``conv_id, violation``: counts of a run's artefacts that do not agree with each other.

    A document for each planned chunk and no other, items only of documents that were read, and an open question from each
    that could not be.
    """
    keys = ["conv_id", "chunk_index"]
    d, m = documents.groupBy(*keys).agg(F.count("*").alias("n"), F.min("parse_status").alias("parse_status")), manifest.select(*keys).distinct().withColumn("planned", F.lit(True))
    i = items.groupBy(*keys).agg(F.count("*").alias("items"), F.count_if(F.col("category") == "uncertainties").alias("open"))
    both = m.join(d, keys, "full").join(i, keys, "full")
    rules = [
        F.when(F.col("planned").isNull() & F.col("n").isNotNull(), "extra_document"), F.when(F.col("n").isNull() & F.col("planned"), "missing_document"), F.when(F.col("n") > 1, "repeated_document"),
        F.when(F.col("items").isNotNull() & F.col("n").isNull(), "stray_items"), F.when((F.col("parse_status") == "fallback") & ((F.coalesce("open", F.lit(0)) != 1) | (F.col("items") != 1)), "fallback_items"),
    ]
    return both.select(*keys, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("violation"))


def budgeted_summary(sections: dict[str, list[str]], notes: dict[str, list[str]], budget: int, first: tuple[str, ...] = ()) -> str:
    """An evidence summary within a budget of bytes: whole items, taken in turn from the sections, ``first`` ids before others.

    ``notes``: a section's lines on counts, which always stay. If not even those fit, one line says so.
    """
    top = ["## 结构化证据摘要", "[按完整条目选择；存在省略，不能把省略当作不存在。]"]
    said = lambda t, n: f"- 选择 {n}/{len(sections[t])} 条。"
    size = lambda x: len(x.encode()) + 1
    fixed = sum(map(size, top)) + sum(size(said(t, len(rows))) + sum(map(size, notes.get(t, ()))) for t, rows in sections.items()) - 1
    if fixed + sum(map(size, sections)) > budget:
        return tx.limited("[预算不足以展示材料结构；本部分全部省略。]", max(0, budget))
    packed = selection.pack_sections(sections, budget - fixed, first)
    return "\n".join([*top, *(x for t, rows in packed.items() for x in (t, *notes.get(t, ()), said(t, len(rows)), *rows))])
