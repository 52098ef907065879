"""Pseudonyms: patterns in priority order, numbered per conversation and kind by first occurrence.

Everything is a plan: the matches of a text become rows, the first occurrence of each value ranks it within its conversation
and kind, and the texts are put together again from what lay between the matches. So a conversation needs no task of its
own; only its distinct values are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Placeholder names, words that are no alias, and the patterns in order of priority.
LABELS = {"phone": "手机号", "email": "邮箱", "identity": "证件", "card": "银行卡", "url": "链接", "account": "账号", "custom": "自定义"}
RESERVED = ("我", "对方", "me", "other", "unknown")
PATTERNS = {
    "technical": r"(?:[ME]_[0-9a-f]{32}|S_[0-9a-f]{64})(?![0-9a-f])|high\|medium\|low|support\|against\|mixed|local\|repeated\|unclear|chat-evidence-v[12]",
    "url": r"(?:https?://|www\.)[^\s<>\"\[\]，。；！？、]+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z])",
    "identity": r"(?<![0-9A-Za-z])(?:[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[0-9Xx]|[1-9]\d{5}\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3})(?![0-9A-Za-z])",
    "card": r"(?<!\d)(?:\d[ -]?){15,18}\d(?!\d)",
    "account": r"(?i:wxid_[A-Za-z0-9_-]+|(?:QQ|微信号?|WeChat)\s*[:：=]\s*[A-Za-z0-9_-]{5,64})",
    "phone": r"(?<!\d)(?:(?:\+?86[ -]?)?1[3-9]\d[ -]?\d{4}[ -]?\d{4}|0\d{2,3}[ -]?\d{7,8}|\+[1-9](?:[ -]?\d){6,14})(?!\d)",
}
#: Placeholders that are in a text already; they come before all kinds, so doing it twice changes nothing.
PLACED = r"\[(?:" + "|".join(LABELS.values()) + r")\d+\]|\[参与者\]"
#: Noncharacters: one that begins an escape, the border of a match, the border of a group; and how a text's own are written.
MARKS = ("\ufdd2", "\ufdd0", "\ufdd1")
MARKS_AS = ("\ufdd2\ufdd5", "\ufdd2\ufdd3", "\ufdd2\ufdd4")
#: The groups of the one pattern that all texts are matched with.
KINDS = ("placed", *PATTERNS, "known", "custom")


def custom_terms(terms: list[str]) -> list[str]:
    """At most 200 terms of 1 to 500 characters, trimmed, distinct, in order."""
    if len(terms) > 200 or any(not isinstance(t, str) or not t.strip() or len(t) > 500 for t in terms):
        raise ValueError("at most 200 terms of 1 to 500 characters")
    return sorted({t.strip() for t in terms})


def alias_registry(participants: DataFrame) -> DataFrame:
    """``conv_id, value, alias`` from (conv_id, value, role): names of both roles are nobody's in particular."""
    usable = participants.where(F.col("value").isNotNull() & (F.trim("value") != "") & ~F.col("value").isin(*RESERVED))
    each = usable.groupBy("conv_id", "value").agg(F.count_distinct("role").alias("n"), F.min("role").alias("role"))
    return each.select("conv_id", "value", F.when(F.col("n") > 1, "[参与者]").when(F.col("role") == "me", "我").otherwise("对方").alias("alias"))


def _quoted(words: Column) -> Column:
    """A pattern of literal words, longest first; one that never matches for none."""
    order = "array_sort(w, (a, b) -> CASE WHEN char_length(a) <> char_length(b) THEN char_length(b) - char_length(a) WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)"
    literal = F.transform(F.expr(order), lambda x: F.concat(F.lit("\\Q"), F.replace(_escaped(x), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.when(F.size("w") > 0, F.array_join(literal, "|")).otherwise("(?!)")


def patterns(aliases: DataFrame | None, conversations: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """``conv_id, pattern``: every conversation's own alternation, a group for each of ``KINDS``."""
    own = conversations.select("conv_id").distinct()
    if aliases is None:
        own = own.withColumn("w", F.array().cast("array<string>"))
    else:
        of = aliases.groupBy("conv_id").agg(F.collect_set("value").alias("w"))
        of = of.withColumnRenamed("conv_id", "_c")
        own = own.join(of, own["conv_id"].eqNullSafe(of["_c"]), "left").drop("_c").withColumn("w", F.coalesce("w", F.array().cast("array<string>")))
    own = own.withColumn("known", _quoted(F.col("w"))).withColumn("w", F.array(*[F.lit(t) for t in custom_terms(terms or [])]).cast("array<string>"))
    fixed = "|".join(f"({p})" for p in (PLACED, *PATTERNS.values()))
    return own.select("conv_id", F.concat(F.lit(f"(?U){fixed}|("), F.col("known"), F.lit(")|("), _quoted(F.col("w")), F.lit(")")).alias("pattern"))


def _escaped(c: Column) -> Column:
    """Without the two marks: a text that has them keeps them in another form, which no pattern tells from the first."""
    for old, new in zip(MARKS, MARKS_AS, strict=True):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _plain(c: Column) -> Column:
    for old, new in zip(reversed(MARKS), reversed(MARKS_AS), strict=True):
        c = F.replace(c, F.lit(new), F.lit(old))
    return c


def scanned(content: Column, pattern: Column) -> Column:
    """One scan of a text: what lies between matches at even places, the groups of each match at odd ones."""
    _, match, group = MARKS
    put = match + group.join(f"${k}" for k in range(1, len(KINDS) + 1)) + match
    return F.split(F.regexp_replace(_escaped(content), pattern, F.lit(put)), match, -1)


def _found(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, at, kind, value, key`` of every match in ``rows`` (keys, _parts)."""
    odd = F.expr("transform(sequence(0, size(_parts) div 2 - 1), i -> _parts[2 * i + 1])")
    each = rows.where(F.size("_parts") > 1).select(*keys, F.posexplode(odd).alias("at", "m")).withColumn("m", F.split("m", MARKS[2], -1))
    group = lambda k: F.get("m", F.lit(k))
    kind = F.coalesce(*[F.when(group(k) != "", name) for k, name in enumerate(KINDS)])
    each = each.select(*keys, "at", kind.alias("kind"), _plain(F.array_join("m", "")).alias("value"))
    bare = F.regexp_replace("value", "[ -]", "")
    digits = F.regexp_replace(bare, r"(?U)\D", "")
    phone = F.when((F.char_length(digits) == 13) & F.regexp_replace(bare, r"^\++", "").startswith("86"), F.substring(digits, 3, 11)).otherwise(bare)
    return each.withColumn("key", F.when(F.col("kind") == "phone", phone).when(F.col("kind") == "card", bare).otherwise(F.col("value")))


def matches(texts: DataFrame) -> DataFrame:
    """``conv_id, original_index, h, at, kind, value, key`` of every match in ``texts (conv_id, original_index, h, content, pattern)``.

    The kind is the group that took part; ``key`` is the value by which two matches are the same person's or thing's.
    """
    keys = ["conv_id", "original_index", "h"]
    return _found(texts.select(*keys, scanned(F.col("content"), F.col("pattern")).alias("_parts")), keys)


def serials(found: DataFrame) -> DataFrame:
    """``conv_id, kind, key, serial, n``: the kinds with numbers, counted from 1 by first occurrence."""
    numbered = found.where(F.col("kind").isin(*LABELS))
    first = numbered.groupBy("conv_id", "kind", "key").agg(F.min(F.struct("original_index", "at")).alias("first"), F.count("*").alias("n"))
    return first.withColumn("serial", F.row_number().over(Window.partitionBy("conv_id", "kind").orderBy("first"))).select("conv_id", "kind", "key", "serial", "n")


def redact(messages: DataFrame, aliases: DataFrame | None = None, terms: list[str] | None = None) -> DataFrame:
    """``messages`` (conv_id, original_index, content) with redacted content and a map of what was replaced in the row.

    ``aliases``: conv_id, value, alias, see :func:`alias_registry`. Technical ids and placeholders stay, a null content too.
    Rows without conv_id are one conversation, whose aliases are those without conv_id; a null original_index comes first.
    Every row is kept, repeated ones too. Matching does not cross a placeholder that is there already. Each text is scanned
    once; the parts it falls into are a working table.
    """
    own = patterns(aliases, messages, terms).select(F.col("conv_id").alias("_c"), F.col("pattern").alias("_pattern"))
    parts = messages.join(own, messages["conv_id"].eqNullSafe(own["_c"])).withColumn("_parts", scanned(messages["content"], F.col("_pattern")))
    rest = [c for c in messages.columns if c != "content"]
    texts = written(parts.select(*[messages[c] for c in rest], "_parts", F.monotonically_increasing_id().alias("_row")), "scanned")
    found = _found(texts, ["_row", "conv_id", "original_index"])
    numbers = serials(found).select(F.col("conv_id").alias("_c"), F.col("kind").alias("_k"), F.col("key").alias("_v"), "serial")
    same = lambda t: found["conv_id"].eqNullSafe(t["_c"]) & (found["kind"] == t["_k"]) & (found["key"] == t["_v"])
    placed = found.join(numbers, same(numbers), "left").drop("_c", "_k", "_v")
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    put = F.when(F.col("serial").isNotNull(), F.concat(F.lit("["), label[F.col("kind")], F.col("serial").cast("string"), F.lit("]")))
    if aliases is not None:
        named = aliases.groupBy(F.col("conv_id").alias("_c"), F.col("value").alias("_v")).agg(F.min("alias").alias("alias")).withColumn("_k", F.lit("known"))
        placed = placed.join(named, placed["conv_id"].eqNullSafe(named["_c"]) & (placed["kind"] == named["_k"]) & (placed["key"] == named["_v"]), "left")
        put = F.coalesce(put, F.col("alias"))
    of = placed.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", "kind", F.coalesce(put, F.col("value")).alias("put")))).alias("_m"))
    both = texts.join(of, "_row", "left")
    between = "transform(sequence(0, (size(_parts) - 1) div 2), i -> _parts[2 * i])"
    puts = F.transform("_m", lambda m: _escaped(m["put"]))
    joined = F.array_join(F.zip_with(F.expr(between), puts, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    text = _plain(F.when(F.size("_parts") > 1, joined).otherwise(F.get("_parts", F.lit(0))))
    kinds = F.filter(F.transform("_m", lambda m: m["kind"]), lambda k: ~k.isin("technical", "placed"))
    counted = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).alias("n"))))
    replaced = F.when(F.col("_m").isNotNull(), counted).otherwise(F.create_map().cast("map<string,int>"))
    return both.select(*[text.alias(c) if c == "content" else F.col(c) for c in messages.columns], replaced.alias("replaced"))


def replacement_counts(redacted: DataFrame) -> DataFrame:
    return redacted.select("conv_id", F.explode("replaced").alias("kind", "n")).groupBy("conv_id", "kind").agg(F.sum("n").alias("n"))


def masked(text: Column, kinds: tuple[str, ...] = ("url", "email")) -> Column:
    """Without numbers: every match of the given kinds becomes ``[name]``; for text that stands alone."""
    for k in kinds:
        text = F.regexp_replace(text, PATTERNS[k], f"[{LABELS[k]}]")
    return text


#: Fixed value: the revision of these rules, part of a policy's fingerprint.
POLICY, OTHER = "1", "其他消息"


def policy(terms: list[str] | None = None) -> str:
    """The fingerprint of the rules and the custom terms."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps([POLICY, custom_terms(terms or [])], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def snapshot(messages: DataFrame, kinds: tuple[str, ...], aliases: DataFrame | None = None, terms: list[str] | None = None) -> DataFrame:
    """Messages as they may leave: redacted, with neutral types, ids and times.

    ``messages``: conv_id, original_index, type, content, time_str, source_message_id. A type that is not among ``kinds``
    becomes another message's, a time that is none is redacted like text (with the numbers of its conversation), and a source
    id becomes its place.
    """
    from ..functions import times

    rows = written(messages.withColumn("_snap", F.monotonically_increasing_id()), "snapshot")
    bad = times.parse_time(F.col("time_str")).isNull() & F.col("time_str").isNotNull()
    place = lambda k: F.struct("original_index", F.lit(k).alias("part")).alias("original_index")  # noqa: E731  a time comes after its text
    texts = rows.select("conv_id", place(0), "content", "_snap").union(rows.where(bad).select("conv_id", place(1), F.col("time_str").alias("content"), "_snap"))
    done = written(redact(texts, aliases, terms), "redacted")
    body = done.where("original_index.part = 0").select("_snap", "content")
    when = done.where("original_index.part = 1").select("_snap", F.col("content").alias("_time"))
    rows = rows.drop("content").join(body, "_snap").join(when, "_snap", "left")
    return rows.select(
        "conv_id", "original_index", F.when(F.col("type").isin(*kinds), F.col("type")).otherwise(OTHER).alias("type"), "content", F.coalesce("_time", "time_str").alias("time_str"),
        F.when(F.col("source_message_id").isNotNull(), F.concat(F.lit("source:"), (F.col("original_index") + 1).cast("string"))).alias("source_message_id"),
    )


def redact_json(rows: DataFrame, enums: dict[str, tuple[str, ...]], aliases: DataFrame | None = None, terms: list[str] | None = None) -> DataFrame:
    """``rows`` (conv_id, original_index, answer) with every string inside the JSON of ``answer`` redacted.

    Strings are taken out, redacted as rows and put back, so that keys, numbers and structure stay; a field of ``enums`` keeps
    a legal value even if it is somebody's name. An answer that is no JSON is redacted as text.
    """
    parts = rows.select("conv_id", "original_index", "answer", F.call_function("try_parse_json", "answer").isNotNull().alias("is_json"))
    token = r'"(?:[^"\\\\]|\\\\.)*"(?:\\s*:)?'
    found = F.expr(f"CASE WHEN is_json THEN regexp_extract_all(answer, '{token}', 0) ELSE array(answer) END")
    each = parts.select("conv_id", "original_index", "answer", "is_json", F.posexplode_outer(found).alias("at", "s"))
    key = F.col("is_json") & F.col("s").rlike(r":$")
    legal = F.lit(False)
    w = Window.partitionBy("conv_id", "original_index").orderBy("at")
    for name, values in enums.items():
        legal = legal | (F.lag("s").over(w).rlike(rf'^"{name}"\s*:$') & F.col("s").isin(*[f'"{v}"' for v in values]))
    each = each.withColumn("stay", key | F.coalesce(legal, F.lit(False)))
    plain = F.when(F.col("is_json"), F.get(F.from_json(F.concat(F.lit("["), "s", F.lit("]")), "array<string>"), F.lit(0))).otherwise(F.col("s"))
    texts = each.where("not stay").select("conv_id", F.struct("original_index", "at").alias("original_index"), plain.alias("content"))
    done = redact(texts, aliases, terms).select(F.col("conv_id").alias("_c"), F.col("original_index.original_index").alias("_i"), F.col("original_index.at").alias("_a"), F.col("content").alias("_t"))
    again = F.when(F.col("_t").isNull(), "").when(F.col("is_json"), F.regexp_replace(F.regexp_replace(F.to_json(F.array("_t")), r"^\[", ""), r"\]$", "")).otherwise(F.col("_t"))
    same = each["conv_id"].eqNullSafe(done["_c"]) & each["original_index"].eqNullSafe(done["_i"]) & (each["at"] == done["_a"])
    both = each.join(done, same, "left").withColumn("s", F.when(F.col("stay"), F.col("s")).otherwise(again))
    put = both.groupBy("conv_id", "original_index", "answer", "is_json").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("new"))
    between = F.expr(f"CASE WHEN is_json THEN split(answer, '{token}', -1) ELSE array('', '') END")
    joined = F.array_join(F.expr("zip_with(old, new, (a, b) -> concat(a, coalesce(b, '')))"), "")
    return put.withColumn("old", between).select("conv_id", "original_index", joined.alias("answer"))
