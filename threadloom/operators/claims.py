"""Rule checks over claims with cited evidence: references, coverage, scope, actions, time links, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Fixed values: (dates, sessions, days) that a scope needs.
REPEATED, LONG_TERM = (2, 2, 0), (3, 3, 30)
#: What the enumerated fields of a claim may be, and its prose.
ENUMS = {"kind": ("fact", "inference", "hypothesis", "uncertain"), "scope": ("local", "repeated", "long_term"), "confidence": ("high", "medium", "low"), "subject": ("peer", "interaction", "user"), "counter_review": ("found", "not_found_in_selected", "not_assessed")}
PROSE = ("text", "context_review", "uncertainty")


def coverage(refs: DataFrame) -> DataFrame:
    """Per claim, from its supporting references (claim_id, position, day, session): what they span."""
    return refs.groupBy("claim_id").agg(F.count_distinct("position").alias("n_positions"), F.count_distinct("day").alias("n_days"), F.count_distinct("session").alias("n_sessions"), F.datediff(F.max("day"), F.min("day")).alias("span_days"))


def meets(need: tuple[int, int, int]) -> Column:
    return (F.col("n_days") >= need[0]) & (F.col("n_sessions") >= need[1]) & (F.coalesce("span_days", F.lit(0)) >= need[2])


def widest_scope() -> Column:
    return F.when(meets(LONG_TERM), "long_term").when(meets(REPEATED), "repeated").otherwise("local")


def scope_violations(claims: DataFrame, covered: DataFrame) -> DataFrame:
    """Claims whose scope their support does not carry; those without any support too."""
    both = claims.join(covered, "claim_id", "left")
    bad = F.when(F.col("n_positions").isNull(), "no_support").when((F.col("scope") == "repeated") & ~meets(REPEATED), "repeated").when((F.col("scope") == "long_term") & ~meets(LONG_TERM), "long_term").when((F.col("kind") == "uncertain") & ((F.col("confidence") != "low") | (F.col("scope") != "local")), "uncertain")
    return both.select("claim_id", bad.alias("violation")).where("violation is not null")


def reference_violations(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """References (claim_id, role, evidence_id) that are unknown, quarantined, or cited in several roles of one claim."""
    known = refs.join(evidence.select("evidence_id", "status").distinct(), "evidence_id", "left")
    roles = F.size(F.collect_set("role").over(Window.partitionBy("claim_id", "evidence_id")))
    bad = F.when(F.col("status").isNull(), "unknown").when(F.col("status").isin("unmatched", "ambiguous"), "quarantined").when(roles > 1, "several_roles")
    return known.withColumn("violation", bad).where("violation is not null").select("claim_id", "evidence_id", "violation").distinct()


def source_facts(refs: DataFrame, evidence: DataFrame, messages: DataFrame) -> DataFrame:
    return refs.join(evidence, "evidence_id").join(messages.select("message_id", "position", "sender", "time"), "message_id").select("claim_id", "evidence_id", "message_id", "position", "sender", "time", "quote")


def action_violations(actions: DataFrame, facts: DataFrame) -> DataFrame:
    """Actions whose quote is not in the cited text, whose actor or target is not in the quote, or whose confirmation does
    not come later and from the other sender."""
    f = facts.select("claim_id", "evidence_id", F.col("quote").alias("_text"), F.col("sender").alias("_s"), F.col("position").alias("_p"))
    c = facts.select("claim_id", F.col("evidence_id").alias("confirmation_id"), F.col("quote").alias("_ctext"), F.col("sender").alias("_cs"), F.col("position").alias("_cp"))
    both = actions.join(f, ["claim_id", "evidence_id"], "left").join(c, ["claim_id", "confirmation_id"], "left")
    inside = lambda a, b: F.coalesce(F.contains(F.col(b), F.col(a)), F.lit(False))
    bad = (
        F.when(~inside("quote", "_text"), "quote").when(~inside("actor", "quote"), "actor").when(F.col("target").isNotNull() & ~inside("target", "quote"), "target")
        .when(F.col("confirmation_id").isNotNull() & (~inside("confirmation_quote", "_ctext") | (F.col("_cs") == F.col("_s")) | (F.col("_cp") <= F.col("_p"))), "confirmation")
    )
    return both.withColumn("violation", bad).where("violation is not null").select("claim_id", "evidence_id", "violation")


def time_links(pairs: DataFrame, messages: DataFrame) -> DataFrame:
    """``days, seconds`` between two cited messages; null if a time is unknown; ``forward``: the second stands later."""
    from ..functions import times

    m = messages.select("conv_id", "position", "time")
    both = pairs.join(m.withColumnsRenamed({"position": "from_position", "time": "_a"}), ["conv_id", "from_position"]).join(m.withColumnsRenamed({"position": "to_position", "time": "_b"}), ["conv_id", "to_position"])
    return both.select("conv_id", "from_position", "to_position", F.datediff("_b", "_a").alias("days"), (times.seconds(F.col("_b")) - times.seconds(F.col("_a"))).alias("seconds"), (F.col("to_position") > F.col("from_position")).alias("forward"))


def time_link_violations(links: DataFrame, facts: DataFrame) -> DataFrame:
    """``claim_id, from_id, to_id, violation``: links to what the claim does not cite, not forward, or between the same
    two messages again. ``facts``: claim_id, evidence_id, message_id, position, time."""
    own = facts.select("claim_id", "evidence_id", "message_id", "position", "time")
    a = own.withColumnsRenamed({"evidence_id": "from_id", "message_id": "_fm", "position": "_fp", "time": "_ft"})
    b = own.withColumnsRenamed({"evidence_id": "to_id", "message_id": "_tm", "position": "_tp", "time": "_tt"})
    both = links.join(a, ["claim_id", "from_id"], "left").join(b, ["claim_id", "to_id"], "left")
    again = F.row_number().over(Window.partitionBy("claim_id", "_fm", "_tm").orderBy("from_id", "to_id")) > 1
    both = both.withColumn("_again", again)
    bad = F.when(F.col("_fm").isNull() | F.col("_tm").isNull(), "unknown").when((F.col("_fp") >= F.col("_tp")) | F.coalesce(F.col("_tt") < F.col("_ft"), F.lit(False)), "order").when(F.col("_again"), "repeated")
    return both.select("claim_id", "from_id", "to_id", bad.alias("violation")).where("violation is not null")


def basis_violations(basis: DataFrame, statements: DataFrame, sources: DataFrame, registered: DataFrame) -> DataFrame:
    """``claim_id, field, source_id, violation``: what a review's basis (claim_id, field, statement, source_id, quote, usage)
    gets wrong: a statement that the field does not hold, a source nobody sees, a quote that is not the source's, or an
    assertion whose quote is no registered citation of the claim.

    ``statements``: claim_id, field, text; ``sources``: source_id, message_id, text; ``registered``: claim_id, message_id, quote.
    """
    both = basis.join(statements.withColumnRenamed("text", "_field"), ["claim_id", "field"], "left").join(sources.withColumnsRenamed({"message_id": "_m", "text": "_source"}), "source_id", "left")
    cited = registered.groupBy("claim_id", F.col("message_id").alias("_m")).agg(F.collect_set("quote").alias("_cited"))
    both = both.join(cited, ["claim_id", "_m"], "left")
    inside = lambda part, whole: F.coalesce((tx.stripped(F.col(part)) != "") & F.contains(F.col(whole), F.col(part)), F.lit(False))
    usage = F.coalesce("usage", F.lit("assertion"))
    held = F.coalesce(F.exists("_cited", lambda q: F.contains(q, F.col("quote"))), F.lit(False))
    bad = (
        F.when(~inside("statement", "_field"), "statement").when(F.col("_source").isNull(), "source").when(~usage.isin("assertion", "context"), "usage")
        .when(~inside("quote", "_source"), "quote").when((usage == "assertion") & ~held, "unregistered")
    )
    return both.select("claim_id", "field", "source_id", bad.alias("violation")).where("violation is not null")


def source_violations(facts: DataFrame, targets: DataFrame, visible: DataFrame) -> DataFrame:
    """``position, violation`` of readings (position, participants, event, uncertainty, bindings) of the ``targets (position)``.

    Each target is read once; participants are known and distinct, or unknown alone with a doubt and no binding; every one
    of them is bound to a quote of a visible position (``visible``: position, text).
    """
    cover = exact_cover(targets, facts, "position")
    people = F.coalesce("participants", F.array().cast("array<string>"))
    unsure = F.array_contains(people, "unknown")
    legal = (F.size(people) > 0) & (F.size(F.array_distinct(people)) == F.size(people)) & F.forall(people, lambda x: x.isin("me", "peer", "third_party", "unknown"))
    shape = F.when(~legal, "participants").when(F.coalesce(tx.stripped(F.col("event")) == "", F.lit(True)), "event").when(unsure & ((F.size(people) > 1) | (F.size("bindings") > 0) | F.coalesce(tx.stripped(F.col("uncertainty")) == "", F.lit(True))), "unknown")
    rows = facts.select("position", shape.alias("violation"), people.alias("people"), unsure.alias("unsure"), "bindings")
    text = visible.select(F.col("position").alias("_p"), F.col("text").alias("_t"))
    bound = rows.where("violation is null and not unsure").select("position", "people", F.explode_outer("bindings").alias("b")).join(text, F.col("b.position") == F.col("_p"), "left")
    good = F.coalesce(F.array_contains("people", F.col("b.participant")) & (tx.stripped(F.col("b.quote")) != "") & F.contains("_t", F.col("b.quote")), F.lit(False))
    each = bound.groupBy("position", "people").agg(F.bool_and(good).alias("ok"), F.collect_set("b.participant").alias("who"))
    binding = each.select("position", F.when(~F.col("ok") | (F.size(F.array_except("people", "who")) > 0), "binding").alias("violation"))
    return cover.union(rows.select("position", "violation")).union(binding).where("violation is not null").distinct()


def unresolved(claims: DataFrame, cited: DataFrame, facts: DataFrame) -> DataFrame:
    """``claim_id, positions``: claims that are not uncertain but cite (claim_id, position) what nobody can be named for."""
    open_ = facts.where(F.col("participants") == F.array(F.lit("unknown"))).select("position").distinct()
    hit = cited.join(open_, "position", "left_semi").groupBy("claim_id").agg(F.array_sort(F.collect_set("position")).alias("positions"))
    return claims.where("kind <> 'uncertain'").select("claim_id").join(hit, "claim_id")


def exact_cover(expected: DataFrame, given: DataFrame, *keys: str) -> DataFrame:
    """Keys that are missing, extra or repeated in ``given``."""
    e, g = expected.groupBy(*keys).agg(F.count("*").alias("want")), given.groupBy(*keys).agg(F.count("*").alias("got"))
    both = e.join(g, list(keys), "full")
    return both.withColumn("violation", F.when(F.col("want").isNull(), "extra").when(F.col("got").isNull(), "missing").when(F.col("got") > 1, "repeated")).where("violation is not null").select(*keys, "violation")


def verdicts(reviews: DataFrame) -> DataFrame:
    """A claim passes its review if every flag of every field does."""
    return reviews.groupBy("claim_id").agg(F.bool_and("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed_fields"))


def revised(claims: DataFrame, revisions: DataFrame) -> DataFrame:
    """Whole rows replaced for the claims that were revised; a revision of anything else raises when its row is read."""
    new = revisions.join(claims.select(F.col("claim_id").alias("_known")).distinct(), F.col("claim_id") == F.col("_known"), "left")
    stop = F.raise_error(F.concat(F.lit("no such claim: "), F.col("claim_id").cast("string")))
    new = new.withColumn("claim_id", F.when(F.col("_known").isNotNull(), F.col("claim_id")).otherwise(stop.cast(revisions.schema["claim_id"].dataType)))
    return claims.join(revisions.select("claim_id"), "claim_id", "left_anti").unionByName(new.select(*claims.columns))


def shape_violations(claims: DataFrame, sections: int) -> DataFrame:
    """``claim_id, field``: enumerations, sections and prose that break a claim's shape."""
    rules = [F.when(F.coalesce(~F.col(f).isin(*values), F.lit(True)), f) for f, values in ENUMS.items()]
    rules += [F.when(tx.unfit_prose(F.col(f)), f) for f in PROSE]
    rules.append(F.when(F.coalesce(~F.col("section").between(1, sections), F.lit(True)), "section"))
    return claims.select("claim_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("field"))


def gate_violations(claims: DataFrame, refs: DataFrame, context: DataFrame) -> DataFrame:
    """``claim_id, violation``: rules between a claim's fields and its references (claim_id, role, evidence_id, sender).

    ``context``: the evidence ids that have their whole context. An inference, or a claim beyond its place, may cite only
    those; what is said of the peer needs the peer's own words, and the counter-evidence must agree with its review.
    """
    known = refs.join(context.select("evidence_id").distinct().withColumn("_in", F.lit(True)), "evidence_id", "left")
    of = known.groupBy("claim_id").agg(
        F.count_if(F.col("role") == "support").alias("support"), F.count_if(F.col("role") == "counter").alias("counter"),
        F.count_if(F.col("_in").isNull()).alias("outside"), F.count_if((F.col("role") == "support") & (F.col("sender") == "other")).alias("peer"),
    )
    both = claims.join(of, "claim_id", "left").fillna(0, ["support", "counter", "outside", "peer"])
    unsure = F.col("kind") == "uncertain"
    rules = [
        F.when(~unsure & (F.col("support") == 0), "no_support"), F.when(unsure & ((F.col("confidence") != "low") | (F.col("scope") != "local")), "uncertain"),
        F.when(((F.col("counter") > 0) != (F.col("counter_review") == "found")) | (~unsure & (F.col("counter_review") == "not_assessed")), "counter_review"),
        F.when(~unsure & ((F.col("kind") != "fact") | (F.col("scope") != "local")) & (F.col("outside") > 0), "context"),
        F.when((F.col("subject") == "peer") & ~unsure & (F.col("peer") == 0), "peer_words"),
    ]
    return both.select("claim_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("violation"))


def alias_map(messages: DataFrame, refs: DataFrame) -> DataFrame:
    """References (claim_id, ref) with ``id``: ``P_n`` stands for the message at position n; any other stays what it is."""
    known = messages.select(F.concat(F.lit("P_"), F.col("position").cast("string")).alias("ref"), F.col("message_id").alias("_id"))
    return refs.join(known, "ref", "left").select("claim_id", "ref", F.coalesce("_id", "ref").alias("id"))


def identified(claims: DataFrame, source_id: str, report: str, body: tuple[str, ...]) -> DataFrame:
    """Claims with ``claim_key`` (``C_`` and 32 digits over source, report and body) and whether it is a ``duplicate``.

    Of equal claims the one with the smallest claim_id is no duplicate.
    """
    text = F.to_json(F.struct(F.lit(source_id).alias("source"), F.lit(report).alias("report"), *body), {"ignoreNullFields": "false"})
    keyed = claims.withColumn("claim_key", F.concat(F.lit("C_"), F.substring(F.sha2(text, 256), 1, 32)))
    return keyed.withColumn("duplicate", F.row_number().over(Window.partitionBy("claim_key").orderBy("claim_id")) > 1)


def allowed(covered: DataFrame, refs: DataFrame) -> DataFrame:
    """``claim_id, scopes, subjects``: what a claim with this support may say at most."""
    scopes = F.filter(F.array(F.lit("local"), F.when(meets(REPEATED), "repeated"), F.when(meets(LONG_TERM), "long_term")), lambda x: x.isNotNull())
    peer = refs.groupBy("claim_id").agg(F.bool_or(F.col("sender") == "other").alias("_peer"))
    subjects = F.when(F.col("_peer"), F.array(F.lit("user"), F.lit("interaction"), F.lit("peer"))).otherwise(F.array(F.lit("user"), F.lit("interaction")))
    return covered.join(peer, "claim_id", "left").select("claim_id", scopes.alias("scopes"), subjects.alias("subjects"))


def rendered(claims: DataFrame) -> DataFrame:
    """``section, body``: a report's sections, facts first, then by number; a line a claim."""
    line = F.concat(F.lit("- "), tx.markdown_escaped(F.col("text")), F.lit(" ["), F.col("claim_key"), F.lit("]"))
    order = F.struct((F.col("kind") != "fact").alias("k"), "claim_id", line.alias("line"))
    return claims.groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["line"]), "\n").alias("body"))


def report_audit(claims: DataFrame, report: DataFrame) -> DataFrame:
    """``section, violation``: sections of a report (section, body) that are not what rendering the claims again gives."""
    again = rendered(claims).withColumnRenamed("body", "_body")
    both = again.join(report, "section", "full")
    bad = F.when(F.col("_body").isNull(), "extra").when(F.col("body").isNull(), "missing").when(F.col("body") != F.col("_body"), "changed")
    return both.select("section", bad.alias("violation")).where("violation is not null")


def repeated_texts(messages: DataFrame) -> DataFrame:
    """How often a text message's exact text occurs, in all and from its sender."""
    text = messages.where(F.col("content").isNotNull() & (F.col("content") != ""))
    return text.withColumn("same_text", F.count("*").over(Window.partitionBy("conv_id", "content"))).withColumn("same_sender", F.count("*").over(Window.partitionBy("conv_id", "content", "sender")))


def citation_numbers(text_rows: DataFrame, pattern: str = tx.REFERENCE) -> DataFrame:
    """``report, ref, number``: references numbered by first occurrence in a report; those in fences and comments don't count."""
    body = F.regexp_replace(F.regexp_replace("body", r"(?s)<!--.*?-->", ""), r"(?ms)^\s*(```+|~~~+).*?(^\s*\1[^\n]*$|\z)", "")
    found = text_rows.select("report", F.posexplode(F.regexp_extract_all(body, F.lit(f"(?U){pattern}"), F.lit(0))).alias("at", "ref"))
    first = found.groupBy("report", "ref").agg(F.min("at").alias("at"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("report").orderBy("at"))).select("report", "ref", "number")
