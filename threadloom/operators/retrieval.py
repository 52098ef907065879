"""Text search over evidence, look-back to sources, references by prefix, and proposition retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.store import written

#: The ranking's k1 and b, and the floor of its inverse document frequency.
K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Bounds of a query and of its limit.
QUERY, LIMIT = (1, 200), (1, 50)
#: Fixed value: queries of a plan.
PLAN = 8 * 8 * 2


def check_query(query: str, limit: int) -> list[str]:
    """The terms of a valid query; operators are ordinary text."""
    if not (QUERY[0] <= len(query.strip()) <= QUERY[1] and LIMIT[0] <= limit <= LIMIT[1]):
        raise ValueError("a query has 1 to 200 characters and a limit of 1 to 50")
    return query.split()


def postings(docs: DataFrame, id_col: str = "evidence_id", text_col: str = "search_text") -> DataFrame:
    """``trigram, doc, tf``: an index that narrows a large store before the exact test; a null or shorter text has no entry."""
    # One pass over a text: each match takes a code point and looks at the two after it.
    grams = F.regexp_extract_all(F.lower(text_col), F.lit("(?s)(?=(...))."), F.lit(1))
    return docs.select(F.col(id_col).alias("doc"), F.explode(grams).alias("trigram")).groupBy("trigram", "doc").agg(F.count("*").alias("tf"))


def search(docs: DataFrame, query: str, limit: int, id_col: str = "evidence_id", text_col: str = "search_text", role_col: str | None = "role") -> DataFrame:
    """All terms must occur; best ``limit`` of each role by BM25 over trigrams, ties by id. ``rank`` is null in literal mode.

    A term below 3 characters switches the whole query to literal search by ASCII-lower-cased text, in id order.
    Frequencies are over all rows, whatever their role.
    """
    terms = check_query(query, limit)
    role = F.col(role_col) if role_col else F.lit("all")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), role.alias("role"))
    if any(len(t) < 3 for t in terms):
        for t in terms:
            rows = rows.where(F.contains(tx.ascii_lower(F.col("t")), tx.ascii_lower(F.lit(t))))
        order, hits = [F.col("id")], rows.withColumn("score", F.lit(None).cast("double"))
    else:
        hits = bm25(rows.withColumn("l", F.lower("t")), terms)
        order = [F.col("score"), F.col("id")]
    top = hits.withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy(*order))).where(F.col("rank") <= limit)
    return top.select("role", "rank", F.col("id").alias(id_col), "score")


def bm25(rows: DataFrame, terms: list[str], index: DataFrame | None = None) -> DataFrame:
    """Rows (id, l, role) that hold all terms, with ``score``: the negative sum of weights, so less is better.

    ``index``: :func:`postings` of the same ids and texts. Then only rows with all trigrams of some term are read in full; the
    others count with their lengths, as every row does.
    """
    sized = rows.withColumn("len", F.greatest(F.lit(0), F.char_length("l") - 2))
    each = sized
    if index is not None:
        grams = [sorted({t.lower()[i : i + 3] for i in range(len(t) - 2)}) for t in terms]
        found = index.where(F.col("trigram").isin(sorted({g for of in grams for g in of}))).groupBy("doc").agg(F.collect_set("trigram").alias("g"))
        whole = F.lit(False)
        for of in grams:
            whole = whole | (F.size(F.array_intersect("g", F.array(*[F.lit(g) for g in of]))) == len(of))
        each = sized.join(found.where(whole).select(F.col("doc").alias("id")), "id", "left_semi")
    for k, t in enumerate(terms):
        each = each.withColumn(f"w{k}", F.lit(t.lower())).withColumn(f"tf{k}", F.expr(tx.overlapping("l", f"w{k}")))
    each = each.where(" or ".join(f"tf{k} > 0" for k in range(len(terms)))).select("id", "role", "len", *[f"tf{k}" for k in range(len(terms))])
    each = written(each, "bm25-terms")  # numbers only; read for the totals and for the hits, so texts and index are gone through once
    holds = each.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(len(terms))])
    stats = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).crossJoin(holds)  # one row of totals each
    hits = each.where(" and ".join(f"tf{k} > 0" for k in range(len(terms)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for k in range(len(terms)):
        raw = F.log((F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        weight = F.when(raw <= 0, FLOOR).otherwise(raw)
        score = score - weight * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + K1 * ((1 - B) + B * F.col("len") / F.col("avg_len")))
    return hits.select("id", "role", score.alias("score"))


def search_text(evidence: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``evidence_id, role, search_text``: fields, ids and every place in chunk order."""
    place = F.concat_ws(" ", F.format_string("chunk_%03d", "chunk_index"), F.col("start_message").cast("string"), F.col("end_message").cast("string"))
    places = occurrences.groupBy("evidence_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", place.alias("p")))), lambda x: x["p"]), " ").alias("places"))
    return evidence.join(places, "evidence_id", "left").select("evidence_id", "role", F.concat_ws(" ", "body", "evidence_id", "category", "role", "places").alias("search_text"))


def look_back(hits: DataFrame, occurrences: DataFrame, messages: DataFrame) -> DataFrame:
    """Hits with their occurrences (in chunk order) and the text of their source messages."""
    refs = occurrences.join(messages.select("message_id", "content", "position"), "message_id", "left")
    of = refs.groupBy("evidence_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "position", "message_id", "content"))).alias("sources"))
    return hits.join(of, "evidence_id", "left")


def resolve(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ref, status, id``: prefixes that fit one id are resolved, several ambiguous, none missing."""
    want = refs.distinct()
    lengths = want.agg(F.array_sort(F.collect_set(F.char_length("ref"))).alias("lengths"))  # one row; no more than the longest reference has characters
    each = ids.select("id").distinct().crossJoin(F.broadcast(lengths))
    # Every id under its own prefixes of those lengths: an equal prefix is a hit, so no pair is made that is none.
    heads = each.select("id", F.explode(F.filter("lengths", lambda n: n <= F.char_length("id"))).alias("n")).select(F.expr("substring(id, 1, n)").alias("ref"), "id")
    held = heads.groupBy("ref").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    each = want.join(held, "ref", "left").select("ref", F.coalesce("n", F.lit(0)).alias("n"), "one")
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return each.select("ref", status.alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("id"))


def proposition_hits(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """``question, direction, query, conv_id, position``: rows whose text or description holds the query, case aside.

    ``queries`` are those of one plan, at most 8 questions by 8 queries by 2 directions, which is what is broadcast; more
    raise. A null text or description holds nothing.
    """
    if queries.limit(PLAN + 1).count() > PLAN:
        raise ValueError(f"a plan has at most {PLAN} queries")
    names = [c for c in ("content", "description") if c in rows.columns]
    text = F.array(*[tx.casefold(F.coalesce(F.col(c), F.lit(""))) for c in names])
    return rows.withColumn("_t", text).join(F.broadcast(queries), F.exists("_t", lambda t: F.contains(t, tx.casefold(tx.stripped(F.col("query")))))).select("question", "direction", "query", "conv_id", "position").distinct()


def query_weights(queries: DataFrame, hits: DataFrame, total: int) -> DataFrame:
    n = hits.groupBy("question", "direction", "query").agg(F.count_distinct("conv_id", "position").alias("hits"))
    each = queries.join(n, ["question", "direction", "query"], "left").fillna(0, ["hits"])
    return each.withColumn("weight", tx.idf(F.lit(total), F.col("hits")))


def merged_hit_sets(hits: DataFrame) -> DataFrame:
    """Queries of one question with equal hit sets are one: ``question, hit_key, queries``."""
    each = hits.select("question", "query", F.xxhash64("conv_id", "position").alias("h")).groupBy("question", "query").agg(F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    return each.groupBy("question", "x", "s", "n").agg(F.sort_array(F.collect_set("query")).alias("queries")).select("question", "n", "queries")


def citable_hits(hits: DataFrame, sessions: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``question, direction, query, citable``: hits in sessions (conv_id, position, session, type) that hold something quotable."""
    quotable = sessions.where(F.col("type").isin(*kinds)).select("conv_id", "session").distinct().withColumn("_ok", F.lit(True))
    at = sessions.select("conv_id", "position", "session").join(quotable, ["conv_id", "session"], "left")
    return hits.join(at, ["conv_id", "position"]).groupBy("question", "direction", "query").agg(F.count_if(F.col("_ok")).alias("citable"))


def query_status(weights: DataFrame, visible: DataFrame, citable: DataFrame | None = None) -> DataFrame:
    """no_match, selected, partially_selected, budget_exceeded or missing_reference, from hits and how many are in the context.

    ``citable``: :func:`citable_hits`; a query none of whose hits can be cited is not short of budget but of a reference.
    """
    keys = ["question", "direction", "query"]
    v = visible.groupBy(*keys).agg(F.count("*").alias("included_hits"))
    each = weights.join(v, keys, "left").fillna(0, ["included_hits"])
    status = F.when(F.col("hits") == 0, "no_match").when(F.col("included_hits") >= F.col("hits"), "selected").when(F.col("included_hits") > 0, "partially_selected")
    if citable is None:
        return each.withColumn("status", status.otherwise("budget_exceeded"))
    each = each.join(citable, keys, "left").fillna(0, ["citable"])
    return each.withColumn("status", status.when(F.col("citable") > 0, "budget_exceeded").otherwise("missing_reference")).drop("citable")


def complete_if_fits(rows: DataFrame, budget: int) -> DataFrame:
    """Per conversation, whether the whole snapshot renders within a budget (bytes and line ends)."""
    return rows.groupBy("conv_id").agg((F.sum(F.octet_length("content") + 1)).alias("bytes")).withColumn("fits", F.col("bytes") <= budget)


def need_retrieval(windows: DataFrame, visible: DataFrame) -> DataFrame:
    """``conv_id, position, needed``: whether some row of an anchor's window (left, right) is not visible yet."""
    inside = windows.join(visible.select("conv_id", F.col("position").alias("_p")).distinct(), "conv_id").where(F.col("_p").between(F.col("left"), F.col("right")))
    seen = inside.groupBy("conv_id", "position").agg(F.count("*").alias("seen"))
    both = windows.join(seen, ["conv_id", "position"], "left")
    return both.select("conv_id", "position", (F.coalesce("seen", F.lit(0)) < F.col("right") - F.col("left") + 1).alias("needed"))


def revision(*parts: Column) -> Column:
    """The key of a cached result: SHA-256 over its inputs, each with its length before it, so none can run into the next."""
    each = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*[x for p in each for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)


def in_scope(store: DataFrame, source_id: str, policy: str) -> DataFrame:
    """The store itself, if all its rows are of this snapshot and policy; a row of another scope raises."""
    same = F.col("source_id").eqNullSafe(F.lit(source_id)) & F.col("policy").eqNullSafe(F.lit(policy))
    checked = F.when(same, F.col("source_id")).otherwise(F.raise_error(F.lit("the store belongs to another snapshot or policy")).cast("string"))
    return store.withColumn("source_id", checked)


def catalogue(tokens: DataFrame, evidence: DataFrame, messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """``ref, kind, status, id`` of references: resolved, missing, ambiguous, or quarantined (evidence that is not bound).

    ``evidence``: id, status; ``messages``: id; ``chunks``: chunk_index. Dots at the end of a shortened id don't count.
    """
    t = tokens.select("ref").distinct()
    short = t.where(~F.col("ref").startswith("chunk_")).select("ref", F.regexp_replace("ref", r"[.…]+$", "").alias("p"))
    ids = evidence.select("id").union(messages.select("id"))
    found = resolve(short.select(F.col("p").alias("ref")), ids).withColumnRenamed("ref", "p")
    bad = evidence.where(F.col("status").isin("unmatched", "ambiguous")).select("id").distinct().withColumn("bad", F.lit(True))
    named = short.join(found, "p").join(bad, "id", "left")
    named = named.select("ref", F.when(F.col("ref").startswith("E_"), "evidence").otherwise("message").alias("kind"), F.when(F.col("bad"), "quarantined").otherwise(F.col("status")).alias("status"), "id")
    own = t.where(F.col("ref").startswith("chunk_")).select("ref", F.format_string("chunk_%03d", F.expr("cast(substring(ref, 7) AS int)")).alias("id"))
    there = chunks.select(F.format_string("chunk_%03d", F.col("chunk_index").cast("int")).alias("id")).distinct().withColumn("there", F.lit(True))
    own = own.join(there, "id", "left").select("ref", F.lit("chunk").alias("kind"), F.when(F.col("there"), "resolved").otherwise("missing").alias("status"), "id")
    return named.union(own)
