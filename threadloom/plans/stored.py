"""Queries over what is kept between runs: a stored index, results by key, published generations, and export files."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import messages as ms
from ..operators import scans, scoring
from ..operators.extraction import Results
from ..operators.index import TrigramIndex
from ..sources import exports
from ..sources.store import Cache, Published, working_dir, working_path
from ..streaming import live
from . import testdata as td
from .registry import _GOLD, ORACLES, _labelled, query


def fingerprint(rows: DataFrame) -> str:
    """The key of a table's content, whatever its order: its number of rows and two sums over their hashes."""
    h = F.xxhash64(*rows.columns)
    r = rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum((h % 1_000_003).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{sorted(rows.columns)}|{r.n}|{r.x}|{r.s}".encode()).hexdigest()


def _index(spark, sf_dir) -> TrigramIndex:
    """The index of the documents as they are now: built in two appends if it is not stored yet, else only opened."""
    rows = td.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("role"), "text")
    index = TrigramIndex(spark, f"{working_dir(spark)}/threadloom/block-indexes", fingerprint(rows))
    if index.at.entry() is None:
        for part in (rows.where("id % 2 = 0 OR id IS NULL"), rows.where("id % 2 <> 0")):
            index.append(part)
    return index


def _bm25(*terms: str) -> str:
    n = range(len(terms))
    # These terms do not overlap themselves, so what is left without them tells their number.
    tf = ", ".join(f"(length(l) - length(replace(l, '{t}', ''))) // {len(t)} AS t{k}" for k, t in enumerate(terms))
    weight = ", ".join(f"CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{k} + 0.5) / (n{k} + 0.5)) END AS w{k}" for k in n)
    score = "".join(f" - w{k} * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * len / al))" for k in n)
    return f"""WITH d AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS l, greatest(0, length(lower(coalesce(text, ''))) - 2) AS len FROM documents),
t AS (SELECT *, {tf} FROM d), s AS (SELECT count(*) AS n, avg(len) AS al, {', '.join(f'count(*) FILTER (WHERE t{k} > 0) AS n{k}' for k in n)} FROM t), w AS (SELECT *, {weight} FROM s),
x AS (SELECT lang AS role, doc_id, 0{score} AS score FROM t, w WHERE {' AND '.join(f't{k} > 0' for k in n)}),
k AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY round(score, 9), doc_id) AS rank, doc_id, round(score, 5) AS score FROM x) SELECT * FROM k WHERE rank <= 10"""


def _found(spark, sf_dir, terms: str) -> DataFrame:
    return _index(spark, sf_dir).search(terms, 10).select("role", "rank", F.col("id").alias("doc_id"), F.round("score", 5).alias("score"))


@query(_bm25("tion", "ther"))
def stored_index_bm25(spark, sf_dir):
    """Answered by the stored index alone: phrases of trigrams."""
    return _found(spark, sf_dir, "tion THER")


@query(_bm25("und", "sch"))
def block_max_bm25(spark, sf_dir):
    """Single trigrams: blocks whose bound does not reach the best rows are passed over."""
    return _found(spark, sf_dir, "und sch")


@query("""WITH r AS (SELECT 'all' AS revision, role FROM conversations UNION ALL SELECT 'said' AS revision, role FROM conversations WHERE role <> 'system')
SELECT revision, role, count(*) AS n, CASE revision WHEN 'all' THEN 2 ELSE 1 END::BIGINT AS hits, 1::BIGINT AS misses FROM r GROUP BY revision, role""")
def cached_revisions(spark, sf_dir):
    """Two revisions of one table asked for in turn, five times: each is computed once and then read."""
    c = td.table(spark, sf_dir, "conversations")
    root, asked, out = working_path(spark, "cache"), {"all": c, "said": c.where("role <> 'system'")}, {}
    seen = {name: Cache(spark, root) for name in asked}
    for name in ("all", "said", "all", "said", "all"):
        out[name] = seen[name].get(fingerprint(asked[name]), lambda name=name: asked[name].groupBy("role").agg(F.count("*").alias("n")))
    parts = [out[n].select(F.lit(n).alias("revision"), "role", "n", F.lit(seen[n].hits).cast("long").alias("hits"), F.lit(seen[n].misses).cast("long").alias("misses")) for n in out]
    return parts[0].union(parts[1])


@query("""WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) AS g FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)), d AS (SELECT source, g FROM documents JOIN l USING (lang))
SELECT l.g AS generation, d.source, count(*) AS n, l.g = max(l.g) OVER () AS is_current FROM l JOIN d ON d.g <= l.g WHERE l.g <= 3 GROUP BY l.g, d.source""")
def published_generations(spark, sf_dir):
    """A store that grows by a language with each generation (three at most); every generation stays readable."""
    d = td.table(spark, sf_dir, "documents")
    at = Published(spark, working_path(spark, "published"), "documents")
    langs = [r.lang for r in d.where("lang IS NOT NULL").select("lang").distinct().orderBy("lang").limit(3).collect()]
    for k in range(len(langs)):
        at.publish({"documents": d.where(F.col("lang").isin(langs[: k + 1])).select("doc_id", "source")}, f"r{k}", expected=k)
    now, out = at.entry()["generation"] if langs else 0, []
    for g in at.generations():
        out.append(at.table("documents", g).groupBy("source").agg(F.count("*").alias("n")).select(F.lit(g).cast("long").alias("generation"), "source", "n", F.lit(g == now).alias("is_current")))
    none = d.limit(0).select(F.lit(0).cast("long").alias("generation"), "source", F.lit(0).cast("long").alias("n"), F.lit(False).alias("is_current"))
    for part in out:
        none = none.union(part)
    return none


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS original_index, CAST(role = 'user' AS INTEGER) AS is_send, role = 'system' AS is_system, length(text) AS chars, md5(text) AS text_md5 FROM conversations")
def streamed_exports(spark, sf_dir):
    """Every conversation as a native export file, read back through the data source."""
    c = td.table(spark, sf_dir, "conversations")
    path = working_path(spark, "exports")
    kind = F.when(F.col("role") == "system", ms.SYSTEM).otherwise(ms.TEXT)
    rows = c.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").alias("original_index"), kind.alias("type"), F.col("text").alias("content"), (F.col("role") == "user").cast("int").alias("is_send"), F.lit("2024-01-01 00:00:00").alias("time_str"))
    exports.write_native(rows, path)
    back = exports.read(spark, path)
    return back.select("conv_id", "original_index", "is_send", (F.col("type") == ms.SYSTEM).alias("is_system"), F.char_length("content").cast("long").alias("chars"), F.md5("content").alias("text_md5"))


_DRAWS = f""", p AS (SELECT DISTINCT profile FROM g WHERE profile IS NOT NULL), h AS (SELECT profile, rep, CAST('0x' || substr(md5(profile || ':' || rep || ':{scoring.SEED}'), 1, 8) AS BIGINT) AS u FROM p, range({scoring.REPEATS}) t(rep)),
w AS (SELECT profile, rep, {' + '.join(f'CAST(u >= {x} AS INTEGER)' for x in scoring.poisson_limits())} AS weight FROM h)"""
_ENDS = "max(x) FILTER (WHERE r = floor(0.025 * (n - 1))) AS low, max(x) FILTER (WHERE r = floor(0.975 * (n - 1))) AS high"
_TFN = "count(*) FILTER (WHERE gold = {0}) AS tp, count(*) FILTER (WHERE {0} IS NOT NULL AND (gold IS NULL OR gold <> {0})) AS fp, count(*) FILTER (WHERE gold IS NOT NULL AND ({0} IS NULL OR gold <> {0})) AS fn"


def _intervals() -> str:
    cells = [(i, j) for i in range(3) for j in range(3)]
    c = {(i, j): f"c{i}{j}" for i, j in cells}
    counts = ", ".join(f"count(*) FILTER (WHERE gold = {i} AND pred = {j}) AS {c[i, j]}" for i, j in cells)
    sums = ", ".join(f"CAST(sum({x} * weight) AS DOUBLE) AS {x}" for x in ("known", "silent", *c.values()))
    total = lambda f: " + ".join(f"{c[i, j]} * {float(f(i, j))}" for i, j in cells)
    chance = " + ".join(f"({' + '.join(c[i, k] for k in range(3))}) * ({' + '.join(c[k, j] for k in range(3))}) * {float((i - j) ** 2)}" for i, j in cells)
    return f"""{_GOLD}{_DRAWS}, e AS (SELECT profile, count(gold) AS known, count(*) FILTER (WHERE gold IS NOT NULL AND pred IS NULL) AS silent, {counts} FROM g GROUP BY profile),
s AS (SELECT rep, {sums} FROM e JOIN w USING (profile) WHERE weight > 0 GROUP BY rep),
t AS (SELECT *, {total(lambda i, j: 1)} AS n, {total(lambda i, j: i == j)} AS tp, {total(lambda i, j: abs(i - j) / 2)} AS off, {total(lambda i, j: (i - j) ** 2)} AS seen, {chance} AS chance,
  {total(lambda i, j: i)} AS a, {total(lambda i, j: j)} AS b, {total(lambda i, j: i * i + j * j)} AS sq, {total(lambda i, j: (i + j) ** 2)} AS su FROM s),
m AS (SELECT *, (a + b) * (a + b) / nullif(2 * n, 0) AS mean, 2 * tp / nullif(2 * tp + 2 * (n - tp) + silent, 0) AS f1, (off + silent) / nullif(known, 0) AS mae FROM t),
v AS (SELECT *, (su / 2 - mean) / nullif(n - 1, 0) AS msr, (a * a + b * b) / nullif(n, 0) - mean AS msc FROM m),
q AS (SELECT *, (sq - mean - (su / 2 - mean) - msc) / nullif(n - 1, 0) AS mse FROM v),
l AS (SELECT rep, unnest([{{'metric': 'micro_f1', 'x': f1}}, {{'metric': 'coverage', 'x': n / nullif(known, 0)}}, {{'metric': 'mae_penalised', 'x': mae}}, {{'metric': 'coupling', 'x': (f1 + 1 - mae) / 2}},
  {{'metric': 'weighted_kappa', 'x': CASE WHEN n > 0 AND chance <> 0 THEN 1 - seen * n / chance END}}, {{'metric': 'icc', 'x': CASE WHEN n > 1 AND abs(msr + mse + 2 * (msc - mse) / n) > 1e-15 THEN (msr - mse) / (msr + mse + 2 * (msc - mse) / n) END}}]) AS k FROM q),
r AS (SELECT k.metric AS metric, k.x AS x, row_number() OVER (PARTITION BY k.metric ORDER BY k.x) - 1 AS r, count(*) OVER (PARTITION BY k.metric) AS n FROM l WHERE k.x IS NOT NULL)
SELECT metric, round(low, 9) AS low, round(high, 9) AS high FROM (SELECT metric, {_ENDS} FROM r GROUP BY metric)"""


@query(_intervals())
def bootstrap_hashed(spark, sf_dir):
    """Intervals of all metrics by draws that SQL can repeat."""
    return scoring.bootstrap(_labelled(spark, sf_dir)).select("metric", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"""{_GOLD}{_DRAWS}, e AS (SELECT profile, {_TFN.format('pred')} FROM g GROUP BY profile), f AS (SELECT profile, {_TFN.format('1')} FROM g GROUP BY profile),
s AS (SELECT rep, sum(e.tp * weight) AS ta, sum((e.fp + e.fn) * weight) AS oa, sum(f.tp * weight) AS tb, sum((f.fp + f.fn) * weight) AS ob FROM e JOIN f USING (profile) JOIN w USING (profile) WHERE weight > 0 GROUP BY rep),
x AS (SELECT 2 * ta / nullif(2 * ta + oa, 0) - 2 * tb / nullif(2 * tb + ob, 0) AS x FROM s), r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r, count(*) OVER () AS n FROM x WHERE x IS NOT NULL)
SELECT round(low, 9) AS low, round(high, 9) AS high FROM (SELECT {_ENDS} FROM r)""")
def paired_bootstrap(spark, sf_dir):
    """The labels against a baseline that always says 1, on the same draws."""
    rows = _labelled(spark, sf_dir)
    return scoring.paired_bootstrap(rows, rows.withColumn("pred", F.lit(1))).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def _as(name: str):
    """Another way to the rows of a query: the same oracle."""
    return query(ORACLES[name])


@_as("message_chunks")
def chunks_in_blocks(spark, sf_dir):
    return scans.chunked(td.documents(spark, sf_dir))


@_as("gap_sessions")
def scanned_sessions(spark, sf_dir):
    return scans.gap_sessions(td.events(spark, sf_dir)).select("conv_id", "original_index", "position", "session")


@_as("message_positions")
def scanned_positions(spark, sf_dir):
    rows = scans.positioned(ms.parse(td.raw_conversations(spark, sf_dir)))
    return rows.select("conv_id", F.col("original_index").cast("long").alias("original_index"), F.col("position").cast("long").alias("position"), "sender")


@query("""WITH k AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents)
SELECT source AS conv_id, CAST(i AS INTEGER) AS chunk_index, CASE WHEN n % 7 <> 0 THEN CAST(n AS VARCHAR) END AS answer, CASE WHEN n % 7 = 0 THEN 3 WHEN n % 5 = 0 THEN 2 ELSE 1 END AS attempts, n % 7 = 0 AS failed FROM k WHERE n IS NOT NULL""")
def resumed_extraction(spark, sf_dir):
    """A stand-in model that fails once on some chunks and always on others; a second run computes what is missing only."""
    texts = td.table(spark, sf_dir, "documents").select(F.col("source").alias("conv_id"), "doc_id", F.col("text").alias("transcript"))
    rows = scans.Scan.of(texts, [F.col("doc_id").isNull(), F.col("doc_id")]).numbered("chunk_index").result().where("transcript is not null").select("conv_id", "chunk_index", "transcript")

    def model(frame, attempt):
        n = [len(text) for text in frame["transcript"]]
        if any(k % 7 == 0 or k % 5 == 0 and attempt == 1 for k in n):
            raise ValueError("no answer")
        return pd.DataFrame({"conv_id": frame["conv_id"], "chunk_index": frame["chunk_index"], "answer": [str(k) for k in n]})

    results = Results(spark, working_path(spark, "extraction"), "stand-in 1")
    results.run(rows, model, attempts=1)
    results.run(rows, model, attempts=3)
    return results.table(rows).select("conv_id", "chunk_index", "answer", "attempts", F.col("error").isNotNull().alias("failed"))


@query("SELECT user_id AS conv_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def streamed_once(spark, sf_dir):
    """The events as a stream into a table that a replayed batch does not change; every batch comes twice here."""
    source, root = working_path(spark, "stream"), working_path(spark, "sink")
    td.table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").alias("conv_id"), "event_id").repartition(6, "event_id").write.mode("append").parquet(source)
    sink = live.Sink(spark, root, "events")

    def twice(batch, k):
        sink(batch, k)
        sink(batch, k)

    stream = spark.readStream.schema("conv_id long, event_id long").option("maxFilesPerTrigger", 2).parquet(source)
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return sink.table().groupBy("conv_id").agg(F.count("*").alias("n"))
