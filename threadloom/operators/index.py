"""A stored trigram index: ranked search over evidence from postings alone, whatever became of the texts.

An index is published (``sources.store``): its pointer lists segments, and every append adds one. A segment is two tables.
``docs`` has every row's id, role, length, block (rows of one role, about ``BLOCK`` of them, by a hash of the id) and its
number in the block, in the order of ids. ``postings`` has a row for each trigram and block: how many rows hold it (``df``), the
most places in one of them and the shortest length, which bounds the score of any of its rows; their numbers, and their places
one after the other (``starts`` tells where each row's begin, and where the last one's end). A block's postings are made where
its texts are, and sorted by trigram in every file, in pages of few rows, so a scan for some trigrams skips the other pages
by Parquet's statistics.

Terms are found as phrases of trigrams: places shifted by each trigram's offset, intersected. So scores are those of a
search over the texts. Where all terms are single trigrams, how many rows hold each is the sum of ``df``; then only the most
promising blocks are read at first, and of the rest those whose bound reaches the worst score kept of their role.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..functions.text import trigrams
from ..sources.store import Published, written
from .retrieval import FLOOR, K1, B, check_query

BLOCK, FIRST = 256, 4
#: Rows of a page, and bytes of a group of pages, of the postings; by default a page has 20,000 rows, and a query a few hundred.
PAGES = {"postings": {"parquet.page.row.count.limit": "256", "parquet.block.size": str(16 << 20)}}
POSTINGS = "trigram string, block string, df int, most int, shortest int, rows array<int>, starts array<int>, places array<int>"


class TrigramIndex:
    """The index of one name under ``root``."""

    def __init__(self, spark: SparkSession, root: str, name: str = "trigrams"):
        self.spark, self.at = spark, Published(spark, root, name)

    def _table(self, table: str) -> DataFrame:
        entry = self.at.entry()
        if entry is None:
            raise FileNotFoundError(f"no index at {self.at.path}")
        parts = [self.spark.read.parquet(f"{self.at.path}/{s}/{table}") for s in entry["segments"]]
        return reduce(DataFrame.union, parts)

    def append(self, rows: DataFrame) -> int:
        """Index ``rows`` (id, role, text) as a new segment; ids that are there already, and null ones, are passed over.

        A null text or one below 3 characters counts as a row of length 0. Raises ``Conflict`` if another writer has come
        first. Returns the generation.
        """
        entry = self.at.entry() or {"generation": 0, "segments": [], "rows": 0, "length": 0}
        new = rows.where("id is not null").select("id", "role", F.lower(F.coalesce("text", F.lit(""))).alias("l")).dropDuplicates(["id"])
        if entry["segments"]:
            new = new.join(self._table("docs").select("id"), "id", "left_anti")
        sized = new.withColumn("len", F.greatest(F.lit(0), F.char_length("l") - 2))
        texts = written(sized, "to-index")
        blocks = max(1, texts.count() // BLOCK)
        block = F.concat(F.coalesce(F.concat(F.lit("="), "role"), F.lit("")), F.lit(f"/{entry['generation'] + 1}/"), F.expr(f"pmod(xxhash64(id), {blocks})").cast("string"))
        texts = texts.withColumn("block", block)
        number = F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1
        ship(self.spark)
        tables = {
            "docs": texts.select("id", "role", "len", "block", number.alias("nr")),
            "postings": texts.select("id", "block", "l").groupBy("block").applyInArrow(_posted, POSTINGS).sortWithinPartitions("trigram", "block"),
        }
        total = texts.agg(F.count("*").alias("n"), F.sum("len").alias("length")).first()
        return self._commit(tables, entry, entry["segments"], entry["rows"] + total["n"], entry["length"] + (total["length"] or 0))

    def _commit(self, tables: dict[str, DataFrame], before: dict, segments: list[str], rows: int, length: int) -> int:
        folder = self.at.write(tables, PAGES)
        more = {"segments": [*segments, folder], "rows": rows, "length": length}
        return self.at.commit(folder, folder, list(tables), before["generation"], more)

    def merge(self) -> int:
        """All segments as one; searches give the same rows before and after."""
        entry = self.at.entry()
        order = {"docs": ["block", "nr"], "postings": ["trigram", "block"]}
        tables = {t: self._table(t).repartitionByRange(*order[t]).sortWithinPartitions(*order[t]) for t in order}
        return self._commit(tables, entry, [], entry["rows"], entry["length"])

    def _postings(self, grams: list[str]) -> DataFrame:
        return self._table("postings").where(F.col("trigram").isin(sorted(set(grams))))

    def phrase(self, term: str, within: DataFrame | None = None) -> DataFrame:
        """``block, nr, tf`` of the rows that hold a term of 3 characters or more; ``within``: only these blocks."""
        grams = [term[k : k + 3] for k in range(len(term) - 2)]
        found = self._postings(grams)
        if within is not None:
            found = found.join(within.select("block"), "block", "left_semi")
        first, stop = (lambda i: F.get("starts", i)), (lambda i: F.get("starts", i + 1))
        if len(grams) == 1:
            return found.select("block", F.inline(F.transform("rows", lambda nr, i: F.struct(nr.alias("nr"), (stop(i) - first(i)).alias("tf")))))
        each = found.select("trigram", "block", F.inline(F.transform("rows", lambda nr, i: F.struct(nr.alias("nr"), F.slice("places", first(i) + 1, stop(i) - first(i)).alias("places")))))
        offsets = F.create_map(*[x for g in sorted(set(grams)) for x in (F.lit(g), F.array(*[F.lit(k) for k, h in enumerate(grams) if h == g]))])
        each = each.select("block", "nr", "places", F.explode(offsets[F.col("trigram")]).alias("k"))
        each = each.select("block", "nr", F.transform("places", lambda p: p - F.col("k")).alias("starts"))
        # At most as many arrays as a query has characters.
        both = each.groupBy("block", "nr").agg(F.collect_list("starts").alias("s")).where(F.size("s") == len(grams))
        starts = F.aggregate("s", F.get("s", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        return both.select("block", "nr", F.size(starts).alias("tf")).where("tf > 0")

    def _bounds(self, terms: list[str], stats: dict[str, float], mean: float) -> DataFrame:
        """``block, role_key, bound``: blocks that hold every trigram of the terms, with the best score a row there can have."""
        found = self._postings(terms)
        value = F.create_map(*[x for t in sorted(set(terms)) for x in (F.lit(t), F.lit(stats[t] * terms.count(t)))])
        best = value[F.col("trigram")] * _impact(F.col("most"), F.col("shortest"), mean)
        each = found.groupBy("block").agg(F.sum(best).alias("bound"), F.count_distinct("trigram").alias("n")).where(F.col("n") == len(set(terms)))
        return each.select("block", F.regexp_replace("block", "/[0-9]+/[0-9]+$", "").alias("role_key"), "bound")

    def scored(self, terms: list[str], stats: dict[str, float], mean: float, within: DataFrame | None = None, found: dict[str, DataFrame] | None = None) -> DataFrame:
        """``id, role, block, score`` of the rows that hold all terms; less is better. ``found``: the rows of each term, if known."""
        hits, score = None, F.lit(0.0)
        for k, t in enumerate(terms):
            one = (found[t] if found else self.phrase(t, within)).withColumnRenamed("tf", f"tf{k}")
            hits = one if hits is None else hits.join(one, ["block", "nr"])
            score = score - F.lit(stats[t]) * _impact(F.col(f"tf{k}"), F.col("len"), mean)
        sized = hits.join(self._table("docs").select("block", "nr", "id", "role", "len"), ["block", "nr"])
        return sized.select("id", "role", "block", score.alias("score"))

    def weights(self, terms: list[str], found: dict[str, DataFrame] | None = None) -> tuple[dict[str, float], float]:
        """Each term's weight by how many rows hold it, and the mean length; a few numbers. ``found``: as in ``scored``."""
        entry = self.at.entry()
        single = [t for t in set(terms) if len(t) == 3]
        n = {t: 0 for t in terms}
        if single:
            n |= {r["trigram"]: r["n"] for r in self._postings(single).groupBy("trigram").agg(F.sum("df").alias("n")).collect()}
        for t in set(terms) - set(single):
            n[t] = (found[t] if found else self.phrase(t)).count()
        raw = self.spark.range(1).select(*[F.log((F.lit(entry["rows"]) - n[t] + 0.5) / (F.lit(n[t]) + 0.5)).alias(f"w{k}") for k, t in enumerate(terms)]).first()
        return {t: (FLOOR if raw[k] <= 0 else raw[k]) for k, t in enumerate(terms)}, entry["length"] / max(1, entry["rows"])

    def search(self, query: str, limit: int, first: int = FIRST) -> DataFrame:
        """``role, rank, id, score``: the best ``limit`` rows of each role that hold all terms; ties (to 9 places) by id.

        A term below 3 characters can't be answered by trigrams and raises; such a query reads the texts
        (``retrieval.search``). ``first``: blocks of each role that are read before any is passed over.
        """
        terms = [t.lower() for t in check_query(query, limit)]
        if any(len(t) < 3 for t in terms):
            raise ValueError("a term of a stored index has 3 characters or more")
        # How many rows hold a longer term is known only from its rows: they are found once, for the weights and the scores.
        found = {t: written(self.phrase(t), "phrase") for t in sorted(set(terms))} if any(len(t) > 3 for t in terms) else None
        stats, mean = self.weights(terms, found)
        hits = self.scored(terms, stats, mean, found=found) if found else self._pruned(terms, stats, mean, limit, first)
        top = hits.withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy(F.round("score", 9), "id"))).where(F.col("rank") <= limit)
        return top.select("role", "rank", "id", "score")

    def _pruned(self, terms: list[str], stats: dict[str, float], mean: float, limit: int, first: int) -> DataFrame:
        some, rest = self.chosen(terms, stats, mean, limit, first)
        return some.union(self.scored(terms, stats, mean, rest))

    def chosen(self, terms: list[str], stats: dict[str, float], mean: float, limit: int, first: int) -> tuple[DataFrame, DataFrame]:
        """The hits of the most promising blocks, and the other blocks that may still hold one of the best."""
        blocks = written(self._bounds(terms, stats, mean).withColumn("r", F.row_number().over(Window.partitionBy("role_key").orderBy(F.desc("bound"), "block"))), "bounds")
        some = written(self.scored(terms, stats, mean, blocks.where(F.col("r") <= first)), "first-hits")
        role = F.regexp_replace("block", "/[0-9]+/[0-9]+$", "").alias("role_key")
        kept = some.select(role, "score", "id").withColumn("k", F.row_number().over(Window.partitionBy("role_key").orderBy("score", "id")))
        worst = kept.where(F.col("k") == limit).select("role_key", F.col("score").alias("worst"))
        # A hair's breadth below counts as reached: ranks go by scores rounded to 9 places.
        return some, blocks.where(F.col("r") > first).join(worst, "role_key", "left").where("worst is null or bound >= -worst - 1e-8").select("block")


def _impact(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / F.lit(mean)))


def _posted(block: pa.Table) -> pa.Table:
    """The postings of one block's rows (id, block, l)."""
    block = block.sort_by("id").combine_chunks()
    found = trigrams(block.column("l").to_pylist())
    first = found.first  # of each trigram, its first row
    df, tf = np.diff(first), np.diff(found.starts)
    sizes = found.lengths[found.rows]
    ends = np.append(found.starts[first[:-1]], found.starts[-1:])  # of each trigram, its first place
    at = np.arange(len(found.rows) + len(df)) - np.repeat(np.arange(len(df)), df + 1)  # each trigram's rows and one more
    at_first = np.repeat(ends[:-1], df + 1)
    starts = found.starts[at] - at_first
    none = not len(df)
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
    return pa.table(
        {
            "trigram": pa.array(found.names, pa.string()), "block": pa.array([block.column("block")[0].as_py()] * len(df), pa.string()), "df": pa.array(df, pa.int32()),
            "most": pa.array([] if none else np.maximum.reduceat(tf, first[:-1]), pa.int32()), "shortest": pa.array([] if none else np.minimum.reduceat(sizes, first[:-1]), pa.int32()),
            "rows": lists(first, found.rows), "starts": lists(first + np.arange(len(first)), starts), "places": lists(ends, found.places),
        }
    )
