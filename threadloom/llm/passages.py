"""Substring dedup by hashing lines, cut further at sentence ends.

A unit is a sentence of a line, lower-cased and with its white space collapsed. Digests of all units of all documents are
grouped; the earliest occurrence, by (doc_id, hash of the text, place), stays, and later ones are marked. Adjacent marked
units form a run, and a run of at least ``min_words`` words is removed: long copied passages go wherever they were put,
while a short line or a licence notice that many documents share does not make its documents lose text (``min_words`` 1
removes those too). Removed spans keep their offsets (code points, half open) in the original text.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, ship, spare, written

MIN_WORDS = 20
_UNIT = re.compile(r"\n|(?<=\w[.!?])\s+")


def units(text: str) -> list[tuple[int, int, int, int, int]]:
    """start, end, words and the two halves of the digest of every unit that has a word."""
    out, at = [], 0
    cuts = [(m.start(), m.end()) for m in _UNIT.finditer(text)]
    for stop, after in [*cuts, (len(text), len(text))]:
        words = text[at:stop].lower().split()
        if words:
            d = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace"))
            out.append((at, stop, len(words), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
        at = after
    return out


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit: ``doc_id, text_hash, unit, start, end, words, d0, d1``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))

    def run(batches):
        spare()
        for b in batches:
            for first in range(0, b.num_rows, 500):
                c = b.slice(first, 500)
                of, no, found = [], [], []
                for k, t in enumerate(c.column("text")):
                    got = units(t.as_py())
                    of += [k] * len(got)
                    no += range(len(got))
                    found += got
                at = pa.array(of, pa.int32())
                columns = list(zip(*found, strict=True)) or [()] * 5
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([c.column("doc_id").take(at), c.column("text_hash").take(at), pa.array(no, pa.int32()), *[pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]], ["doc_id", "text_hash", "unit", "start", "end", "words", "d0", "d1"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, unit int, start int, end int, words int, d0 long, d1 long")


def spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, start, end, n_words, kept_doc_id``: what is to be removed, one row per run.

    A null text has no units. Rows that repeat in full count as one document, so their text stays in all of them; rows of
    one doc_id with different texts are different documents; a row without doc_id ranks first. Other columns are ignored;
    empty in, empty out.
    """
    at = F.struct("doc_id", "text_hash", "unit")
    found = written(occurrences(docs, id_col, text_col), "units")
    many = found.groupBy("d0", "d1").agg(F.min(at).alias("keep"), F.max(at).alias("last")).where("keep <> last").drop("last")
    many = written(many, "repeats")
    later = found.join(many, ["d0", "d1"]).where((F.col("unit") != F.col("keep.unit")) | (F.col("text_hash") != F.col("keep.text_hash")) | ~F.col("doc_id").eqNullSafe(F.col("keep.doc_id")))
    one = ["doc_id", "text_hash", "unit"]
    later = later.select(*one, "start", "end", "words", F.col("keep.doc_id").alias("kept_doc_id")).repartition("doc_id", "text_hash").dropDuplicates(one)
    island = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("unit"))
    runs = later.withColumn("run", island).groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.min(F.struct("unit", "kept_doc_id")).alias("first"))
    return runs.where(F.col("n_words") >= min_words).select("doc_id", "text_hash", "start", "end", "n_words", F.col("first.kept_doc_id").alias("kept_doc_id"))


def cut(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans taken out of ``text_col`` and a column ``removed``: their (start, end), null if none.

    Every row stays, with every column, but for a column ``removed`` that ``docs`` has already, which is replaced; a null
    text stays null, and a text that was nothing but repeats becomes empty. Empty in, empty out.
    """
    docs = docs.drop("removed")
    own, other = fresh(docs, "id"), fresh(docs, "hash")
    out = spans(docs, min_words, id_col, text_col).groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(other)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    both = docs.join(out, docs[id_col].eqNullSafe(F.col(own)) & (F.xxhash64(docs[text_col]) == F.col(other)), "left").drop(own, other)
    at = both.columns.index(text_col)

    def run(batches):
        spare()
        for b in batches:
            texts = []
            for t, spans_ in zip(b.column(at), b.column("removed"), strict=True):
                if not spans_.is_valid:
                    texts.append(t.as_py())
                    continue
                text, kept, last = t.as_py(), [], 0
                for x in spans_.as_py():
                    kept.append(text[last : x["start"]])
                    last = x["end"]
                texts.append("".join(kept) + text[last:])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return both.mapInArrow(run, both.schema)
