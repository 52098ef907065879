"""The corpus pipeline: toxicity, quality rules, near-duplicates, repeated passages, packing.

Every stage reads what its predecessor kept and passes the columns of ``documents`` on (``COLUMNS``, which must all exist;
further columns are left out), except the last, which packs. Empty tables pass through every stage as empty tables.

A stage's working tables go when the next stage of the same folder begins, since its result has been written by then;
those of the last stage, and of results never handed on, go when the application ends.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import packing, passages, quality, shared, similar, toxicity
from threadloom.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_NAMES: list[str] = []
_MADE: dict[tuple[str, str], shared.Scope] = {}


def _stage(f):
    """A stage that deletes the working tables of the stage before it in the same folder, and of no other result."""
    _NAMES.append(f.__name__)

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        k = _NAMES.index(f.__name__)
        before = _MADE.pop((sf_dir, _NAMES[k - 1]), None) if k else None
        if before:
            before.free(spark)
        shared.small_batches(spark)
        with shared.scope() as made:
            out = f(spark, docs, sf_dir)
        _MADE[sf_dir, f.__name__] = made
        return out

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the corpus's own labelled rows, does not reject.

    Null and empty texts score 0 and stay; a null doc_id has no label; repeated rows are judged alike.
    """
    model = toxicity.train(docs, shared.table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, model, keep=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS)


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, against references of what came in.

    Null and empty texts have no words and go; a null lang is a language of its own; repeated rows are judged alike.
    """
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text", "lang")
    bad = quality.judged(rows, id_col="key").where("not kept").select(F.col("doc_id.doc_id").alias("_i"), F.col("doc_id.h").alias("_h")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_i")) & (F.xxhash64(docs["text"]) == F.col("_h")), "left_anti").select(*COLUMNS)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (similarity of 5-word shingles of at least 0.8) one document stays.

    Links come from SimHash over positional bytes, verified on the texts, and for the rest of that similarity from sketches.
    It is the one with the smallest doc_id, documents without one last, and of several texts under that doc_id the one of
    the smallest hash. Rows that repeat it are one document. A null text counts as empty, and all texts without words are
    one group.
    """
    found = similar.groups(docs).groupBy(F.col("doc_id").alias("_i"), F.col("node").alias("_n")).agg(F.count("*").alias("_rows"), F.min("first").alias("_first"))
    odd = shared.written(found.where("not _first or _rows > 1"), "odd")
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    same = docs["doc_id"].eqNullSafe(F.col("_i")) & (node == F.col("_n"))
    once = docs.join(odd, same, "left_anti").select(*COLUMNS)
    repeated = docs.join(odd.where("_first"), same, "left_semi").withColumn("_n", node).dropDuplicates(["doc_id", "_n"])
    return once.union(repeated.select(*COLUMNS))


@_stage
def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their repeated passages taken out after the first occurrence; n_chars follows the text.

    Null texts stay null; rows that repeat in full count as one document and keep their text.
    """
    out = passages.cut(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a null text is the end id alone, a null source a source of its own."""
    # Encoded by the workers: a jar added to a long-running application makes the driver compile its plans anew, and hold both.
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"), in_jvm=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_passages),
    ("packing", pack),
]

#: No stage's rules (a trained model, byte-pair ids, a cut text) can be put in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again by the next."""
    shared.small_batches(spark)
    docs = shared.table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        with shared.scope() as made:
            docs = stage.__wrapped__(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = shared.written(docs, f"stage-{name}")
        if k < len(STAGES) - 1:
            result = made.paths.pop()
            made.free(spark)
            if before:
                before.free(spark)
            before = shared.Scope()
            before.paths = [result]
    return docs
