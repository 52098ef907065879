"""Quality rules: Jensen-Shannon distance of a document's histograms to those of its language, with length guards.

Every document gets two histograms: characters by class, and words by a fixed list of common words (the rest in one
bin). A language's reference is the mean histogram of all its documents that pass the minimum length and the base rules;
counts are kept as whole parts per million, so sums are exact and do not depend on the order of the rows. A document is
rejected when the base rules fail or the two distances (square roots of the divergence, base 2, 0 to 1) sum to more than
the limit. Documents below the guard's length, the base rules' own minimum, are too short for histograms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ship, written

#: Frequent words of four languages.
COMMON = {
    "en": "the of and to in a is that it for as with was on be by are this not or from at which have an they had you but were",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero sus le esta",
}
CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "other", "beyond")
MIN_WORDS = 50
#: Fewest words for histograms to be compared, and the largest sum of the two distances to the language's reference.
GUARD_WORDS, LIMIT = MIN_WORDS, 0.46
#: Languages whose references every worker holds (a bound of memory); beyond, references are joined instead.
LANGUAGES = 4096

_WORDS = sorted({w for words in COMMON.values() for w in words.split()})
_BIN = {v.encode(): k for k, w in enumerate(_WORDS, 1) for form in (w, w.capitalize()) for v in (form, form + ",", form + ".")}
BINS = len(_WORDS) + 1


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("other"))
    for name, chars in (("lower", range(0x61, 0x7B)), ("upper", range(0x41, 0x5B)), ("digit", range(0x30, 0x3A)), ("blank", [0x20, *range(0x09, 0x0E)]), ("stop", map(ord, ".,;:!?'\"()-")), ("symbol", map(ord, "#*$%&|<>"))):
        t[list(chars)] = CLASSES.index(name)
    t[0xC0:] = CLASSES.index("beyond")
    t[0x80:0xC0] = len(CLASSES)  # continues a character
    return t


_TABLE = _class_table()


def features(raw: bytes) -> tuple[int, int, int, int, int, np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms of one text in UTF-8."""
    by = np.zeros(256, np.int64)
    for at in range(0, len(raw), 1 << 20):
        by += np.bincount(np.frombuffer(raw, np.uint8, min(1 << 20, len(raw) - at), at), minlength=256)
    classes = np.bincount(_TABLE, by, len(CLASSES) + 1)[: len(CLASSES)].astype(np.int64)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    counts = np.bincount(ids, minlength=1)
    bins = np.zeros(BINS, np.int64)
    if words:
        bins += np.bincount([_BIN.get(w, 0) for w in seen], counts, BINS).astype(np.int64)
    repeated = 0
    if len(words) > 3:
        pair = ids[:-2] * len(seen) + ids[1:-1]
        if len(seen) > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair * len(seen) + ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key) + 2, bool)
        hit = np.concatenate([order[1:][same], order[:-1][same]])
        for k in range(3):
            twice[hit + k] = True
        repeated = int(twice.sum())
    return len(words), int(classes.sum() - classes[CLASSES.index("blank")]), int(classes[CLASSES.index("symbol")]), len(lines) - len(set(lines)), repeated, classes, bins


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One slim row per document: the base counts and the histograms in parts per million (null where empty)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def ppm(h):
        total = int(h.sum())
        return (h * 1_000_000 // total).astype(np.int32) if total else None

    def run(batches):
        for b in batches:
            found = [features(t.as_py() or b"") for t in b.column("text")]
            numbers = [pa.array([f[k] for f in found], pa.int64()) for k in range(5)]
            hists = [pa.array([ppm(f[k]) for f in found], pa.list_(pa.int32())) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *numbers, *hists], ["doc_id", "lang", *names, "classes", "bins"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, {', '.join(f'{n} long' for n in names)}, classes array<int>, bins array<int>")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(rows: DataFrame) -> DataFrame:
    """``lang, classes_ref, bins_ref`` (summing to 1), over all documents of the language that the base rules and the guard keep."""
    def run(batches):
        sums: dict[str, list] = {}
        for b in batches:
            for lang, c, w in zip(b.column("lang").to_pylist(), b.column("classes").to_pylist(), b.column("bins").to_pylist(), strict=True):
                at = sums.setdefault(lang, [np.zeros(len(CLASSES), np.int64), np.zeros(BINS, np.int64)])
                at[0] += np.array(c, np.int64)
                at[1] += np.array(w, np.int64)
            if len(sums) > 1000:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    def out(sums):
        return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s[0] for s in sums.values()], pa.list_(pa.int64())), pa.array([s[1] for s in sums.values()], pa.list_(pa.int64()))], ["lang", "c", "w"])

    part = rows.where(~base_failed() & (F.col("n_words") >= GUARD_WORDS)).select("lang", "classes", "bins").mapInArrow(run, "lang string, c array<long>, w array<long>")
    sums = [F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(len(CLASSES))] + [F.sum(F.col("w")[k]).alias(f"w{k}") for k in range(BINS)]
    total = part.groupBy("lang").agg(*sums)
    c, w = F.array(*[f"c{k}" for k in range(len(CLASSES))]), F.array(*[f"w{k}" for k in range(BINS)])
    one = "transform({0}, x -> x / aggregate({0}, 0L, (a, y) -> a + y))"
    return total.select("lang", c.alias("c"), w.alias("w")).select("lang", F.expr(one.format("c")).alias("classes_ref"), F.expr(one.format("w")).alias("bins_ref"))


def distance(mine: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts ``mine`` to the shares ``ref``."""
    p = mine / mine.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = np.where(p > 0, p / 2 * np.log2(2 * p / (p + ref)), 0), np.where(ref > 0, ref / 2 * np.log2(2 * ref / (p + ref)), 0)
    return np.sqrt(np.maximum(0, (left + right).sum(axis=1)))


def _far(histograms: pa.Array, refs: list) -> pa.Array:
    """Distances of a batch's histograms to each row's reference; null where either is."""
    out = np.full(len(histograms), np.nan)
    has = ~histograms.is_null().to_numpy(zero_copy_only=False)
    by: dict[int, list[int]] = {}
    for k in np.flatnonzero(has).tolist():
        if refs[k] is not None:
            by.setdefault(id(refs[k]), []).append(k)
    for own in by.values():
        rows = histograms.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
        out[own] = distance(rows, refs[own[0]])
    return pa.array(out, pa.float64(), mask=np.isnan(out))


def compared(rows: DataFrame, refs: DataFrame, most: int = LANGUAGES) -> DataFrame:
    """``rows`` of :func:`measured` with class_distance and word_distance.

    Up to ``most`` references (a kilobyte each) go to every worker, and no row moves; more are joined by language.
    """
    found = refs.limit(most + 1).collect()
    names = [c for c in rows.columns if c not in ("lang", "classes", "bins")]
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    pair = lambda r: (np.array(r["classes_ref"]), np.array(r["bins_ref"])) if r is not None and r["classes_ref"] is not None else None
    sent = rows.sparkSession.sparkContext.broadcast({r.lang: pair(r) for r in found}) if len(found) <= most else None

    def run(batches):
        for b in batches:
            if sent is not None:
                of = [sent.value.get(x) for x in b.column("lang").to_pylist()]
            else:
                of = [pair(r) for r in b.select(["classes_ref", "bins_ref"]).to_pylist()]
            far = [_far(b.column(c), [None if r is None else r[k] for r in of]) for k, c in enumerate(("classes", "bins"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *far], [*names, "class_distance", "word_distance"])

    both = rows if sent is not None else rows.join(refs, "lang", "left")
    return both.mapInArrow(run, f"{types}, class_distance double, word_distance double")


def judged(docs: DataFrame, limit: float = LIMIT, guard: int = GUARD_WORDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES) -> DataFrame:
    """The base counts, ``base_failed``, both distances and ``kept`` for every row.

    A null text has no words. A null language is a language of its own, the same as an empty one; a language without any
    document that the base rules and the guard keep has no reference, and no distance speaks against its documents. A
    language's reference is the corpus's own: where all of it is junk, junk is what its documents are compared with.
    Repeated rows get equal results; other columns are ignored, whatever their names; empty in, empty out.
    """
    rows = written(measured(docs, id_col, text_col, lang_col), "measured")
    both = compared(rows, references(rows), languages).withColumn("base_failed", base_failed())
    far = (F.col("n_words") >= guard) & (F.col("class_distance") + F.col("word_distance") > limit)
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"))
