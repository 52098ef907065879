"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with borders), each hashed to a bucket with an embedding vector; a word's vector
is their mean, and a text's vector the sum over its distinct words, divided by ``LEAST + n ** POWER`` for n of them: an
average that does not dilute a few telling words in a long text quite so much. A linear softmax over it gives the class.
Unseen misspellings and endings share n-grams with words that were seen.

The embeddings start from what the labelled texts say about each n-gram alone: its log-odds of occurring in a toxic text,
shrunk to nothing where the difference is within chance. Descent on the cross-entropy then moves embeddings and softmax
jointly. Scale and shift of the log-odds come from texts that a fit has not seen, fold by fold, so few labels do as well.
Everything before the softmax is a sum over words, so a word adds one number, which scoring remembers.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, ship, spare, worker_object

#: How a text's length divides the sum over its words.
LEAST, POWER = 8, 0.75
BUCKETS = 1 << 17
GRAMS = (3, 4, 5, 6)
#: N-grams that a fit works on at a time.
_GRAMS = 1 << 20
#: Rows of each class that a fit takes at most, and the longest text (code points) it takes: the bound of its memory.
FIT_ROWS, FIT_CHARS = 3000, 8_000
#: Scores that a worker remembers before it starts anew (a bound of memory; results don't depend on it).
MEMO_ENTRIES = 300_000
THRESHOLD = 0.3
#: Folds of the calibration, standard errors that count as chance, and the descent: chosen by cross-validation inside the
#: training rows of three tables. A step is ``RATE`` times the root of the number of texts in the smaller class.
FOLDS, CHANCE, EPOCHS, RATE, FLOOR = 4, 3.0, 20, 0.008, 0.5

#: Marks at a word's ends that are no part of it.
_EDGE = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x40), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def core(word: str) -> str:
    """A word without the marks at its ends; marks alone stay."""
    return word.strip(_EDGE) or word


def grams(word: str) -> list[int]:
    """Buckets of a word's n-grams; at least one for any word."""
    w = f"<{core(word)}>"
    raw = w.encode("utf-8", "replace")
    n, crc = len(w), zlib.crc32
    if len(raw) == n:
        out = [crc(raw[i : i + k]) % BUCKETS for k in GRAMS for i in range(n - k + 1)]
    else:
        out = [crc(w[i : i + k].encode("utf-8", "replace")) % BUCKETS for k in GRAMS for i in range(n - k + 1)]
    out.append(crc(raw) % BUCKETS)
    return out


@dataclass
class Model:
    embedding: np.ndarray  # buckets x width
    weights: np.ndarray  # width x 2
    bias: np.ndarray  # 2

    def margins(self) -> np.ndarray:
        """What each bucket adds to the log-odds of the toxic class, before averaging."""
        return (self.embedding.astype(np.float64) @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)


def length_of(n):
    """What the sum over ``n`` distinct words is divided by."""
    return LEAST + n**POWER


class _Corpus:
    """The fitting texts as (text, distinct word) pairs and the words' n-gram buckets."""

    def __init__(self, texts: list[str]):
        vocab: dict[str, int] = {}
        docs = [np.array([vocab.setdefault(x, len(vocab)) for x in dict.fromkeys(words_of(t))], np.int32) for t in texts]
        bags, sizes = array("i"), array("i")
        for x in vocab:
            before = len(bags)
            bags.extend(grams(x))
            sizes.append(len(bags) - before)
        self.flat, self.sizes = np.frombuffer(bags, np.int32), np.frombuffer(sizes, np.int32).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.count = np.array([len(d) for d in docs])
        self.word, self.doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), self.count)
        self.share = (1 / length_of(self.count))[self.doc]

    def _buckets(self, words: np.ndarray) -> np.ndarray:
        """Buckets of the words, one after the other."""
        n = self.sizes[words]
        return self.flat[np.repeat(self.first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def holding(self, group: np.ndarray, groups: int, most: int = _GRAMS // 4) -> np.ndarray:
        """Texts of each group (rows) that hold each bucket (columns); about ``most`` n-grams are worked on at a time."""
        out, ends = np.zeros((groups, BUCKETS), np.int32), np.cumsum(self.count)
        total = np.cumsum(np.add.reduceat(self.sizes[self.word], ends - self.count))  # every text has a word
        k = 0
        while k < len(group):
            last = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + most, "right")))
            own = slice(ends[k] - self.count[k], ends[last - 1])
            words = self.word[own]
            key = np.unique(np.repeat(self.doc[own], self.sizes[words]) * BUCKETS + self._buckets(words))
            np.add.at(out, (group[key // BUCKETS], key % BUCKETS), 1)
            k = last
        return out

    def _parts(self):
        """Runs of words with about a million n-grams: first and last word, first and last place in ``flat``."""
        ends = self.first + self.sizes
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, self.first[i] + _GRAMS, "right")))
            yield i, j, self.first[i], ends[j - 1]
            i = j

    def margins(self, q: np.ndarray) -> np.ndarray:
        words = np.empty(len(self.sizes))
        for i, j, a, z in self._parts():
            words[i:j] = np.add.reduceat(q[self.flat[a:z]], self.first[i:j] - a) / self.sizes[i:j]
        return np.bincount(self.doc, words[self.word] * self.share, len(self.count))

    def pull(self, g: np.ndarray) -> np.ndarray:
        """What a gradient of the texts' margins is for each bucket."""
        per = np.bincount(self.word, g[self.doc] * self.share, len(self.sizes)) / self.sizes
        out = np.zeros(BUCKETS)
        for i, j, a, z in self._parts():
            out += np.bincount(self.flat[a:z], np.repeat(per[i:j], self.sizes[i:j]), BUCKETS)
        return out


def _odds(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-odds of each bucket, from the numbers of texts that hold it, shrunk to 0 below ``CHANCE`` standard errors."""
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    p = (toxic + clean + 0.5) / (n1 + n0 + 1)
    z = (toxic / n1 - clean / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return odds * np.clip((np.abs(z) - CHANCE) / 2, 0, 1) * (toxic + clean > 0)


def _descend(corpus: _Corpus, y: np.ndarray, seen: np.ndarray, start: np.ndarray, width: int, epochs: int, rate: float, seed: int):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(0, 0.01, (BUCKETS, width)), rng.normal(0, 0.01, (width, 2))
    e[:, 0] += start
    w[0] = -0.5, 0.5
    margin = corpus.margins(e @ (w[:, 1] - w[:, 0]))
    middle = (margin[seen & (y == 1)].mean() + margin[seen & (y == 0)].mean()) / 2
    spread = max(1e-9, margin[seen].std())
    w /= spread
    b = np.array([middle, -middle]) / spread / 2
    rate *= math.sqrt(min((seen & (y == 1)).sum(), (seen & (y == 0)).sum()))
    weight = seen * np.where(y == 1, 0.5 / (seen & (y == 1)).sum(), 0.5 / (seen & (y == 0)).sum())
    for epoch in range(epochs):
        d = w[:, 1] - w[:, 0]
        p = 1 / (1 + np.exp(-np.clip(corpus.margins(e @ d) + b[1] - b[0], -40, 40)))
        g = (p - y) * weight
        coef = corpus.pull(g)
        coef = np.sign(coef) * np.maximum(0, np.abs(coef) - FLOOR * np.abs(coef).max())  # rare n-grams of the fitting texts stay put
        toward = coef @ e
        pace = rate * (1 - epoch / epochs)
        e -= pace * np.outer(coef / max(1e-12, np.abs(coef).max()), d / max(1e-12, np.abs(d).max()))
        w += 0.02 * pace * np.abs(d).max() * np.stack([toward, -toward], 1) / max(1e-12, np.abs(toward).max())
        b += pace * np.array([g.sum(), -g.sum()])
    return e, w, b


def fit(texts: list[str], toxic: np.ndarray, width: int = 8, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Model:
    """A model of the texts and their classes; the same rows in the same order give the same model.

    Texts without words are left out. Without at least one text of each class, every text with a word gets the same low score.
    """
    keep = [i for i, t in enumerate(texts) if t and words_of(t)]
    y = np.asarray(toxic, np.int64)[keep] if len(texts) else np.zeros(0, np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((BUCKETS, width)), np.zeros((width, 2)), np.array([2.0, -2.0]))
    texts = [texts[i] for i in keep]
    corpus = _Corpus(texts)
    rank = np.zeros(len(y), np.int64)
    for k in (0, 1):  # every fold gets its part of each class
        rank[y == k] = np.arange((y == k).sum())
    fold = rank % FOLDS
    held = corpus.holding(2 * fold + y, 2 * FOLDS)

    def learn(seen, parts):
        n1, n0 = (seen & (y == 1)).sum(), (seen & (y == 0)).sum()
        if not n1 or not n0:
            return np.zeros((BUCKETS, width)), np.zeros((width, 2)), np.zeros(2)
        start = _odds(held[[2 * k + 1 for k in parts]].sum(axis=0), held[[2 * k for k in parts]].sum(axis=0), n1, n0)
        return _descend(corpus, y, seen, start, width, epochs, rate, seed)

    margin = np.zeros(len(y))
    for k in range(FOLDS):
        e, w, b = learn(fold != k, [x for x in range(FOLDS) if x != k])
        margin[fold == k] = (corpus.margins(e @ (w[:, 1] - w[:, 0])) + b[1] - b[0])[fold == k]
    scale, shift = _calibrate(margin, y)
    e, w, b = learn(np.ones(len(y), bool), range(FOLDS))
    shift += scale * (b[1] - b[0])
    return Model(e, w * scale, np.array([-shift / 2, shift / 2]))


def _calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Scale and shift of the log-odds by Newton steps on texts that the descent didn't see."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    spread = max(1e-9, margin.std())
    x[:, 0] = (margin - margin.mean()) / spread
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        a -= 0.7 * np.linalg.solve(h, x.T @ (p - t) + 1e-3 * a)
    a[0] = max(a[0], 1e-3)
    return a[0] / spread, a[1] - a[0] * margin.mean() / spread


class Scorer:
    """Scores texts with a fitted model; remembers words."""

    def __init__(self, margins: np.ndarray, bias: float):
        outer = self

        class Cores(dict):
            def __missing__(self, word):
                of = grams(word)
                value = self[word] = sum(map(outer.values.__getitem__, of)) / len(of)
                return value

        class Memo(dict):
            def __missing__(self, word):
                value = self[word] = outer.cores[core(word)]
                return value

        self.values, self.bias, self.cores, self.memo = margins.tolist(), bias, Cores(), Memo()

    def __call__(self, text: str) -> float:
        """Probability of the toxic class; 0 for a text without words, which has nothing toxic in it."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
            self.cores.clear()
        words = dict.fromkeys(words_of(text))  # distinct, in the order they come, so that sums are the same each time
        if not words:
            return 0.0
        margin = sum(map(self.memo.__getitem__, words)) / length_of(len(words)) + self.bias
        return float(1 / (1 + math.exp(-max(-40.0, min(40.0, margin)))))


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``i, text, toxic``: up to ``rows`` labelled rows of each class outside the held-out quarter, the same ones each time.

    Rows with a null text, label or id, and texts longer than ``chars``, aren't taken. An id labelled both ways is toxic; of
    several texts under one id the first in order is taken. Other columns are ignored.
    """
    marked = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("toxic")).where("i is not null and toxic in (0, 1)")
    marked = marked.where(~_held(F.col("i"))).groupBy("i").agg(F.max("toxic").alias("toxic"))
    lengths = docs.select(F.col(id_col).alias("i"), F.char_length(text_col).alias("n")).where(F.col("n") <= chars)
    both = lengths.join(marked, "i").select("i", "toxic").distinct()
    order = [F.xxhash64("i"), F.col("i")]
    chosen = both.where("toxic = 1").orderBy(*order).limit(rows).union(both.where("toxic = 0").orderBy(*order).limit(rows))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).where(F.char_length("text") <= chars)
    return texts.join(F.broadcast(chosen), "i").groupBy("i").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))  # 2 * rows ids at most


def _held(i):
    return F.coalesce(F.crc32(i.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, **names) -> Model:
    """The model of :func:`sample`'s rows, fitted in one task (``2 * FIT_ROWS`` texts of ``FIT_CHARS`` at most, whatever the
    corpus), so that the driver holds nothing but the result, 8 MB.

    The same tables give the same model, however they are partitioned. Without any row of one class nothing is learned, and
    every text with a word scores the same.
    """
    ship(docs.sparkSession)

    def run(batches):
        spare()
        found = sorted((zlib.crc32(str(i).encode()), str(i), t, x) for b in batches for i, t, x in zip(*(b.column(c).to_pylist() for c in ("i", "text", "toxic")), strict=True))
        m = fit([r[2] for r in found], np.array([r[3] for r in found]))
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, np.float64).tobytes()], pa.binary()) for x in (m.embedding, m.weights, m.bias)], ["embedding", "weights", "bias"])

    made = sample(docs, labels, **names).repartition(1).mapInArrow(run, "embedding binary, weights binary, bias binary").first()
    if made is None:  # no row at all, and so no task
        return fit([], np.array([]))
    embedding, weights, bias = (np.frombuffer(bytes(x), np.float64) for x in made)
    return Model(embedding.reshape(BUCKETS, -1), weights.reshape(-1, 2), bias)


def scores(docs: DataFrame, fitted: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the columns named in ``keep``, for every row.

    A null text counts as empty and scores 0; repeated rows get equal scores; a null id is not held out; empty in, empty out.
    Columns that are not kept are ignored, whatever their names; a kept one must not be called as one of the results.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((fitted.margins(), float(fitted.bias[1] - fitted.bias[0])))  # 1 MB, whatever the corpus
    key = hashlib.sha256(sent.value[0].tobytes()).digest()
    if clash := {c.lower() for c in keep} & {"doc_id", "held_out", "score", "predicted"}:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    read = text_col if text_col in keep else fresh(docs, "read")  # a text that is kept is sent once
    rows = docs.select(F.col(id_col).alias("doc_id"), _held(F.col(id_col)).alias("held_out"), *[F.col(text_col).alias(read)][: read not in keep], *[F.col(c) for c in keep])

    def run(batches):
        score = worker_object(key, lambda: Scorer(*sent.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                s = [score(t.as_py() or "") for t in batch.column(read)]
                kept = [batch.column(c) for c in ("doc_id", "held_out", *keep)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "held_out", *keep, "score", "predicted"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != read or read in keep)
    return rows.mapInArrow(run, f"{types}, score double, predicted int")
