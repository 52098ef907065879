"""Byte-level BPE by ranks in two tiers, and decoding.

First tier: a pre-token that is in the vocabulary is one id. A minimal perfect hash (buckets displaced until every key has
a slot of its own) resolves all pre-tokens of a stretch of text at once, in numpy; a slot's key is compared byte by byte,
so a hit is exact. Second tier: a pre-token that misses is merged from its bytes, the pair of lowest rank first and of
equal ranks the leftmost, with a heap of candidate pairs over a linked list. Pre-tokens are cut from arrays of character
classes, by the rules of the public pattern.

A worker handles ``STRETCH`` characters at a time; a longer text is cut where no pre-token can cross, before white space
that follows something else. So memory is bounded, but for a text with no white space in it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WHITE, load
from .shared import ship, worker_object

#: What may follow an apostrophe that begins a pre-token.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = range(4)
STRETCH = 1 << 20
#: Misses that a worker remembers (a bound of memory; results don't depend on it).
MEMO = 300_000
_BASE = 0x9E3779B97F4A7C15
_BORDER = re.compile(rf"(?<=[^{WHITE}])[{WHITE}]")


def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{WHITE}]+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def cuts(points: np.ndarray, table: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in an array of code points; ``border`` is true where a text begins.

    Classes change there, but for three rules. White space keeps to itself but for its last character, which goes with what
    follows if it is a blank, and else stands alone. An apostrophe that begins a pre-token and is the whole of its run takes
    a contraction's letters, and what follows them is a pre-token again.
    """
    n = len(points)
    kind = table[points]
    starts = border.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~border[1:])  # the last white space before something else
    starts[last] = True
    starts[last[points[last] == 0x20] + 1] = False
    marks = np.flatnonzero((points == 0x27) & starts)
    marks = marks[marks + 1 < n]
    marks = marks[kind[marks + 1] == LETTER]
    for word in CONTRACTIONS:
        own = marks[marks + len(word) < n]
        for k, c in enumerate(word, 1):
            own = own[(points[own + k] == ord(c)) & ~border[own + k]]
        starts[own + 1] = False
        after = own + 1 + len(word)
        starts[after[after < n]] = True
    return np.flatnonzero(starts)


def pieces(text: str, most: int = STRETCH):
    """A long text in stretches that no pre-token crosses."""
    at = 0
    while len(text) - at > most:
        border = _BORDER.search(text, at + most)
        if not border:
            break
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


def mixed(h: np.ndarray, seed) -> np.ndarray:
    h = (h ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hash:
    """A minimal perfect hash of distinct 64-bit values: ``slots(h)`` is a permutation of 0 .. n - 1 over them."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, n // 4 + 1
        self.moves = np.zeros(self.buckets, np.int64)
        bucket = (mixed(keys, 1) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            m = sizes[b]
            if m < 2:
                break
            own, move = keys[order[ends[b] - m : ends[b]]], 0
            while True:
                tries = np.arange(move + 1, move + 257, dtype=np.uint64)
                at = mixed(own[None, :] ^ (tries[:, None] * np.uint64(_BASE)), 2) % np.uint64(n)
                ok = free[at.astype(np.int64)].all(axis=1)
                for row in np.flatnonzero(ok):
                    if len(set(at[row].tolist())) == m:
                        break
                else:
                    move += 256
                    continue
                self.moves[b] = move + 1 + row
                free[at[row].astype(np.int64)] = False
                break
        rest = np.flatnonzero(sizes == 1)
        self.moves[rest] = -1 - np.flatnonzero(free)[: len(rest)]  # a bucket of one key names its slot

    def slots(self, h: np.ndarray) -> np.ndarray:
        move = self.moves[(mixed(h, 1) % np.uint64(self.buckets)).astype(np.int64)]
        at = mixed(h ^ (move.astype(np.uint64) * np.uint64(_BASE)), 2) % np.uint64(self.n)
        return np.where(move < 0, -1 - move, at.astype(np.int64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64, and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(b))]), dtype=np.uint64) for b in (_BASE, inverse))


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of many slices, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: candidate pairs in a heap, the tokens so far in a linked list."""
    n = len(word)
    end = list(range(1, n + 1))  # of the token that begins here; 0 once it has gone
    before = list(range(-1, n - 1))
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapify(heap)
    while heap:
        _, a, stop = heappop(heap)
        b = end[a]
        if not b or b >= n or end[b] != stop:  # one of the two has changed since
            continue
        end[a], end[b] = stop, 0
        if stop < n:
            before[stop] = a
            if (r := ranks.get(word[a : end[stop]])) is not None:
                heappush(heap, (r, a, end[stop]))
        left = before[a]
        if left >= 0 and (r := ranks.get(word[left:stop])) is not None:
            heappush(heap, (r, left, stop))
    out, k = [], 0
    while k < n:
        out.append(ranks[word[k : end[k]]])
        k = end[k]
    return out


class TwoTier:
    """The encoder of one file of ranks (a token in base64 and its rank on each line)."""

    def __init__(self, spec: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in spec.splitlines() if line.strip())}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a byte has no rank")
        self.table = classes()
        tokens = sorted(self.ranks, key=self.ranks.get)
        sizes = np.array([len(t) for t in tokens], np.int64)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        self.power, self.inverse = powers(max(4096, int(sizes.max()) + 1))
        keys = self.hashes(data, np.cumsum(sizes) - sizes, sizes)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two tokens have one hash")
        self.hash = Hash(keys)
        # By slot: id and where its bytes are. By id: the same for decoding.
        ids = np.array([self.ranks[t] for t in tokens], np.int64)
        slot = self.hash.slots(keys)
        self.data, self.slot_id, self.slot_at, self.slot_size = data, np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        self.slot_id[slot], self.slot_at[slot], self.slot_size[slot] = ids, np.cumsum(sizes) - sizes, sizes
        self.at, self.size = np.zeros(ids.max() + 1, np.int64), np.zeros(ids.max() + 1, np.int64)
        self.at[ids], self.size[ids] = np.cumsum(sizes) - sizes, sizes
        self.memo: dict[bytes, np.ndarray] = {}

    def hashes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A polynomial hash of each slice of ``data``, from one running sum."""
        if len(data) >= len(self.power):
            self.power, self.inverse = powers(2 * len(data))
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)])
            return (sums[starts + sizes] - sums[starts]) * self.inverse[starts] + sizes.astype(np.uint64)

    def slow(self, word: bytes) -> np.ndarray:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = np.array(merged(word, self.ranks), np.uint32)
        return found

    def stretch(self, text: str, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that stand one after another, ``begins`` saying where, and the id that each text begins with."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(begins), np.int64)
        border = np.zeros(len(points), bool)
        border[begins[begins < len(points)]] = True
        begin = cuts(points, self.table, border)
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        if len(raw) == len(points):
            starts = begin
        else:
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            starts = (np.cumsum(width) - width)[begin]
        sizes = np.diff(np.append(starts, len(raw)))
        slot = self.hash.slots(self.hashes(data, starts, sizes))
        hit = np.flatnonzero(self.slot_size[slot] == sizes)
        own, of = sizes[hit], slot[hit]
        same = data[gather(starts[hit], own)] == self.data[gather(self.slot_at[of], own)]
        hit = hit[np.logical_and.reduceat(same, np.cumsum(own) - own)] if len(hit) else hit
        counts = np.zeros(len(starts), np.int64)
        counts[hit] = 1
        miss = np.flatnonzero(counts == 0)
        # Pre-tokens that miss are merged once each: first by hash, then by their bytes.
        words = [raw[a : a + n] for a, n in zip(starts[miss].tolist(), sizes[miss].tolist(), strict=True)]
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        parts = [self.slow(w) for w in known]
        lengths = np.array([len(p) for p in parts], np.int64)
        counts[miss] = lengths[which] if len(miss) else 0
        at = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.uint32)
        ids[at[hit]] = self.slot_id[slot[hit]]
        if len(miss):
            pool = np.concatenate(parts)
            ids[gather(at[miss], counts[miss])] = pool[gather((np.cumsum(lengths) - lengths)[which], lengths[which])]
        return ids, np.append(at, len(ids))[np.searchsorted(begin, begins)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; short texts share a stretch."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        group, total = [], 0

        def together():
            sizes = [len(texts[k]) for k in group]
            ids, at = self.stretch("".join([texts[k] for k in group]), np.cumsum(sizes) - sizes)
            for k, some in zip(group, np.split(ids, at[1:]), strict=True):
                out[k] = some

        for k, text in enumerate(texts):
            if len(text) > STRETCH:
                out[k] = np.concatenate([self.stretch(part, np.zeros(1, np.int64))[0] for part in pieces(text)])
                continue
            group.append(k)
            total += len(text)
            if total > STRETCH:
                together()
                group, total = [], 0
        if group:
            together()
        return out

    def decode(self, ids: np.ndarray):
        """The bytes of ids, some at a time."""
        for k in range(0, len(ids), STRETCH // 4):
            some = ids[k : k + STRETCH // 4]
            yield self.data[gather(self.at[some], self.size[some])].tobytes()


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text by the file of ranks at ``path``: ``id_col``, n_tokens, ids_sha256, decoded_sha256.

    The digests are of the ids as little-endian 32-bit integers and of the decoded bytes. A null text counts as empty;
    repeated rows give repeated results; other columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    spec = load(docs.sparkSession, path)  # a vocabulary file, a MB or so whatever the corpus
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        bpe = model(spec.value)
        for b in batches:
            n, ids_, decoded = [], [], []
            for ids in bpe.encode(b.column("text").to_pylist()):
                h = hashlib.sha256()
                for some in bpe.decode(ids):
                    h.update(some)
                n.append(len(ids))
                ids_.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model(spec: bytes) -> TwoTier:
    """The encoder of a file of ranks, built once per Python worker."""
    return worker_object((hashlib.sha256(spec).digest(), "two tiers"), lambda: TwoTier(spec))
