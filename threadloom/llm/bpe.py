"""BPE encoding by per-prefix dynamic programming, and decoding.

A byte-pair encoder joins the adjacent pair with the lowest merge rank, leftmost first, until nothing joins. The same
ids come out of a left-to-right pass: for every prefix of a word exactly one token can stand last, and it is the one
whose predecessor (the last token of the shorter prefix) is *compatible* with it, which means that encoding the two side
by side would not join anything across their border. An automaton over the vocabulary lists the tokens that end at each
place; the compatible one is stored per prefix, and following the back-pointers from the end of the word emits the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship, worker_object

#: The white space of the tokenizer files' regular expressions (Unicode White_Space).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What Python's str.split() cuts at besides.
_EXTRA = re.compile("[\x1c-\x1f]")
#: The two pre-tokenizer patterns that the public files use.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

_ANY_CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_ASCII_CHUNK = re.compile(r" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_ANY_WORD = re.compile(rf"[^{WHITE}]+")
#: Marks that a word's end is tried without first.
_MARKS = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
#: Entries that a worker's memo of words may hold before it starts anew (a bound of memory; results don't depend on it).
MEMO_ENTRIES = 500_000
PAIR_ENTRIES = 500_000
STEP_ENTRIES = 600_000


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies use for each byte, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(spare)}


class _Memo(dict):
    """Words already encoded; a missing one is made on demand."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class PrefixBpe:
    """One tokenizer file (JSON bytes), for the two layouts described in the public tokenizers' README.

    * byte-level: text is cut by BYTE_PATTERN, blanks included; decoding joins the tokens' bytes.
    * word ends: NFC, lower case, white space dropped, WORD_PATTERN; the last byte of a word carries the suffix; no
      decoder is declared, so decoding joins token strings by a blank.

    Special tokens' strings in a text become their ids, as the tokenizers library does by default.
    """

    def __init__(self, spec: bytes):
        d = json.loads(spec)
        model = d["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self._check(d, suffix)
        self.words, self.suffix = bool(suffix), suffix
        letters = byte_letters()

        def inner(token: str) -> str:
            end = bool(suffix) and token.endswith(suffix) and token != suffix
            body = [letters[c] for c in (token[: -len(suffix)] if end else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * end)

        self.tokens = {i: t for t, i in vocab.items()}
        rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joins: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if k in rank:
                raise ValueError("a token made by two merge rules has no unique last token")
            rank[k], self.parts[k], self.joins[i << 20 | j] = r, (i, j), r
        self.rank = rank
        made = {*rank, *(i for t, i in vocab.items() if len(inner(t)) == 1)}
        self.size_of = {i: len(inner(t)) for t, i in vocab.items() if i in made}
        self._special_ids = [t["id"] for t in d.get("added_tokens") or []]
        self._prepare({inner(t): i for t, i in vocab.items() if i in made})
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens") or []}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.wide = max(self.tokens) > 0xFFFF
        self._letters = letters
        self._code = {i: i.to_bytes(4 if self.wide else 2, "little") for i in self.tokens}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._split = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN)
        self._pairs: dict[int, bool] = {}
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self.packed = _Memo(self._packed)
        self.strings = _Memo(self._strings)
        self._known_strings = _Memo(self._part_strings)

    @staticmethod
    def _check(d: dict, suffix: str) -> None:
        kinds = [x["type"] for x in (d.get("normalizer") or {}).get("normalizers", [])]
        pre = d["pre_tokenizer"]
        parts = pre.get("pretokenizers", [pre])
        want = ["NFC", "Replace", "Lowercase"] if suffix else []
        if d["model"]["type"] != "BPE" or kinds != want or parts[-1]["type"] != "ByteLevel" or parts[-1].get("add_prefix_space"):
            raise ValueError("this tokenizer layout is not known")
        if d["model"].get("ignore_merges") or d["model"].get("dropout") or (suffix and parts[0]["pattern"]["Regex"] != WORD_PATTERN):
            raise ValueError("this tokenizer layout is not known")

    def _prepare(self, patterns: dict[str, int]) -> None:
        """A trie over the tokens with suffix links; ``ends[state]`` lists the tokens that end there, longest first.

        ``step`` maps state * 512 + symbol to a state; moves that follow suffix links are added as they are met.
        """
        step: dict[int, int] = {}
        own: list[tuple[int, int] | None] = [None]
        for key, token in patterns.items():
            at = 0
            for c in key:
                to = step.get(at * 512 + ord(c))
                if to is None:
                    to = step[at * 512 + ord(c)] = len(own)
                    own.append(None)
                at = to
            own[at] = (token, len(key))
        link = [0] * len(own)
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        children: dict[int, list[tuple[int, int]]] = {}
        for k, to in step.items():
            children.setdefault(k // 512, []).append((k % 512, to))
        level = [0]
        while level:
            deeper = []
            for at in level:
                for c, to in children.get(at, ()):
                    back = link[at]
                    while back and back * 512 + c not in step:
                        back = link[back]
                    link[to] = step.get(back * 512 + c, 0) if at else 0
                    ends[to] = ((own[to],) if own[to] else ()) + ends[link[to]]
                    deeper.append(to)
            level = deeper
        self._step, self._link, self._ends = step, link, ends

    def _move(self, at: int, c: int) -> int:
        step, back = self._step, at
        while back and back * 512 + c not in step:
            back = self._link[back]
        to = step.get(back * 512 + c, 0)
        if len(step) < STEP_ENTRIES:
            step[at * 512 + c] = to
        return to

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stood at one end of ``token`` while it was built, each with the rank that ended it."""
        memo = self._left if side == 0 else self._right
        if token not in memo:
            out, until, t = [], float("inf"), token
            while True:
                out.append((t, until))
                if t not in self.parts:
                    break
                until, t = self.rank[t], self.parts[t][side]
            memo[token] = out
        return memo[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding a's and b's bytes side by side leaves the two tokens as they are.

        A merge across the border happens if its rank comes before both neighbours there are used up; at equal ranks the
        pair further left goes first.
        """
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            joins = self.joins
            known = not any((r := joins.get(x << 20 | y)) is not None and r < ends_x and r <= ends_y for x, ends_x in self._spine(a, 1) for y, ends_y in self._spine(b, 0))
            if len(self._pairs) >= PAIR_ENTRIES:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def encode_word(self, symbols: Iterable[int]) -> list[int]:
        """Ids of one pre-token, given as bytes (256 more for one that ends a word)."""
        last, sizes = [-1], [0]
        pairs, step, ends, at = self._pairs, self._step, self._ends, 0
        for end, c in enumerate(symbols, 1):
            to = step.get(at * 512 + c)
            at = self._move(at, c) if to is None else to
            for token, n in ends[at]:
                if n == end:
                    break
                key = last[end - n] << 20 | token
                ok = pairs.get(key)
                if self.compatible(last[end - n], token) if ok is None else ok:
                    break
            last.append(token)
            sizes.append(n)
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= sizes[end]
        return out[::-1]

    def _parts(self, chunk: str) -> list[str]:
        """Pre-tokens of a stretch as :meth:`_ids` describes it."""
        if not chunk.isascii():
            return self._split.findall("".join(c.lower() for c in unicodedata.normalize("NFC", chunk)) if self.words else chunk)
        if not self.words:
            return [chunk] if chunk[1:].isalpha() and chunk[0] != "'" else self._split.findall(chunk)
        chunk = chunk.lower()
        word = chunk.rstrip(_MARKS)
        if not word.isalpha():
            return self._split.findall(chunk)
        return [chunk] if len(word) == len(chunk) else [word, chunk[len(word) :]]

    def _part_ids(self, part: str) -> list[int]:
        symbols = [*part.encode("utf-8", "replace")]
        if self.words:
            symbols[-1] += 256
        return self.encode_word(symbols)

    def _ids(self, chunk: str) -> list[int]:
        """Ids of a stretch between white space (word ends), or with the blank before it (byte-level)."""
        return [i for part in self._parts(chunk) for i in self._part_ids(part)]

    def _packed(self, chunk: str) -> bytes:
        code = self._code
        return b"".join([code[i] for i in self._ids(chunk)])

    def _strings(self, chunk: str) -> tuple[str, str]:
        known = self._known_strings
        if len(known) > MEMO_ENTRIES // 2:
            known.clear()
        found = [known[part] for part in self._parts(chunk)]
        return found[0] if len(found) == 1 else (" ".join([f[0] for f in found]), " ".join([f[1] for f in found]))

    def _part_strings(self, part: str) -> tuple[str, str]:
        ids, tokens = self._part_ids(part), self.tokens
        return " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])

    def chunks(self, text: str) -> list[str]:
        """Cuts where no pre-token can cross, so that the stretches can be encoded, and remembered, one by one."""
        if self.words:
            return _ANY_WORD.findall(text) if _EXTRA.search(text) else text.split()
        return (_ASCII_CHUNK if text.isascii() else _ANY_CHUNK).findall(text)

    def _segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        if self._cut is None or "<|" not in text:
            yield text, None
            return
        for part in self._cut.split(text):
            if part in self.special:
                yield part, self.special[part]
            elif part:
                yield part, None

    def ids_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned integers of 2 bytes, or of 4 where the vocabulary needs them (``wide``)."""
        memo = self.packed
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        out = [b"".join(map(memo.__getitem__, self.chunks(part))) if i is None else i.to_bytes(4 if self.wide else 2, "little") for part, i in self._segments(text)]
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> list[int]:
        step = 4 if self.wide else 2
        raw = self.ids_bytes(text)
        return [int.from_bytes(raw[k : k + step], "little") for k in range(0, len(raw), step)]

    def both_strings(self, text: str) -> tuple[str, str]:
        """The decimal ids and, for a word-end file, the decoded text, each joined by one blank."""
        memo = self.strings
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        found = [v for part, i in self._segments(text) for v in (map(memo.__getitem__, self.chunks(part)) if i is None else [(str(i), part)])]
        return " ".join([v[0] for v in found]), " ".join([v[1] for v in found])

    def decode(self, ids: Iterable[int]) -> str:
        """Special tokens stay; bytes that are no UTF-8 become U+FFFD."""
        if self.words:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)
        letters, out = self._letters, bytearray()
        for i in ids:
            token = self.tokens.get(i, "")
            if all(c in letters for c in token):
                out += bytes(letters[c] for c in token)
            else:
                out += token.encode()
        return out.decode("utf-8", "replace")


class RankBpe(PrefixBpe):
    """The same ids by tiktoken's compiled merge loop, for operators whose subject is what happens to the ids.

    A byte that UTF-8 never uses marks the end of a word: joining it to the byte before it ranks first of all, which
    gives the suffixed byte that the word-end file starts from.
    """

    def _prepare(self, patterns: dict[str, int]) -> None:
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)}
        if self.words:
            ranks |= {bytes([b, 0xFF]): 256 + b for b in range(255)}
        names = {}
        for key, token in patterns.items():
            raw = bytes(ord(c) & 0xFF for c in key) + (b"\xff" if ord(key[-1]) > 255 else b"")
            if token in self.rank:
                ranks[raw] = 512 + self.rank[token]
            elif raw in ranks:
                names[ranks[raw]] = token
        self._names = names | {512 + r: t for t, r in self.rank.items()}
        wide = max(self.tokens) > 0xFFFF or max(self._special_ids, default=0) > 0xFFFF
        self._coded = {r: t.to_bytes(4 if wide else 2, "little") for r, t in self._names.items()}
        self._known = _Memo(self._packed_part)
        self._piece = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def _ids(self, chunk: str) -> list[int]:
        names, piece, end = self._names, self._piece, b"\xff" if self.words else b""
        return [names[i] for part in self._parts(chunk) for i in piece(part.encode("utf-8", "replace") + end)]

    def _packed(self, chunk: str) -> bytes:
        known = self._known
        if len(known) > MEMO_ENTRIES // 2:
            known.clear()
        return b"".join([known[part] for part in self._parts(chunk)])

    def _packed_part(self, part: str) -> bytes:
        code = self._coded
        return b"".join([code[i] for i in self._piece(part.encode("utf-8", "replace") + (b"\xff" if self.words else b""))])


def model(spec: bytes, kind: type[PrefixBpe] = PrefixBpe) -> PrefixBpe:
    """The encoder for a tokenizer file, built once per Python worker."""
    return worker_object((hashlib.sha256(spec).digest(), kind.__name__), lambda: kind(spec))


def width_of(spec: bytes) -> int:
    """Bytes that an id of a tokenizer file takes, 2 or 4."""
    d = json.loads(spec)
    return 4 if max([*d["model"]["vocab"].values(), *(t["id"] for t in d.get("added_tokens") or [])]) > 0xFFFF else 2


def load(spark: SparkSession, path: str):
    """The tokenizer file at ``path`` as a broadcast; such files are a few MB whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; ``id_col``, n_tokens, ids_sha256 and decoded_sha256.

    A null text counts as empty (no ids, digests of the empty string); repeated rows give repeated results; other
    columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = load(spark, path)
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        bpe = model(spec.value)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                ids_text, decoded = bpe.both_strings(text)
                if not bpe.words:
                    decoded = bpe.decode(bpe.encode(text))
                n.append(ids_text.count(" ") + 1 if ids_text else 0)
                a.append(sha(ids_text.encode()).hexdigest())
                b.append(sha(decoded.encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's ids: ``id_col`` and ``ids array<int>``, for callers that want the ids themselves (nulls: empty)."""
    spark = docs.sparkSession
    ship(spark)
    spec = load(spark, path)
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        bpe = model(spec.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.encode(t.as_py() or "") for t in batch.column("text")], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return ids.mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, ids array<int>")
