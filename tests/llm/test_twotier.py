import base64
import hashlib
import random

import numpy as np
import pytest
import regex
import tiktoken

from threadloom.llm import twotier
from threadloom.llm.queries import op13_two_tier_bpe, tokenizer

from .rows import awkward, empty

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    with open(tokenizer("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(tokenizer("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return twotier.TwoTier(f.read())


def row(library, i, text):
    ids = library.encode_ordinary(text or "")
    return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def same(spark, df, docs, library):
    got = [tuple(r) for r in df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(map(repr, got)) == sorted(repr(row(library, r.doc_id, r.text)) for r in docs.select("doc_id", "text").collect())


def test_query(spark, library):
    sf = "/root/testdata/sf0.01"
    same(spark, op13_two_tier_bpe(spark, sf), spark.read.parquet(f"{sf}/documents.parquet"), library)


def test_awkward_rows(spark, library):
    docs = awkward(spark)
    same(spark, twotier.digests(docs, tokenizer("byte_bpe_multi_50k.tiktoken")), docs, library)
    assert twotier.digests(empty(spark), tokenizer("byte_bpe_multi_50k.tiktoken")).count() == 0


def test_random_texts(own, library):
    r = random.Random(1)
    bits = ["'", "'s", "'re", "'ll", "'LL", " ", "  ", "\n", "\t", "　", "\xa0", "\x1c", "\x85", "a", "the", "Über", "中文", "9", "½", "²", "́", "-", "''", "\U0001f600", "​", "\0"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(20_000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert b"".join(own.decode(ids)) == text.encode()


def test_every_code_point_is_cut_as_the_library_cuts(own, library):
    texts = [f"a{c}{c}1{c} {c}'s" for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)])]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        if ids.tolist() != library.encode_ordinary(text):
            # The libraries' Unicode tables may differ by a version; then the cutter must at least follow the pattern.
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            border = np.arange(len(points)) == 0
            begins = [m.start() for m in regex.finditer(P.PATTERN, text)]
            assert twotier.cuts(points, own.table, border).tolist() == begins, text


def test_long_texts_and_words(own, library):
    r = random.Random(2)
    long = "".join(r.choice(["lorem ", "'re", "x" * 50 + "\n", " 　 ", "é", "12 "]) for _ in range(400_000))
    word = "".join(r.choice("abcxyz") for _ in range(100_000))
    texts = [long, "", word, "short", long[:5]]
    assert len(long) > twotier.STRETCH and len(list(twotier.pieces(long, 1000))) > 100 and "".join(twotier.pieces(long, 1000)) == long
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)


def test_minimal_perfect_hash(own):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 100, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        assert sorted(twotier.Hash(keys).slots(keys).tolist()) == list(range(len(keys)))
    assert sorted(own.slot_id.tolist()) == sorted(own.ranks.values())


def test_heap_merges_as_the_plain_loop():
    r = random.Random(4)
    ranks = {bytes([c]): c for c in range(97, 101)}
    while len(ranks) < 60:
        a, b = r.sample(sorted(ranks), 2)
        ranks.setdefault(a + b, 200 + len(ranks))
    for _ in range(3000):
        word = bytes(r.choice(range(97, 101)) for _ in range(r.randrange(1, 14)))
        parts = [word[k : k + 1] for k in range(len(word))]
        while True:
            best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert twotier.merged(word, ranks) == [ranks[p] for p in parts]
