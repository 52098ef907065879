import hashlib
import os
import random

import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer

from tests.llm.rows import awkward, empty
from threadloom.llm import bpe
from threadloom.llm.queries import op3_prefix_bpe, tokenizer

LETTERS = list(" \t\n\r\x0b\x1c\x1f\x85\xa0  aAbBzZéñÑßİΣς你é3٣½①'’`sStTreREdml!?.,<|>\U0001f600​\x00") + ["<|endoftext|>", "'ll", "the", " and"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("kind", [bpe.PrefixBpe, bpe.RankBpe])
def test_ids_equal_the_library(name, kind, spark, sf):
    with open(tokenizer(name), "rb") as f:
        ours = bpe.model(f.read(), kind)
    theirs = Tokenizer.from_file(tokenizer(name))
    rng = random.Random(5)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["a" * 300, "ab" * 200, "the " * 500] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == ids, repr(t)
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False), repr(t)


def test_digests_on_awkward_rows(spark):
    theirs = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = awkward(spark)
    want = []
    for r in rows.collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r.doc_id or -1, *r[1:]) for r in bpe.digests(rows, tokenizer("word_bpe_49k.json")).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.digests(empty(spark), tokenizer("word_bpe_49k.json")).count() == 0


def test_query_covers_the_table(spark, sf):
    assert op3_prefix_bpe(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
