import math
import re
import string
from collections import Counter

from tests.llm.rows import awkward, empty
from threadloom.llm import quality
from threadloom.llm.queries import op2_js_quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def plain_histograms(text):
    """Characters by class, and words by common word (0: any other), counted one by one."""
    def kind(c):
        for k, chars in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits, " \t\n\v\f\r", ".,;:!?'\"()-", "#*$%&|<>")):
            if c in chars:
                return k
        return 6 if c.isascii() else 7

    classes = [0] * 8
    for c, n in Counter(text).items():
        classes[kind(c)] += n
    common = sorted({w for words in quality.COMMON.values() for w in words.split()})
    bins = [0] * (len(common) + 1)
    for w, n in Counter(re.findall(r"[^\x20\x09-\x0D]+", text)).items():
        bare = w[:-1] if w[-1] in ",." else w
        bare = bare[0].lower() + bare[1:] if bare and bare == bare.capitalize() else bare
        bins[common.index(bare) + 1 if bare in common else 0] += n
    return classes, bins


def plain_verdicts(docs):
    """Everything again with dictionaries, from the rows of ``documents``."""
    facts, refs = [], {}
    for d in docs:
        n, chars, sym, dup, rep = plain(d.text)
        failed = n < 50 or 100 * rep > 50 * n
        classes, bins = plain_histograms(d.text or "")
        hist = [[int(x) * 1_000_000 // int(sum(h)) if sum(h) else None for x in h] for h in (classes, bins)]
        facts.append((d, (n, chars, sym, dup, rep), failed, hist))
        if not failed and n >= quality.GUARD_WORDS:
            at = refs.setdefault(d.lang or "", [[0] * len(hist[0]), [0] * len(hist[1])])
            for k in (0, 1):
                at[k] = [a + b for a, b in zip(at[k], hist[k], strict=True)]
    for d, base, failed, hist in facts:
        far = False
        ref = refs.get(d.lang or "")
        if ref and base[0] >= quality.GUARD_WORDS:
            total = 0
            for h, r in zip(hist, ref, strict=True):
                p, q = [x / sum(h) for x in h], [x / sum(r) for x in r]
                total += math.sqrt(max(0, sum((a / 2 * math.log2(2 * a / (a + b)) if a else 0) + (b / 2 * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True))))
            far = total > quality.LIMIT
        yield (-1 if d.doc_id is None else d.doc_id, *base, failed, not failed and not far)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in df.collect())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = rows_of(op2_js_quality(spark, sf))
    assert got == sorted(plain_verdicts(spark.read.parquet(f"{sf}/documents.parquet").collect()))


def test_good_documents_stay_and_symbol_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [r for r in op2_js_quality(spark, sf).collect() if not r.base_failed and r.doc_id in labels]
    good, junk = [[r.kept for r in judged if labels[r.doc_id] == q and r.n_words >= 100] for q in (1, 0)]
    assert sum(good) >= 0.99 * len(good) and sum(junk) <= 0.2 * len(junk)


def test_short_symbol_junk_goes_and_short_good_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [r for r in op2_js_quality(spark, sf).collect() if not r.base_failed and r.doc_id in labels and 50 <= r.n_words < 100]
    good, junk = [[r.kept for r in judged if labels[r.doc_id] == q] for q in (1, 0)]
    assert len(junk) == 29 and sum(junk) <= 0.2 * len(junk) and sum(good) >= 0.97 * len(good)


def test_awkward_rows(spark):
    rows = awkward(spark)
    assert rows_of(quality.judged(rows)) == sorted(plain_verdicts(rows.collect()))
    assert quality.judged(empty(spark)).count() == 0


def test_joined_references_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(quality.judged(docs, languages=0)) == rows_of(quality.judged(docs))


def test_no_row_moves_for_its_distances(spark, sf):
    plan = quality.judged(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
