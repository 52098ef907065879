import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.llm import fixity
from threadloom.llm.queries import op9_merkle_fixity


def plain_record(key, url, html):
    data, url = (html or "").encode(), url or ""
    h = hashlib.sha256(("" if key is None else str(key)).encode() + url.encode() + data).hexdigest()
    uid = f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"
    clean = url.replace("\r", "").replace("\n", "")
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {clean}\r\nWARC-Date: {fixity.DATE}\r\nWARC-Record-ID: {uid}\r\nContent-Type: text/html\r\nContent-Length: {len(data)}\r\n\r\n".encode() + data + b"\r\n\r\n"


def plain_layout(rows, per_file):
    made = sorted((-1 if i is None else i, hashlib.sha256(r).hexdigest(), len(r)) for i, r in ((i, plain_record(i, u, h)) for i, u, h in rows))
    out, at = [], 0
    for k, (i, sha, n) in enumerate(made):
        at = 0 if k % per_file == 0 else at
        out.append((i, k // per_file, k % per_file, at, n, sha))
        at += n
    return out


def fate(i):
    h = hashlib.sha256(str(i).encode()).hexdigest()
    return "altered" if h < "02" else "missing" if h < "04" else "added" if h < "05" else "ok"


def test_query_finds_every_fault_and_no_other(spark):
    sf = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = [(r.page_id, r.file, r.seq, r.offset, r.length, r.sha256, r.status) for r in op9_merkle_fixity(spark, sf).collect()]
    want = [(*x, fate(x[0]) if fate(x[0]) != "added" else "ok") for x in plain_layout(pages, fixity.FILE)]
    for i, _, _ in pages:
        if fate(i) == "added":
            r = plain_record(None, f"http://stray.example/{i}", "")
            want.append((None, None, None, None, len(r), hashlib.sha256(r).hexdigest(), "added"))
    assert Counter(got) == Counter(want) and {x[-1] for x in want} == {"ok", "altered", "missing", "added"}


ROWS = [(1, "http://a", "x"), (2, None, None), (None, "u\r\nv", "é"), (3, "http://b", ""), (3, "http://b", ""), (3, "http://b", ""), (4, "http://c", "z" * 100_000), (4, "http://c", "z~")] + [(k, f"http://{k}", "p") for k in range(10, 40)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1)).withColumn("status", F.lit("x"))


@pytest.mark.parametrize("gz", [False, True])
def test_a_replica_of_other_layout_with_faults_in_its_bytes(spark, tmp_path, gz):
    made = [plain_record(*r) for r in ROWS]
    made[7] = made[7].replace(b"z~", b"z!")  # altered body
    made[20] = made[20].replace(b"2024", b"2025")  # altered header
    del made[30]  # missing
    del made[4]  # one of three equal records
    made += [plain_record(1, "http://a", "x"), plain_record(99, "http://new", "n")]  # one too many, and a foreign one
    made.reverse()
    folder = tmp_path / "replica"
    folder.mkdir()
    half = len(made) // 2
    for name, some in (("part-a", made[:half]), ("part-b", made[half:])):
        (folder / name).write_bytes(b"".join(map(gzip.compress, some)) if gz else b"".join(some))
    manifest = fixity.laid_out(fixity.records(frame(spark)), 8)
    got = [(-1 if r.page_id is None and r.file is not None else r.page_id, r.file, r.seq, r.offset, r.length, r.sha256, r.status) for r in fixity.audit(manifest, fixity.read_warc(spark, str(folder)), 8, 2).collect()]
    bad = {hashlib.sha256(plain_record(*ROWS[7])).hexdigest(): "altered", hashlib.sha256(plain_record(*ROWS[20])).hexdigest(): "altered", hashlib.sha256(plain_record(*ROWS[30])).hexdigest(): "missing"}
    want, copies = [], Counter()
    for x in plain_layout(ROWS, 8):
        copies[x[-1]] += 1
        want.append((*x, "missing" if x[-1] == hashlib.sha256(plain_record(*ROWS[4])).hexdigest() and copies[x[-1]] == 3 else bad.get(x[-1], "ok")))
    for r in (plain_record(1, "http://a", "x"), plain_record(99, "http://new", "n")):
        want.append((None, None, None, None, len(r), hashlib.sha256(r).hexdigest(), "added"))
    assert Counter(got) == Counter(want)


def test_a_file_that_ends_early_and_one_of_rubbish(spark, tmp_path):
    whole = b"".join(plain_record(*r) for r in ROWS[8:])
    assert [x[2] is None for x in fixity.parse(memoryview(whole[:-50]))] == [False] * 29 + [True]
    assert [x[2] is None for x in fixity.parse(memoryview(gzip.compress(whole)[:-200]))][-1]
    assert [(x[0], x[1], x[2]) for x in fixity.parse(memoryview(b"rubbish"))] == [(0, 7, None)] and fixity.parse(memoryview(b"")) == []


def test_roots_differ_only_where_records_do(spark):
    laid = fixity.laid_out(fixity.records(frame(spark)), 8).select("file", "seq", F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end"), F.col("sha256").alias("digest"))
    a, b = fixity.tree(laid, 8, 2), fixity.tree(laid.withColumn("digest", F.when(F.expr("file = 1 and seq = 5"), "-").otherwise(F.col("digest"))), 8, 2)
    roots = [{r.file: r.l3[0].digest for r in t.collect()} for t in (a, b)]
    assert {f for f in roots[0] if roots[0][f] != roots[1][f]} == {1}
    assert [(r.file, r.seq) for r in fixity.differing(a, b, 2).collect()] == [(1, 5)] and fixity.differing(a, a, 2).count() == 0
    first = [r for r in laid.where("file = 0").orderBy("seq").collect()]
    pairs = [hashlib.sha256("|".join(f"{x.begin}:{x.end}:{x.digest}" for x in first[k : k + 2]).encode()).hexdigest() for k in range(0, 8, 2)]
    assert [x.digest for x in a.where("file = 0").first().l1] == pairs


def test_drill_on_awkward_and_empty_tables(spark):
    got = Counter((-1 if r.page_id is None else r.page_id, r.status) for r in fixity.drill(frame(spark), F.col("page_id") == 17, F.col("page_id") == 3, F.lit(False), 8, 2).collect())
    want = Counter((-1 if i is None else i, "altered" if i == 17 else "missing" if i == 3 else "ok") for i, _, _ in ROWS)
    assert got == want
    assert fixity.drill(frame(spark).limit(0), F.lit(True), F.lit(True), F.lit(True)).count() == 0


def test_files_round_trip(spark, tmp_path):
    rows = [(k, f"http://{k}", f"<p>{k}\r\n\r\né</p>") for k in range(20)] + [(20, None, None)]
    pages = frame(spark, rows)
    for gz in (False, True):
        out = str(tmp_path / f"w{gz}")
        fixity.write_warc(pages.select(fixity.record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")), out, 7, gz)
        back = fixity.read_warc(spark, out).collect()
        assert sorted((r.url, r.sha256, r.length) for r in back) == sorted((u or "", hashlib.sha256(plain_record(i, u, h)).hexdigest(), len(plain_record(i, u, h))) for i, u, h in rows)


def test_only_ranges_that_differ_are_looked_into(spark):
    rows = [(k, f"http://{k}", f"page {k}") for k in range(3000)]
    manifest = fixity.laid_out(fixity.records(frame(spark, rows)))
    count = lambda t: t.groupBy("record_id", "sha256").agg(F.count("*").alias("n"), F.min("length").alias("long"))
    there = manifest.select("record_id", "sha256", "length")
    changed = there.where("sha256 > '004'").union(there.where("sha256 < '002'").withColumn("sha256", F.lit("f" * 64)))  # some altered, some missing
    n = there.where("sha256 <= '004'").count()
    trees = [fixity.range_tree(count(t), 2, 16) for t in (there, changed)]
    bad = fixity.suspects(*trees)
    fetched = manifest.withColumn("at", F.expr("0") + F.floor(fixity.place(F.col("record_id")) * 256 / 2**32)).join(bad, "at", "left_semi").count()
    assert 0 < bad.count() <= n and fetched < 40 * n < 3000
    assert fixity.suspects(trees[0], trees[0]).count() == 0
    got = Counter(r.status for r in fixity.audit(manifest, changed).collect())
    assert got["ok"] == 3000 - n and got["altered"] == there.where("sha256 < '002'").count() and sum(got.values()) == 3000
    assert Counter(r.status for r in fixity.audit(manifest, there.limit(0)).collect()) == {"missing": 3000}
    assert Counter(r.status for r in fixity.audit(manifest.limit(0), there).collect()) == {"added": 3000}
