"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fixity, merkle, packing, passages, quality, shards, simhash, tokenfiles, toxicity, trie, twotier
from .shared import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_stable_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.spans(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_js_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents"), shards=16, epsilon=0.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixity drill over all pages: what befalls a page's record in the replica goes by the SHA-256 of its page_id."""
    pages = table(spark, sf_dir, "pages")
    h = F.sha2(F.col("page_id").cast("string"), 256)
    return fixity.drill(pages, h < "02", (h >= "02") & (h < "04"), (h >= "04") & (h < "05"))


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_mountain_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked against rows where the texts of one in five ids have been lower-cased."""
    upper = "".join(map(chr, range(65, 91)))
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = {"text": F.translate("text", upper, upper.lower())}
    return merkle.audited(merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], changed, bad))


def op12_patricia_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twotier.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


QUERIES = {
    "op1_stable_kdtree": op1_stable_kdtree,
    "op2_js_quality": op2_js_quality,
    "op3_prefix_bpe": op3_prefix_bpe,
    "op4_line_hashing": op4_line_hashing,
    "op5_simhash_bytes": op5_simhash_bytes,
    "op6_bounded_ring": op6_bounded_ring,
    "op7_mixture_packing": op7_mixture_packing,
    "op8_mixing_coder": op8_mixing_coder,
    "op9_merkle_fixity": op9_merkle_fixity,
    "op10_subword_toxicity": op10_subword_toxicity,
    "op11_mountain_merkle": op11_mountain_merkle,
    "op12_patricia_trie": op12_patricia_trie,
    "op13_two_tier_bpe": op13_two_tier_bpe,
}



def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII string, half a byte at a time."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    half = lambda c: f"xor(({c}) >> 4, {table}[(({c}) & 15) + 1])"
    step = half(half("xor(a, b)"))
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {step}), 4294967295)"


_WARC = f"""'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Target-URI: ' || replace(replace(u, chr(13), ''), chr(10), '') || nl
  || 'WARC-Date: {fixity.DATE}' || nl || 'WARC-Record-ID: <urn:uuid:' || substr(n, 1, 8) || '-' || substr(n, 9, 4) || '-5' || substr(n, 14, 3) || '-8' || substr(n, 18, 3) || '-' || substr(n, 21, 12) || '>' || nl
  || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(h) || nl || nl || h || nl || nl"""


def _merkle(levels: int = 6) -> str:
    """SQL for the proofs: trees of at most 16 ** levels leaves, a level at a time; a node alone in its tree stays as it is."""
    fields = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = f"CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    out = [f"d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS key, {fields('text')} AS leaf, {fields(lower)} AS found FROM documents)"]
    out.append("a0 AS MATERIALIZED (SELECT key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY key) AS n, r FROM d)")

    def tree(t: str) -> str:
        for k in range(levels):
            out.append(
                f"{t}s{k} AS (SELECT key, i, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{k} WINDOW w AS (PARTITION BY key, i // 16 ORDER BY i))"
            )
            out.append(f"{t}{k + 1} AS (SELECT key, i // 16 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, (n + 15) // 16 AS n FROM {t}{k} GROUP BY key, i // 16, n)")
        return f"{t}{levels}"

    top = tree("a")
    out.append(f"b0 AS (SELECT '' AS key, row_number() OVER (ORDER BY encode(key)) - 1 AS i, h, count(*) OVER () AS n, key AS source FROM {top})")
    root = tree("b")
    joins = " ".join(f"JOIN as{k} ON as{k}.key = d.key AND as{k}.i = a0.i // {16**k}" for k in range(levels)) + " " + " ".join(f"JOIN bs{k} ON bs{k}.i = b0.i // {16**k}" for k in range(levels))
    names = [f"{t}s{k}" for t in "ab" for k in range(levels)]
    cols = ", ".join(f"{x}.l AS {x}l, {x}.r AS {x}r, {x}.n AS {x}n" for x in names)
    out.append(f"p0 AS (SELECT doc_id, leaf, {top}.h AS subroot, {root}.h AS root, found AS node, {cols} FROM d JOIN a0 ON a0.r = d.r JOIN {top} ON {top}.key = d.key JOIN b0 ON b0.source = d.key CROSS JOIN {root} {joins})")
    for k, x in enumerate(names):
        out.append(f"p{k + 1} AS (SELECT * REPLACE (CASE WHEN {x}n > 1 THEN sha256({x}l || node || {x}r) ELSE node END AS node) FROM p{k})")
    proof = " || ".join(f"{x}l || {x}r" for x in names)
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, node AS folded_root, node = root AS verified FROM p{len(names)}"


ORACLES: dict[str, str] = {
    "op11_mountain_merkle": _merkle(),
    "op9_merkle_fixity": f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, chr(13) || chr(10) AS nl FROM pages),
q AS (SELECT *, sha256(coalesce(CAST(page_id AS VARCHAR), '') || u || h) AS n FROM p),
l AS (SELECT page_id, sha256({_WARC}) AS sha256, strlen({_WARC}) AS length, strlen(h) AS body FROM q),
o AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, sha256) - 1 AS k FROM l),
f AS (SELECT *, k // {fixity.FILE} AS file, k % {fixity.FILE} AS seq, sha256(CAST(page_id AS VARCHAR)) AS fate FROM o),
s AS (SELECT 'http://stray.example/' || CAST(page_id AS VARCHAR) AS u, '' AS h, nl, sha256('http://stray.example/' || CAST(page_id AS VARCHAR)) AS n FROM p
  WHERE sha256(CAST(page_id AS VARCHAR)) >= '04' AND sha256(CAST(page_id AS VARCHAR)) < '05')
SELECT page_id, file, CAST(seq AS INTEGER) AS seq,
  CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  length, sha256, CASE WHEN fate < '02' AND body > 0 THEN 'altered' WHEN fate >= '02' AND fate < '04' THEN 'missing' ELSE 'ok' END AS status
FROM f
UNION ALL SELECT NULL, NULL, NULL, NULL, strlen({_WARC}), sha256({_WARC}), 'added' FROM s""",
    "op12_patricia_trie": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, sha256(strlen(r) || ':' || r || x) AS t, length(x) AS cp, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) AS k FROM t),
c AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS own, k, t, cp FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND k <= h UNION ALL SELECT conv_id, 1, k, t, cp FROM c JOIN o USING (conv_id) WHERE k > h),
s AS (SELECT conv_id, cp, row_number() OVER w AS d, sha256(string_agg(t, '') OVER w) AS p FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, k ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY d) AS above FROM (SELECT * FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c)),
e AS (SELECT p, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(p, d) AS p FROM m GROUP BY conv_id) GROUP BY p),
n AS (SELECT p, d, above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(cp) AS saved FROM m GROUP BY p, d, above),
k AS (SELECT above AS p, count(*) AS n_children FROM n GROUP BY above),
a AS (SELECT m.p, count(*) FILTER (k.p IS NULL) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM n LEFT JOIN k USING (p) JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY m.p)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends, '{trie.NO_ENDS}') AS ends_sha256
FROM n LEFT JOIN n AS u ON u.p = n.above LEFT JOIN k ON k.p = n.p LEFT JOIN e ON e.p = n.p JOIN a ON a.p = n.p""",
}
