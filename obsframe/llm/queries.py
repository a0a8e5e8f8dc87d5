"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import ann, lm, mixing, neardup, packing, phrases, pii, quality, repair, repeats, sharding, topk, warc
from obsframe.session import configure, scratch


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document; base spans are those of the fixed kinds."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs), "found").select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind"].isin(*pii.KINDS))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        (F.size("found") - F.size(base)).cast("long").alias("n_more"),
        F.sha2(pii.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        pii.spans_text(F.col("found")).alias("spans"),
    )


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row whose vec_id is divisible by 100."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 100 == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of all documents by their number of words."""
    return packing.pack(packing.word_lengths(_read(spark, sf_dir, "documents")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every row whose vec_id is divisible by 50."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_inner_products(vectors, F.col("vec_id") % 50 == 0)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).drop("text_hash")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``; strata are the sources."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.interleave(docs, 24, ties=("text_crc32", "size"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written, read back and resolved."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{scratch(spark)}/archives"
    warc.write_archives(pages, path)
    return warc.resolved(warc.read_archives(spark, path))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each document is of quality 1; learned from labelled rows that are not held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document against all others."""
    scored = lm.stupid_backoff(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 5))
    return scored.select("doc_id", "n_words", "n_backoff", F.round("log_score", 3).alias("log_score"), mean.alias("mean_log_score"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each copy stands when all sources weigh the same."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.placed(mixing.mix(docs))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return phrases.collocations(_read(spark, sf_dir, "documents").select("text", "lang"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least audit that repairs every damaged conversation."""
    whole = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = repair.damage(whole)
    edits, status = repair.plan(rows)
    told = repair.digests(repair.repaired(rows, edits))
    every = whole.groupBy("conv_id").count().select("conv_id", repair.conversation_key(F.col("conv_id")).alias("c"))
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return every.join(status, "c", "left").join(told, "c", "left").select(
        "conv_id",
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that repeat."""
    docs = repeats.without_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SPACE = r"[^\x20\x09-\x0D]+"

_PACKING = packing.PackingParams()
_OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, len({_WORDS})::BIGINT AS length FROM documents),
h AS (SELECT length, count(*) AS n FROM d WHERE length <= {_PACKING.budget} GROUP BY length),
c AS (
  SELECT length, row_number() OVER (ORDER BY length) AS j, (sum(n) OVER (ORDER BY length))::BIGINT AS r,
         (sum(n * length) OVER (ORDER BY length))::BIGINT AS t FROM h
  UNION ALL SELECT NULL, 0, 0, 0),
size AS (SELECT max(j) AS n, least({_PACKING.buckets}, max(j)) AS layers FROM c),
dp AS (
  SELECT 0 AS b, j, CASE WHEN j = 0 THEN 0::HUGEINT END AS cost, 0::BIGINT AS cut FROM c
  UNION ALL
  SELECT b, j, (best // 1000000)::HUGEINT, (best % 1000000)::BIGINT FROM (
    SELECT dp.b + 1 AS b, y.j, CASE WHEN y.j = 0 THEN 0::HUGEINT ELSE
      min(CASE WHEN dp.j < y.j THEN (dp.cost + y.length * (y.r - x.r) - (y.t - x.t)) * 1000000::HUGEINT + dp.j END) END AS best
    FROM dp JOIN c x ON x.j = dp.j CROSS JOIN c y CROSS JOIN size
    WHERE dp.b < size.layers AND (dp.j < y.j OR (y.j = 0 AND dp.j = 0)) AND dp.cost IS NOT NULL
    GROUP BY dp.b, y.j)),
back AS (
  SELECT layers AS b, n AS j FROM size WHERE n > 0
  UNION ALL
  SELECT back.b - 1, dp.cut FROM back JOIN dp ON dp.b = back.b AND dp.j = back.j WHERE back.b > 1 AND dp.cut > 0),
bounds AS (SELECT length AS top, row_number() OVER (ORDER BY length) - 1 AS bucket FROM back JOIN c USING (j)),
k AS (SELECT count(*) AS n FROM bounds),
p AS (
  SELECT doc_id, length, coalesce((SELECT min(bucket) FROM bounds WHERE top >= length), (SELECT n FROM k)) AS bucket FROM d),
q AS (
  SELECT p.doc_id, p.length, p.bucket, coalesce(bounds.top, p.length) AS padded_length, bounds.top IS NOT NULL AS packed,
         row_number() OVER (PARTITION BY p.bucket ORDER BY md5('{_PACKING.seed}:' || coalesce(doc_id::VARCHAR, '')), doc_id, p.length) - 1 AS pos
  FROM p LEFT JOIN bounds ON bounds.bucket = p.bucket),
s AS (SELECT *, CASE WHEN packed THEN greatest({_PACKING.budget} // greatest(padded_length, 1), 1) ELSE 1 END AS size FROM q)
SELECT doc_id, length, bucket::INTEGER AS bucket, padded_length::BIGINT AS padded_length, (pos // size)::BIGINT AS batch, (pos % size)::BIGINT AS slot FROM s
"""

_OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP5_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 1 THEN [words[1]]
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS g FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
edges AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, edges.b FROM r JOIN edges ON edges.a = r.c),
least_id AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN least_id USING (doc_id)
"""

_OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.digest = p.digest AND p.n >= 100
"""

_OP9_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS w FROM w),
u AS (SELECT w, count(*) AS n FROM t GROUP BY w),
ud AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY doc_id, w),
g AS (SELECT x.doc_id, y.i, x.w AS v, y.w AS w FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.i = x.i + 1),
b AS (SELECT v, w, count(*) AS n FROM g GROUP BY v, w),
bd AS (SELECT doc_id, v, w, count(*) AS n FROM g GROUP BY doc_id, v, w),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
base AS (
  SELECT t.doc_id, t.i, u.n - ud.n AS c, ln(greatest(u.n - ud.n, 1)::DOUBLE / greatest((SELECT sum(n) FROM n) - n.n, 1)::DOUBLE) AS s
  FROM t JOIN u USING (w) JOIN ud USING (doc_id, w) JOIN n ON n.doc_id = t.doc_id),
pair AS (SELECT g.doc_id, g.i, b.n - bd.n AS c FROM g JOIN b USING (v, w) JOIN bd USING (doc_id, v, w)),
s AS (
  SELECT x.doc_id, CASE WHEN pair.i IS NULL THEN x.s WHEN pair.c > 0 THEN ln(pair.c::DOUBLE) - ln(y.c::DOUBLE) ELSE x.s + ln(0.4::DOUBLE) END AS s,
         coalesce(pair.c <= 0, false) AS short
  FROM base x LEFT JOIN pair ON pair.doc_id = x.doc_id AND pair.i = x.i LEFT JOIN base y ON y.doc_id = x.doc_id AND y.i = x.i - 1),
a AS (SELECT doc_id, count(*) AS n, sum(s) AS s, count(*) FILTER (short) AS k FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_words, coalesce(a.k, 0)::BIGINT AS n_backoff,
       coalesce(round(a.s, 3), 0.0) AS log_score, round(a.s / a.n, 5) AS mean_log_score
FROM documents d LEFT JOIN a USING (doc_id)
"""

_OP10_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE) * (SELECT sum(n) FROM sizes)::DOUBLE / n::DOUBLE AS mean FROM sizes),
cdf AS (
  SELECT source, mean, 0 AS k, -mean AS log, exp(-mean) AS sum FROM rates
  UNION ALL
  SELECT source, mean, k + 1, log + ln(mean) - ln((k + 1)::DOUBLE), sum + exp(log + ln(mean) - ln((k + 1)::DOUBLE)) FROM cdf
  WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
d AS (
  SELECT doc_id, source, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (
  SELECT doc_id, d.source, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.sum <= d.u) AS copies FROM d),
copies AS (SELECT doc_id, source, unnest(range(1, copies + 1)) AS copy FROM counted)
SELECT doc_id, source, copy::INTEGER AS copy,
  row_number() OVER (ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), doc_id, copy) - 1 AS position
FROM copies
"""

_OP11_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM w, range(1, 5) s(k)),
f AS (SELECT lang, p, count(*) AS f FROM g GROUP BY lang, p HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
  FROM f c, range(1, 4) s(k), f x, f y
  WHERE k < len(c.p) AND x.lang = c.lang AND x.p = c.p[1:k] AND y.lang = c.lang AND y.p = c.p[k + 1:len(c.p)]),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS i FROM cuts),
parts AS (
  SELECT lang, f, unnest(list_transform(range(1, len(p) - k + 2), lambda i: p[i:i + k - 1])) AS p FROM f, range(2, 4) s(k) WHERE k < len(p)),
covered AS (SELECT DISTINCT f.lang, f.p FROM f JOIN parts ON parts.lang = f.lang AND parts.p = f.p WHERE 100::HUGEINT * parts.f >= 80::HUGEINT * f.f),
left_over AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM worst WHERE i = 1 AND (lang, p) NOT IN (SELECT (lang, p) FROM covered)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

QUERIES = {
    "op1_pii": op1_pii,
    "op2_ann": op2_ann,
    "op3_packing": op3_packing,
    "op4_topk": op4_topk,
    "op5_neardup": op5_neardup,
    "op6_sharding": op6_sharding,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_lm": op9_lm,
    "op10_mixing": op10_mixing,
    "op11_phrases": op11_phrases,
    "op12_repair": op12_repair,
    "op13_repeats": op13_repeats,
}
ORACLES = {
    "op3_packing": _OP3_SQL,
    "op4_topk": _OP4_SQL,
    "op5_neardup": _OP5_SQL,
    "op7_warc": _OP7_SQL,
    "op9_lm": _OP9_SQL,
    "op10_mixing": _OP10_SQL,
    "op11_phrases": _OP11_SQL,
}
