"""One query per corpus operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, fingerprints, jaccard, licenses, lines, minhash, mixing, pages, search, shards, toxicity, warc, whitening
from .common import table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"), licenses.templates(spark))


@query
def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("row_key")


@query
def op3_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf, "labels"))
    return toxicity.scored(docs, lexicon).select("doc_id", "held_out", "score", "predicted")


@query
def op7_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return lines.without_boilerplate(docs).drop("source")


@query
def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf, "documents"))


@query
def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return mixing.mix(docs, keep=["doc_id"]).documents.select("doc.doc_id", "size", "source_size", "target", "taken")


@query
def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = shards.shard(table(spark, sf, "documents"), shards.layout(40), keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


@query
def op12_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.join(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: A hexadecimal SHA-1 as base 32: five bits at a time, from two hexadecimal digits.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((((instr('0123456789abcdef', substr(x, (5 * i // 4 + 1)::INT, 1)) - 1) * 16
    + greatest(instr('0123456789abcdef', substr(x, (5 * i // 4 + 2)::INT, 1)) - 1, 0)) >> (3 - i % 4)::INT) & 31)::INT + 1, 1)), '')"""


#: All pairs that share a shingle, counted; components by reaching out from every document.
_JACCARD = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = d.doc_id"""


#: The same for shingles of four words and 80 percent.
_MINHASH = (
    "SELECT *, doc_id = component_id AS kept FROM (" + _JACCARD.replace("len(w) < 5", "len(w) < 4").replace("i + 4]", "i + 3]")
    .replace("len(w) - 4", "len(w) - 3").replace("75 *", "80 *") + ")"
)


#: Every pair of a document and an item that share a term.
_SEARCH = r"""
WITH t AS MATERIALIZED (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM (SELECT DISTINCT item_id, text FROM benchmark)),
c AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS total FROM t WHERE side = 0 AND len(w) > 0),
tf AS MATERIALIZED (SELECT row, id, n, v, count(*)::BIGINT AS tf FROM (SELECT row, id, len(w)::BIGINT AS n, unnest(w) AS v FROM t WHERE side = 0) GROUP BY ALL),
wt AS (SELECT v, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, c GROUP BY v, docs),
it AS (SELECT DISTINCT row AS item, id AS item_id, unnest(w) AS v FROM t WHERE side = 1),
s AS (SELECT item, item_id, row, id AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
      FROM it JOIN wt USING (v) JOIN tf USING (v), c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


def sql() -> dict[str, str]:
    return {
        "op3_jaccard": _JACCARD,
        "op12_search": _SEARCH,
        "op13_minhash": _MINHASH,
        "op7_lines": r"""
WITH l AS (SELECT doc_id, source, generate_subscripts(x, 1) AS ln, unnest(x) AS v
           FROM (SELECT doc_id, source, string_split(text, chr(10)) AS x FROM documents WHERE text <> '')),
t AS (SELECT *, regexp_replace(v, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g') AS w FROM l),
b AS (SELECT w FROM t WHERE length(w) >= 15 GROUP BY w HAVING count(DISTINCT coalesce('=' || source, '')) >= 5),
k AS (SELECT doc_id, count(*) AS n_lines, count(b.w) AS n_removed, string_agg(v, chr(10) ORDER BY ln) FILTER (WHERE b.w IS NULL) AS text
      FROM t LEFT JOIN b ON t.w = b.w GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN k USING (doc_id)""",
        "op4_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS m FROM p GROUP BY h),
s AS (SELECT page_id, m, strlen(p.h) AS n, sha1(p.h) AS x FROM p JOIN f ON p.h = f.h)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to
FROM s""",
    }
