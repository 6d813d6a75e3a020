"""The registered queries of the ten operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def held_out(id_col: str = "doc_id"):
    """Rows that no classifier learns from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts, told by deterministic block names."""
    from .exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, over an inverted multi-index of all vectors."""
    from .ann import search

    return search(read(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: candidates from a trigram index, spans by the rules' expressions."""
    from .secrets import scan_secrets

    return scan_secrets(read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every whole text, by a trained classifier that templates confirm."""
    from .licenses import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text once each 200-byte string that starts anywhere else is removed."""
    from .substr_dedup import substring_dedup

    return substring_dedup(read(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents"), keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component that links of Jaccard 0.8 over 5-word shingles make."""
    from .ngram_join import ngram_components

    return ngram_components(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of at most 4096 tokens."""
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; learned from the rows that are not held out."""
    from .langid import identify, learn

    docs = read(spark, sf_dir, "documents")
    known = learn(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), known).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every whole text; learned from the labels of rows that are not held out."""
    from .quality import quality

    docs = read(spark, sf_dir, "documents")
    found = quality(docs, read(spark, sf_dir, "labels"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


#: Every 200-byte string by its MD5 over hexadecimal text, and the bytes that repeated ones cover.
OP5_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM t)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
b AS (SELECT *, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, -1) AS opens FROM r),
g AS (SELECT doc_id, run, min(i) AS s, max(i) + 200 AS e FROM (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b) GROUP BY doc_id, run),
c AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS from_ FROM g),
k AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * from_ + 1, 2 * (s - from_)), '' ORDER BY s) AS kept FROM c JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""

#: All pairs that share a shingle, and what is reachable over those that link.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_nearest_neighbours, op3_secret_scan, op4_license_scan, op5_suffix_dedup, op6_source_mix, op7_ngram_jaccard, op8_best_fit_packing, op9_language_id, op10_quality)}


def oracle_sql() -> dict:
    from . import secrets

    return {"op1_exact_dedup": OP1_SQL, "op3_secret_scan": secrets.oracle_sql(), "op5_suffix_dedup": OP5_SQL, "op7_ngram_jaccard": OP7_SQL}
