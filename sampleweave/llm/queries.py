"""The queries of this subpackage by name. Each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleweave.llm import bpe, cover_tree, multi_index, packing, pii, rans, secrets, simhash, toxicity, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document: digests of its ids and of its decoded text."""
    made = bpe.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record, normalises the archives and reads them back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by a model of the labels that are not held out."""
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds secrets in every document: counts and digest of the base spans, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    counts = [secrets.count_of(F.col("secrets"), kind).alias(f"n_{kind}") for kind in secrets.BASE]
    digest = F.sha2(secrets.listed(secrets.base_only(F.col("secrets"))).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


def op5_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as rANS files in order of doc_id and reads them back: place, length and checksum of each."""
    return rans.round_trip(spark, table(spark, sf_dir, "documents"), WORD_BPE, 1).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose vec_id is divisible by 50 the five others with the highest integer inner product."""
    vectors = table(spark, sf_dir, "embeddings")
    return cover_tree.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5, 256)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of shingles of three words, linked at two or fewer differing bits: each document's fingerprint and component."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3, reach=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 ids: one row per piece."""
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, 0))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds personal data in every document: counts and digest of the base spans, and all spans."""
    found = pii.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE]
    base = F.filter("spans", lambda s: s["rank"] < len(pii.BASE))
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links vectors of equal labels at a cosine of 0.93 or more: each vector's links and component."""
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93).select("vec_id", "n_links", "component_id", "kept")


QUERIES = {"op1_bpe": op1_bpe, "op2_warc": op2_warc, "op3_toxicity": op3_toxicity, "op4_secrets": op4_secrets, "op5_rans": op5_rans, "op6_cover_tree": op6_cover_tree, "op7_simhash": op7_simhash, "op8_packing": op8_packing, "op9_pii": op9_pii, "op10_multi_index": op10_multi_index}
ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        g AS (SELECT payload_digest, max(page_id) AS response, count(*) AS n FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT q.page_id, q.payload_bytes, q.payload_digest,
               CASE WHEN g.n > 1 AND q.page_id <> g.response THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.n > 1 AND q.page_id <> g.response THEN g.response END AS refers_to
        FROM q LEFT JOIN g ON q.payload_digest = g.payload_digest AND q.payload_bytes >= 1000
    """,
    "op6_cover_tree": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS code FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.code, b.code) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op10_multi_index": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        ),
        pairs AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.x, b.x) >= 0.93
        ),
        reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
        links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(least.b, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(least.b, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN links ON links.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id
    """,
}
