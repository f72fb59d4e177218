"""Queries and SQL of this subpackage's operators, as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedgeline.llm.archives import archive_pages
from sedgeline.llm.centroids import clustered_vectors
from sedgeline.llm.exact_dedup import exact_groups
from sedgeline.llm.idfiles import read_id_files, write_id_files
from sedgeline.llm.language import languages
from sedgeline.llm.mixing import taken_words
from sedgeline.llm.packing import packed_pieces
from sedgeline.llm.pii import span_report
from sedgeline.llm.quality import quality_report
from sedgeline.llm.scratch import new_path
from sedgeline.llm.sharding import sharded
from sedgeline.llm.simhash import near_components
from sedgeline.llm.suffix_dedup import remove_repeats
from sedgeline.llm.vector_codes import coded_vectors
from sedgeline.llm.vector_sql import CENTROID_SQL, CODE_SQL

#: Where the vocabularies are: a package that ships them, see ``tokenizer``.
BYTE_BPE, WORD_BPE, WORD_BPE_END = "byte_bpe_50k.json", "word_bpe_49k.json", 2


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_documents(spark, sf_dir))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(_documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(_documents(spark, sf_dir), tokenizer(BYTE_BPE), keep_ids=False)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_id_files(_documents(spark, sf_dir), new_path(spark, "token-files"), tokenizer(WORD_BPE), "bare", WORD_BPE_END)
    return read_id_files(files)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir)).drop("kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_documents(spark, sf_dir))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archive_pages(pages, new_path(spark, "archives")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_token_files": op6_token_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash": op9_simhash,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_centroids": op12_centroids,
    "op13_sharding": op13_sharding,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (
            SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first,
                   array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + ((('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::BIGINT, 1)), '') AS payload_digest
            FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d""",
    "op11_vector_codes": CODE_SQL,
    "op12_centroids": CENTROID_SQL,
}
