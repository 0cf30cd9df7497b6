"""The registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination

    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.read_back(warc.write_archive(table(spark, sf_dir, "pages")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    return token_counts.document_counts(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fingerprint

    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_suffix_dedup, op4_warc, op5_token_counts, op6_sharding, op7_quality, op8_fingerprints, op9_ngram_join, op10_mixing)}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import sharding

    # Base 32 of ten hexadecimal digits at a time.
    bits = "(('0x' || substr(digest, 10 * p + 1, 10))::BIGINT >> (35 - 5 * b)) & 31"
    base32 = f"array_to_string(list_transform(generate_series(0, 31), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({bits.replace('p + 1', '(j // 8) + 1').replace('5 * b', '5 * (j % 8)')} AS INTEGER) + 1, 1)), '')"
    owner = ",".join(map(str, sharding.lookup_table(sharding.shard_names())))
    return {
        "op4_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
            SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {base32} AS payload_digest,
                CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM f""",
        "op6_sharding": f"""
            WITH keyed AS (
                SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents
            ), owner AS (SELECT [{owner}] AS shards)
            SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM keyed, owner""",
    }
