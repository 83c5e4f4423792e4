"""The registered queries of this folder and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.llm import chat, decontaminate, jaccard, mixing, quality, ranked_search, spelling, toxicity, url_filter
from inkgraph.llm.common import table
from inkgraph.llm.context_mixing import score_texts
from inkgraph.llm.fingerprints import fingerprint_versions
from inkgraph.llm.token_counts import count_tokens
from inkgraph.llm.warc import archive_pages


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample_mix(table(spark, sf_dir, "documents"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.format_preferences(chat.swapped_answers(table(spark, sf_dir, "conversations")), ["conv_id"])
    return pairs.withColumns({k: chat.spans_as_text(F.col(k)) for k in ("chosen_spans", "rejected_spans")})


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_classes(table(spark, sf_dir, "documents"), size=4, percent=85)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score_quality(documents, quality.train(documents, table(spark, sf_dir, "labels")))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark), url_filter.labelled_table(spark))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_context_mixing": op2_context_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_preferences": op4_preferences,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard": op7_jaccard,
    "op8_warc": op8_warc,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality": op10_quality,
    "op11_url_filter": op11_url_filter,
    "op12_spelling": op12_spelling,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.sample_sql(),
    "op4_preferences": chat.SWAPPED_SQL,
    "op11_url_filter": url_filter.filter_sql(),
    "op13_ranked_search": ranked_search.SEARCH_SQL,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_page THEN first_page END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
}
