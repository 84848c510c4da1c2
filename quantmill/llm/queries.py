"""Queries of the operators over the test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op2_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann_tree import search

    return search(_table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "n_tokens", "p_high", "p_low", "p_toxic", "rate", "copies")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digest, format_chats, with_probe

    return digest(format_chats(with_probe(_table(spark, sf_dir, "conversations"))))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest

    return digest(_table(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op6, which SQL can give."""
    from .pii import base_spans

    return base_spans(_table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op4, which SQL can give."""
    from .license_scan import base_places

    return base_places(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bagminhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_reputation import filter_urls, outcomes_of_labels

    return filter_urls(_table(spark, sf_dir, "pages"), outcomes_of_labels(_table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), name=f"{sf_dir}/documents.parquet")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_alignment import digest

    return digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_ann_tree, op3_mixing, op4_license_scan, op5_chat_format, op6_pii, op7_decontaminate, op8_bagminhash, op9_url_reputation, op10_token_count, op11_filter_audit, op12_token_alignment, op13_quality_classifier, pii_base, license_base)}


def _oracle_sql() -> dict[str, str]:
    from . import chat_format, decontaminate, filter_audit, license_scan, pii, url_reputation

    return {"op5_chat_format": chat_format.SQL, "op7_decontaminate": decontaminate.SQL, "op9_url_reputation": url_reputation.SQL, "op11_filter_audit": filter_audit.SQL, "pii_base": pii.BASE_SQL, "license_base": license_scan.BASE_SQL}


ORACLE_SQL: dict[str, str] = _oracle_sql()
