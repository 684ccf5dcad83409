"""One query per operator, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scenaria.llm.common import table
from scenaria.llm.licenses import oracle_sql as license_sql
from scenaria.llm.merkle import oracle_sql as merkle_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run
    return put


@query("op6_ngram_jaccard_join")
def op6(spark, sf_dir):
    from scenaria.llm.parity_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), percent=90, width=3).drop("digest")


@query("op5_document_fingerprints")
def op5(spark, sf_dir):
    from scenaria.llm.minhash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    from scenaria.llm.compression_quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_benchmark_decontamination")
def op10(spark, sf_dir):
    from scenaria.llm.decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_secret_scans")
def op8(spark, sf_dir):
    from scenaria.llm.secret_scan import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


@query("op4_sentencepiece")
def op4(spark, sf_dir):
    from scenaria.llm.piece_tokens import token_digests

    return token_digests(table(spark, sf_dir, "documents"))


@query("op7_kd_sharding")
def op7(spark, sf_dir):
    from scenaria.llm.kd_shards import kd_shards

    return kd_shards(table(spark, sf_dir, "documents"), shards=40)


@query("op3_html_extraction")
def op3(spark, sf_dir):
    from scenaria.llm.html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


@query("op1_url_filters")
def op1(spark, sf_dir):
    from scenaria.llm.link_trust import judged_urls

    return judged_urls(table(spark, sf_dir, "pages"))


@query("op2_license_scans", license_sql())
def op2(spark, sf_dir):
    from scenaria.llm.licenses import license_ids

    return license_ids(table(spark, sf_dir, "documents"))


@query("op11_cross_tokenizer_alignment")
def op11(spark, sf_dir):
    from scenaria.llm.token_alignment import alignment

    return alignment(table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest", merkle_sql())
def op12(spark, sf_dir):
    from scenaria.llm.merkle import tamper_report

    return tamper_report(table(spark, sf_dir, "documents"))


@query("op13_byte_bpe")
def op13(spark, sf_dir):
    from scenaria.llm.byte_tokens import token_digests

    return token_digests(table(spark, sf_dir, "documents"))
