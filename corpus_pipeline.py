"""A training-corpus pipeline over ``documents``: five stages, each one operator of ``scenaria.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

1. quality: documents that the compression classifier rejects go.
2. near_duplicates: one document of each group of near copies stays (5-word shingles, Jaccard 0.8).
3. decontamination: documents that hold a benchmark passage go.
4. secrets: secrets in the texts give way to a mark, n_chars follows.
5. tokens: texts are encoded into pieces, in a column ``tokens``.

Null and empty texts pass every filter that has nothing against them (the classifier scores the empty text, and what it
says of it holds for all). Repeated rows with one id and text are one document after stage 2. An empty table stays
empty in every stage. Further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenaria.llm.common import store, table
from scenaria.llm.compression_quality import keep_good
from scenaria.llm.decontaminate import decontaminated
from scenaria.llm.parity_join import one_of_each
from scenaria.llm.piece_tokens import encoded
from scenaria.llm.secret_scan import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, percent=80, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets),
          ("tokens", tokens)]

#: SQL cannot express a stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``; every stage's result is stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
