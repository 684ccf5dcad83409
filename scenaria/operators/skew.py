"""Joins of a fact table with a table that is too large to send to every task, when some keys hold many of the rows.

The heavy keys are found by a frequent-items sketch over the fact's key column alone (one pass that reads one column and
returns a bounded list). The rows of a heavy key are dealt to as many parts as its share asks for, and the other table's rows
of that key are repeated once for each part; all other keys have one part. One hash join on (key, part) then gives the same
rows as a join on the key, and no task gets more than a fraction of a mean task from any key. Rows with a null key match nothing
and are dealt to all tasks.

A table below Spark's own broadcast threshold needs none of this: Spark sends it to every task and the fact stays where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a mean task's rows that one piece of a heavy key may have.
FINE = 4
#: Most heavy keys told apart by the sketch, and counters it keeps.
MOST_KEYS = 1000
COUNTERS = 10_000


def is_small(df: DataFrame) -> bool:
    """Whether the planner's size of ``df`` is below the session's broadcast threshold."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    bytes_ = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit) if not limit.lstrip("-").isdigit() else int(limit)
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= bytes_


def heavy_keys(df: DataFrame, key: str, parts: int) -> dict:
    """Number of pieces of each key that holds more rows than a piece may: {key: pieces}. A sketch may overrate a key
    slightly, which costs a piece too many, and cannot miss one that holds more than 1 / COUNTERS of the rows."""
    found = df.agg(F.call_function("approx_top_k", F.col(key), F.lit(MOST_KEYS), F.lit(COUNTERS)).alias("top"), F.count(key).alias("n")).first()
    piece = max(1, found["n"] // (parts * FINE))
    return {x["item"]: -(-x["count"] // piece) for x in found["top"] or [] if x["item"] is not None and x["count"] > piece}


def _pieces(key: Column, heavy: dict) -> Column:
    if not heavy:
        return F.lit(1)
    table = F.create_map(*[F.lit(v) for k, n in heavy.items() for v in (k, n)])
    return F.coalesce(F.try_element_at(table, key), F.lit(1))


def join_skewed(fact: DataFrame, other: DataFrame, fact_key: str, other_key: str, how: str = "inner", parts: int | None = None) -> DataFrame:
    """``fact`` joined with ``other`` (``inner`` or ``left``), both key columns kept. Duplicate keys in ``other`` fan out."""
    if how not in ("inner", "left"):
        raise ValueError("join_skewed joins inner or left")
    same = F.col(fact_key) == F.col(other_key)
    if is_small(other):
        return fact.join(other, same, how)
    parts = parts or int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(fact, fact_key, parts)
    turn = F.monotonically_increasing_id()  # a row's place in its task: rows of one key take turns
    dealt = fact.withColumn("_piece", F.when(F.col(fact_key).isNull(), F.pmod(turn, F.lit(parts * FINE))).otherwise(
        F.pmod(turn, _pieces(F.col(fact_key), heavy))).cast("int"))
    repeated = other.withColumn("_of", F.explode(F.sequence(F.lit(0), (_pieces(F.col(other_key), heavy) - 1).cast("int"))))
    return dealt.join(repeated, same & (F.col("_piece") == F.col("_of")), how).drop("_piece", "_of")
