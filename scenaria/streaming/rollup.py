"""Incremental stimulus roll-up over a growing folder of fact files (Structured Streaming).

The stream keeps, per (region, component), the running sum, the row count and the count of non-null
values: a state whose size is the number of groups, whatever the number of input rows. ``finish`` turns
that state into the same rows as ``stimulus_by_region`` before densifying: skip-null regional sums, and a
strict World total per component that includes rows without region.

On a cluster, ``start`` writes each micro-batch's state through ``foreachBatch`` into a folder of its own
(``epoch=N``) beside the shared checkpoint folder; ``latest_state`` reads the newest one. A batch that is run again
writes its own folder again, and readers never meet a missing table. Tests use the memory sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scenaria.session import scratch_path


def running_state(facts: DataFrame, group: str = "region", by: str = "component", value: str = "stimulus") -> DataFrame:
    """Streaming aggregate: sum, rows and non-null values per (group, by)."""
    return facts.groupBy(group, by).agg(
        F.sum(value).alias("value_sum"), F.count(F.lit(1)).alias("rows"), F.count(value).alias("values"))


def finish(state: DataFrame, group: str = "region", by: str = "component", out: str = "stimulus",
           total_label: str = "World") -> DataFrame:
    """Batch view of the state: group rows (skip-null sums) plus the strict total per ``by``."""
    groups = state.filter(F.col(group).isNotNull()).select(
        group, by, F.coalesce(F.col("value_sum"), F.lit(0.0)).alias(out))
    total = state.groupBy(by).agg(
        F.when(F.sum("rows") == F.sum("values"), F.sum("value_sum")).alias(out)
    ).select(F.lit(total_label).alias(group), by, out)
    return groups.unionByName(total)


def start(spark: SparkSession, source_dir: str, schema: StructType, sink: str = "memory",
          name: str = "stimulus_rollup", checkpoint: str | None = None) -> StreamingQuery:
    """Start the roll-up over Parquet files arriving in ``source_dir`` (complete output of the state)."""
    facts = spark.readStream.schema(schema).parquet(source_dir)
    state = running_state(facts)
    checkpoint = checkpoint or scratch_path(spark, f"stream-{name}")
    writer = state.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    if sink == "memory":
        return writer.format("memory").queryName(name).start()
    target = f"{checkpoint}-table"

    def write_batch(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return writer.foreachBatch(write_batch).start()


def latest_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state after the newest finished micro-batch of a query started with ``sink`` other than memory."""
    state = spark.read.parquet(f"{checkpoint}-table")
    newest = state.agg(F.max("epoch")).first()[0]
    return state.where(F.col("epoch") == newest).drop("epoch")
