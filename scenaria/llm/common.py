"""Helpers shared by the operators: reading tables, storing intermediate tables, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenaria.llm.shingles import mix
from scenaria.session import scratch_path

#: Stands for a null id where ids are compared or joined; no table may use it as an id.
NULL_ID = -(2**63)
#: Bits of a map of wanted values; 2 MB whatever the input.
MAP_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string with null as empty), whatever else the input holds."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from every column of ``df``."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def without(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, that are not in ``out`` (doc_id, digest), digest being xxhash64 of the text."""
    i, d = unused(docs, "out_id"), unused(docs, "out_digest")
    out = store(out.select(F.col("doc_id").alias(i), F.col("digest").alias(d)).distinct(), "without")
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(out, F.col("doc_id").eqNullSafe(F.col(i)) & (digest == F.col(d)), "left_anti")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared scratch folder and read it back: cuts the lineage, survives lost
    executors, and gives the planner the true size of the table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables. What was made from them must be stored itself by then, or need them no more:
    a lost task can then be run again without them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def released(run: Callable) -> Callable:
    """``run``, a function over batches, that hands its memory back to the system when its task ends. Workers are kept for
    later tasks, and what their allocators hold counts against the executor until then."""
    def tidy(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library on Linux
        if trim is not None:
            trim(0)
    return tidy


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[tuple[int, int, pa.Array]]:
    """Slices of a batch's texts with about ``most`` bytes each (a longer text comes alone), as (from, to, texts)."""
    texts = batch.column(column)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("")
    size = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(size):
        if i > start and total + n > most:
            yield start, i, texts.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(size):
        yield start, len(size), texts.slice(start)


def _slots(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(values.astype(np.int64).view(np.uint64))
    return (h & np.uint64(MAP_BITS - 1)).astype(np.int64), (h >> np.uint64(40)).astype(np.int64)


def bit_map(df: DataFrame, column: str) -> bytes:
    """A two-probe bit map of a long column, made by partition and merged; its size does not depend on the input.
    It serves to leave out most rows that cannot match before an exact join, never to decide."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MAP_BITS, dtype=bool)
        for batch in batches:
            for s in _slots(batch.column(0).to_numpy(zero_copy_only=False)):
                bits[s] = True
        packed = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["at", "word"])
    out = np.zeros(MAP_BITS // 64, dtype=np.int64)
    got = df.select(column).mapInArrow(released(local), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out[got["at"].to_numpy()] = got["word"].to_numpy()
    return out.tobytes()


def unpacked(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)


def in_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    one, two = _slots(values)
    hit = bits[one]
    hit[hit] = bits[two[hit]]
    return hit


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): one row (node, root) per node, root being
    the smallest node reachable.

    Each round points every node at the smallest root among its neighbours' roots and its own root's
    root (hooking and pointer jumping in one step), so that long chains close in a logarithmic number
    of rounds on ordinary graphs. Rounds go on until nothing changes; more than ``most_rounds`` raises.
    """
    both = store(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .where("a <> b").distinct(), f"{name}-edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), f"{name}-0")
    before = labels
    for k in range(1, most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("above"))
        # the old root hooks below the smallest root seen by any of its members
        hook = low.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hook"))
        moved = (low.join(up, "low").select("node", "root", F.least("low", "above").alias("to"))
                 .join(hook, "node", "left").select("node", F.col("root").alias("was"), F.least("to", "hook").alias("root")))
        moved = store(moved, f"{name}-{k}")
        discard(before)
        before, labels = moved, moved.select("node", "root")
        if moved.where("was <> root").isEmpty():
            discard(both)
            labels.stored_at = moved.stored_at
            return labels
    raise RuntimeError("components: rounds used up")
