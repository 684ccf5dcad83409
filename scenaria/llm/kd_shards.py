"""Sharding by a k-d tree over document metadata.

A point is a document: its dimensions are the numeric and text columns named in ``dimensions`` (text columns
by their order of value, spread evenly over the values seen), its weight the text's UTF-8 bytes plus
``overhead``. A node that stands for k shards is cut along its widest dimension (largest share of that dimension's
whole range) at the weighted quantile floor(k/2) / k, and so on until every leaf is one shard, whose bytes are then
the target. All nodes of a level are cut together: each cut is searched by counting bytes in equal steps of the
sort key, then in equal steps of the step found, until what the step holds is far below ``tolerance`` of a shard. Only
the counts leave the executors, one row for each node and step.

The sort key of a row in a dimension is (place in the dimension, hash of the text, hash of the row), so equal texts lie
together, and a cut moves to the end of such a group where that shifts at most ``tolerance`` of a shard's bytes. A
group larger than that is cut through, so one hot text cannot make a shard too large. Law: bytes.

Copies of a text share the place of the first of them (by smallest row of metadata), so they stay together too.

Null values have the lowest place of a dimension. Repeated rows are rows of their own. Null ids and texts are
carried (a null text weighs ``overhead``). Slots number a shard's rows without gaps, in order of the stored parts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenaria.llm.common import store

#: Steps counted at once for a node, and bits of the three parts of the sort key.
STEP_BITS = 13
PLACE_BITS, TEXT_BITS, ROW_BITS = 16, 24, 20
KEY_BITS = PLACE_BITS + TEXT_BITS + ROW_BITS


def _points(docs: DataFrame, dimensions: list[str], overhead: int) -> DataFrame:
    """What sharding needs of each row, without its text; stored, with a row number that stays."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    dims = [(F.col(c).cast("double") if isinstance(kinds[c], T.NumericType) else F.col(c).cast("string")).alias(f"d{i}") for i, c in enumerate(dimensions)]
    rows = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
                             F.crc32(text.cast("binary")).alias("text_crc32"),
                             F.xxhash64(text).alias("h"), *dims)
                 .withColumn("row", F.monotonically_increasing_id()), "kd-rows")
    names = [f"d{i}" for i in range(len(dimensions))]
    # stored, so that the join below has plain sides and a hot text's rows can be split among tasks
    first = store(rows.groupBy("h", "size").agg(F.min(F.struct(*reversed(names))).alias("first")), "kd-first")
    return store(rows.drop(*names).join(first, ["h", "size"])
                 .select("doc_id", "size", "text_crc32", "row", F.col("h").bitwiseAND((1 << TEXT_BITS) - 1).alias("t"),
                         *[F.col(f"first.{d}").alias(d) for d in names]), "kd-points")


def _placed(points: DataFrame, n: int) -> DataFrame:
    """``points`` with columns p0.. for the dimensions: places from 0 to 2**PLACE_BITS - 1."""
    top = (1 << PLACE_BITS) - 1
    for i in range(n):
        if isinstance(points.schema[f"d{i}"].dataType, T.StringType):
            # the order of values by a bounded sketch of quantiles of their first bytes, each value in one place
            head = F.conv(F.rpad(F.hex(F.substring(F.col(f"d{i}").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
            points = points.withColumn(f"d{i}", head)
    row = points.agg(*[F.percentile_approx(f"d{i}", [k / 64 for k in range(65)], 1000).alias(f"q{i}") for i in range(n)]).first()
    for i in range(n):
        cuts = sorted(set(row[f"q{i}"] or []))
        # an empirical distribution in at most 64 straight pieces, so that a long tail does not flatten the rest
        if len(cuts) < 2:
            place = F.lit(0)
        else:
            d, pieces = F.col(f"d{i}"), len(cuts) - 1
            k = F.greatest(F.least(F.size(F.filter(F.lit(cuts), lambda x: x <= d)), F.lit(pieces)), F.lit(1))
            low, high = F.get(F.lit(cuts), k - 1), F.get(F.lit(cuts), k)
            part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - low) / (high - low)))
            place = F.floor((k - 1 + part) / pieces * (top - 1)) + 1
        points = points.withColumn(f"p{i}", F.coalesce(place, F.lit(0)).cast("long"))
    return points.drop(*[f"d{i}" for i in range(n)])


def _key(place: Column) -> Column:
    shift = lambda c, n: F.shiftleft(c, n)
    return shift(place, TEXT_BITS + ROW_BITS) + shift(F.col("t"), ROW_BITS) + F.xxhash64("row").bitwiseAND((1 << ROW_BITS) - 1)


def _table(spark, rows: list[tuple], names: str) -> DataFrame:
    """A small local table, one row for each open node."""
    schema = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in names.split(", ")])
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema))


def kd_shards(docs: DataFrame, shards: int = 40, dimensions: tuple[str, ...] = ("source", "lang", "n_chars", "doc_id"),
              overhead: int = 16, tolerance: float = 0.01) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``."""
    spark = docs.sparkSession
    n = len(dimensions)
    points = store(_placed(_points(docs, list(dimensions), overhead), n), "kd-placed")
    total = points.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slack = tolerance * total / shards
    # open nodes: first shard of the node -> shards it stands for; closed cuts: node -> (dimension, key)
    nodes, assigned = {0: shards}, points.withColumn("node", F.lit(0))
    while any(k > 1 for k in nodes.values()):
        extent = assigned.groupBy("node").agg(F.sum("size").alias("size"), *[x(f"p{i}").alias(f"{x.__name__}{i}") for i in range(n) for x in (F.min, F.max)]).collect()
        state = {}  # node -> what the search knows; at most one entry for each shard
        for r in extent:
            k = nodes.get(r.node, 1)
            if k > 1:
                i = max(range(n), key=lambda i: (r[f"max{i}"] - r[f"min{i}"], -i))
                state[r.node] = {"dim": i, "low": 0, "bits": KEY_BITS, "below": 0, "goal": r["size"] * (k // 2) / k, "done": False}
        while not all(s["done"] for s in state.values()):
            going = [(m, s["dim"], s["low"], max(0, s["bits"] - STEP_BITS)) for m, s in state.items() if not s["done"]]
            look = _table(spark, going, "node int, dim int, low long, shift int")
            place = F.get(F.array(*[F.col(f"p{i}") for i in range(n)]), F.col("dim"))
            step = F.expr("shiftright(k - low, shift)")
            counts = (assigned.join(F.broadcast(look), "node").withColumn("k", _key(place)).withColumn("step", step)
                      .where(F.col("step").between(0, (1 << STEP_BITS) - 1)).groupBy("node", "step").agg(F.sum("size").alias("size")))
            run = Window.partitionBy("node").orderBy("step")  # at most 2**STEP_BITS rows for each node
            goals = _table(spark, [(m, float(state[m]["goal"] - state[m]["below"])) for m, *_ in going], "node int, goal double")
            found = (counts.withColumn("upto", F.sum("size").over(run)).join(F.broadcast(goals), "node")
                     .where(F.col("upto") >= F.col("goal")).groupBy("node").agg(F.min(F.struct("step", "upto", "size")).alias("x")).collect())
            hit = {r.node: r.x for r in found}
            for m, _, low, shift in going:
                s = state[m]
                if m not in hit:  # nothing reaches the goal any more (rounding): everything goes to the left
                    s |= {"done": True, "cut": (1 << KEY_BITS) - 1}
                    continue
                x = hit[m]
                s["below"] += x.upto - x["size"]
                s["low"], s["bits"] = low + (x.step << shift), shift
                if x["size"] <= slack / 4 or shift == 0:
                    s |= {"done": True, "cut": s["low"] + (1 << shift) - 1}
        # move each cut to an end of the equal texts it falls into, where few bytes are between
        if state:
            edge = _table(spark, [(m, s["dim"], s["cut"]) for m, s in state.items()], "node int, dim int, cut long")
            place = F.get(F.array(*[F.col(f"p{i}") for i in range(n)]), F.col("dim"))
            same = F.expr(f"shiftright(k, {ROW_BITS}) = shiftright(cut, {ROW_BITS})")
            moved = (assigned.join(F.broadcast(edge), "node").withColumn("k", _key(place)).where(same).groupBy("node")
                     .agg(F.sum(F.when(F.col("k") > F.col("cut"), F.col("size")).otherwise(0)).alias("after"),
                          F.sum(F.when(F.col("k") <= F.col("cut"), F.col("size")).otherwise(0)).alias("before")).collect())
            for r in moved:
                s = state[r.node]
                group = s["cut"] >> ROW_BITS
                if min(r.after, r.before) <= slack:
                    s["cut"] = ((group + 1) << ROW_BITS) - 1 if r.after <= r.before else (group << ROW_BITS) - 1
        cuts = _table(spark, [(m, s["dim"], s["cut"], m + nodes[m] // 2) for m, s in state.items()], "node int, dim int, cut long, right int")
        place = F.get(F.array(*[F.col(f"p{i}") for i in range(n)]), F.col("dim"))
        assigned = (assigned.join(F.broadcast(cuts), "node", "left")
                    .withColumn("node", F.when(_key(place) > F.col("cut"), F.col("right")).otherwise(F.col("node"))).drop("dim", "cut", "right"))
        grown = {}
        for m, k in nodes.items():
            if m in state:
                grown[m], grown[m + k // 2] = k // 2, k - k // 2
            else:
                grown[m] = 1  # one shard, or a node without rows
        nodes = grown
    part = F.shiftright("row", 33)  # the stored part a row came from
    rows = store(assigned.select("doc_id", "size", "text_crc32", "row", F.col("node").alias("shard"), part.alias("part")), "kd-shards")
    count = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    first = count.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return (rows.withColumn("place", within).join(first, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
