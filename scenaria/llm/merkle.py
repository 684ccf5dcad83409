"""Merkle manifest of a dataset: a digest tree over each source's documents, and one over the sources.

A leaf is the digest of a document's doc_id, source, lang, n_chars and text, each written as ``-`` if null, else as its
number of bytes, ``:`` and its value. The leaves of a source stand in order of doc_id (null ids first, equal ids by leaf); every
WAYS consecutive nodes become their digest (the last run may be shorter, even one node) until one is left, the source's root.
The sources' roots in bytewise order of their names (null first) make the dataset's root in the same way.

Positions come from range partitions: rows are dealt by (source, doc_id, leaf), numbered in their partition, and moved on by
the counts of the partitions before. So a source with a third of all rows is numbered by many tasks.

BLOCK consecutive leaves of a source are one row that keeps each level as one string of concatenated digests. Parents are
the digests of its substrings of fixed width, and the siblings of a node are the substrings on both sides of it in its run. A
block ends in one node; the blocks' nodes of a source are positions of the next round, and so on until each source has its root.
Then the rounds are gone through backwards: each node's path is its siblings in its block, then its block's path.

``manifest`` gives each document its leaf, its path (pairs of the digests left and right of it, level by level) and the roots;
``folded`` recomputes a root from a leaf and a path.

Nulls are values like others (a null source is a source of its own). Repeated rows are leaves of their own, and their
order among each other does not matter, as their leaves are equal. A single document is its source's root and, alone, the
dataset's. An empty table gives an empty result. Only the named columns are read, and those that the caller carries along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenaria.llm.common import discard, store

WAYS = 16
#: Levels of a block, and the leaves under it: a row of at most 262 KB for each level.
LEVELS = 3
BLOCK = WAYS**LEVELS
#: Characters of a digest.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as ``-`` or as number of bytes, colon, value."""
    def written(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[written(c) for c in fields]), 256)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, their place in their group (from 0, by ``order``, nulls first), and ``n``, its number of rows.
    Rows that are equal in group and order may lie in several partitions."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col("tie")]
    rows = store(rows.withColumn("tie", F.monotonically_increasing_id()), name)  # ranges are drawn from a sample: read twice, not computed twice
    dealt = store(rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), f"{name}-dealt")
    discard(rows)
    counts = dealt.groupBy(group, "part").agg(F.count("*").alias("m"))
    whole, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(*keys))
    return (dealt.withColumn("place", place).join(counts, [group, "part"])
            .withColumn("pos", F.col("before") + F.col("place") - 1).drop("part", "tie", "place", "before"))


def _parents(level: Column) -> Column:
    """The level above a string of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (WAYS * WIDTH)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(_run(level, i), 256)), "")


def _run(level: Column, i: Column) -> Column:
    """Run ``i`` of a level."""
    return F.substr(level, i * (WAYS * WIDTH) + 1, F.lit(WAYS * WIDTH))


def _siblings(run: Column, place: Column) -> Column:
    """The digests left and right of a place in its run."""
    return F.struct(F.substr(run, F.lit(1), place * WIDTH).alias("left"), F.substr(run, (place + 1) * WIDTH + 1, F.lit(WAYS * WIDTH)).alias("right"))


def _blocks(nodes: DataFrame, carried: list[str], name: str) -> DataFrame:
    """One row for BLOCK positions of a group: its nodes in order, its levels, its last node ``top``."""
    item = F.struct((F.col("pos") % BLOCK).cast("int").alias("place"), "node", *carried)
    rows = (nodes.groupBy("g", "n", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"))
            .agg(F.sort_array(F.collect_list(item)).alias("items"))
            .withColumn("level0", F.array_join("items.node", "")))
    for k in range(LEVELS):
        rows = rows.withColumn(f"level{k + 1}", F.when(F.col("n") > WAYS**k, _parents(F.col(f"level{k}"))))
    top = F.coalesce(*[F.col(f"level{k}") for k in range(LEVELS, -1, -1)])
    return store(rows.withColumn("top", top).drop(f"level{LEVELS}"), name)


def _climb(nodes: DataFrame, carried: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """(the blocks of each round, the last node of each group as (g, top)) over (g, pos, n, node)."""
    rounds = [_blocks(nodes, carried, f"{name}-0")]
    while not rounds[-1].where(F.col("n") > BLOCK).isEmpty():
        tops = rounds[-1].where(F.col("n") > BLOCK).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
                                                           F.col("top").alias("node"))
        rounds.append(_blocks(tops, [], f"{name}-{len(rounds)}"))
    last = rounds[0].where(F.col("n") <= BLOCK).select("g", "top")
    for k in rounds[1:]:
        last = last.unionByName(k.where(F.col("n") <= BLOCK).select("g", "top"))
    return rounds, store(last, f"{name}-tops")


def _paths(rounds: list[DataFrame], upper: DataFrame, name: str) -> DataFrame:
    """The nodes of the first round, with ``path``; ``upper`` is the path (g, above, further columns) above each group."""
    def opened(blocks: DataFrame) -> DataFrame:
        # first the runs, then their nodes: no row but a block's own holds a whole level
        rest = [c for c in blocks.columns if c not in {"items", "n", "top", *[f"level{k}" for k in range(LEVELS)]}]
        count = F.ceil(F.size("items") / WAYS).cast("int")
        runs = blocks.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("run"))
        runs = runs.select(*rest, "n", "run", F.slice("items", F.col("run") * WAYS + 1, F.lit(WAYS)).alias("items"),
                           *[_run(F.col(f"level{k}"), F.floor(F.col("run") / WAYS**k).cast("int")).alias(f"run{k}") for k in range(LEVELS)])
        nodes = runs.select(*rest, "n", *[f"run{k}" for k in range(LEVELS)], F.explode("items").alias("item"))
        steps = [F.when(F.col("n") > WAYS**k, _siblings(F.col(f"run{k}"), F.floor(F.col("item.place") / WAYS**k).cast("int") % WAYS)) for k in range(LEVELS)]
        own = F.filter(F.array(*steps), lambda s: s.isNotNull())
        return nodes.select(*[c for c in rest if c != "above"], "item", F.concat(own, "above").alias("path"))
    further = [c for c in upper.columns if c not in ("g", "above")]
    above = upper
    for k in range(len(rounds) - 1, -1, -1):
        blocks = rounds[k]
        single = blocks.where(F.col("n") <= BLOCK).join(upper, "g")  # the last round of its group
        if k < len(rounds) - 1:
            single = single.unionByName(blocks.where(F.col("n") > BLOCK).join(above, ["g", "block"]))
        nodes = opened(single)
        if k:
            pos = F.col("block") * BLOCK + F.col("item.place")
            above = store(nodes.select("g", pos.alias("block"), F.col("path").alias("above"), *further), f"{name}-path-{k}")
    return nodes


def manifest(docs: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, path, subroot, root, and the columns of ``also``) of every document."""
    also = also or {}
    rows = docs.select(F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("g"),
                       F.col("doc_id").cast("long").alias("doc_id"), leaf([F.col(c) for c in FIELDS]).alias("node"),
                       *[e.alias(c) for c, e in also.items()])
    rounds, subroots = _climb(numbered(rows, "g", ["doc_id", "node"], "merkle-leaves"), ["doc_id", *also], "merkle")
    sources = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("source"), F.col("top").alias("node")), "g", ["source"], "merkle-sources")
    above, root = _climb(sources, ["source"], "merkle-above")
    empty = F.array().cast("array<struct<left:string,right:string>>")
    one = root.select("g", empty.alias("above"), F.col("top").alias("root"))
    upper = _paths(above, one, "merkle-above").select(F.col("item.source").alias("g"), F.col("path").alias("above"), F.col("item.node").alias("subroot"), "root")
    nodes = _paths(rounds, store(upper, "merkle-upper"), "merkle")
    return nodes.select("item.doc_id", F.col("item.node").alias("leaf"), "path", "subroot", "root", *[f"item.{c}" for c in also])


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def tamper_report(docs: DataFrame, every: int = 5) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the roots recomputed from each document's path, after
    the texts whose id's crc32 ``every`` divides have had their A-Z lower-cased."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
    lowered = F.translate(F.col("text"), _UPPER, _UPPER.lower())
    changed = F.when(hit, leaf([lowered if c == "text" else F.col(c) for c in FIELDS]))
    rows = manifest(docs, {"changed": changed})
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"),
                       folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 6, source_levels: int = 4) -> str:
    """The same in DuckDB, for up to 16**levels documents of a source and 16**source_levels sources."""
    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    lower = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    parts = [f"""crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([CAST(i AS UBIGINT)], list_transform(range(8), lambda k: CAST(0 AS UBIGINT))),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS c FROM range(256) r(i)))""",
             f"""docs AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS g, {digest('text')} AS leaf, {digest(lower)} AS lowered,
  xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) AS crc FROM documents, crc)""",
             """d0 AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, g, leaf, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS start,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs)""",
             "n0 AS MATERIALIZED (SELECT g, pos, leaf AS h FROM d0)"]

    def climb(n: str, count: int) -> None:
        for k in range(count):
            parts.append(f"""{n}r{k} AS MATERIALIZED (SELECT g, pos // {WAYS} AS pos, list(h ORDER BY pos) AS hs FROM {n}{k}
  WHERE g IN (SELECT g FROM {n}{k} GROUP BY g HAVING count(*) > 1) GROUP BY g, pos // {WAYS})""")
            parts.append(f"{n}{k + 1} AS MATERIALIZED (SELECT g, pos, sha256(array_to_string(hs, '')) AS h FROM {n}r{k})")
        tops = " UNION ALL ".join(f"SELECT g, min(h) AS h FROM {n}{k} GROUP BY g HAVING count(*) = 1" for k in range(count + 1))
        parts.append(f"{n}top AS MATERIALIZED ({tops})")

    def fold(f: str, n: str, count: int) -> None:
        for k in range(count):
            parts.append(f"""{f}{k + 1} AS MATERIALIZED (SELECT id, f.g, f.pos // {WAYS} AS pos,
  CASE WHEN r.g IS NULL THEN acc ELSE sha256(array_to_string(hs[1:f.pos % {WAYS}], '') || acc || array_to_string(hs[f.pos % {WAYS} + 2:], '')) END AS acc,
  CASE WHEN r.g IS NULL THEN proof ELSE proof || array_to_string(hs[1:f.pos % {WAYS}], '') || array_to_string(hs[f.pos % {WAYS} + 2:], '') END AS proof
  FROM {f}{k} f LEFT JOIN {n}r{k} r ON f.g = r.g AND f.pos // {WAYS} = r.pos)""")
    climb("n", levels)
    parts.append("s0 AS MATERIALIZED (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, g AS source FROM ntop)")
    climb("s", source_levels)
    parts.append("f0 AS MATERIALIZED (SELECT id, g, pos, start AS acc, '' AS proof FROM d0)")
    fold("f", "n", levels)
    parts.append(f"u0 AS MATERIALIZED (SELECT f.id, s0.g, s0.pos, f.acc, f.proof FROM f{levels} f JOIN s0 ON f.g = s0.source)")
    fold("u", "s", source_levels)
    return "WITH " + ",\n".join(parts) + f"""
SELECT d0.doc_id, d0.leaf, ntop.h AS subroot, stop.h AS root, sha256(u.proof) AS proof_sha256, u.acc AS folded_root, u.acc = stop.h AS verified
FROM d0 JOIN ntop ON d0.g = ntop.g JOIN u{source_levels} u ON d0.id = u.id, stop"""
