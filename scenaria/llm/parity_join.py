"""N-gram Jaccard join by parity sketches.

Every shingle of a set is hashed to one bit of one 64-bit block; the sketch is the XOR of these bits.
Two sketches differ in at most as many bits as the sets' symmetric difference has members. Sets with
Jaccard >= t differ in at most D = (|a| + |b|)(1 - t)/(1 + t) members, so with more than D blocks at
least one block is equal (pigeonhole). The number of blocks is fixed per size band; a set is entered
in its own band and in each larger band that a partner can lie in.

1. Equal sets are one node, found by a 64-bit digest of the set (two different sets share one with probability 2**-64).
2. Nodes are keyed by (band, block, value), the value being the block's parity bits and the XOR of its full hashes.
   Buckets with one node fall away in a partial aggregate; a bit map spares most of their entries the next shuffle.
3. In each bucket every node is verified against its middle, the node that shares most buckets with most others, by whole sketches first (Hamming
   distance > D rules a pair out), then exactly; linked nodes are merged. A bucket of thousands of near copies so costs a linear number of verifications.
4. Buckets of three or more nodes that still hold different components are compared by whole sketches in square
   cells of bounded size that may run anywhere; what is left is verified exactly. No link between different sets is lost.

An empty block is equal in most sets and tells nothing, so only blocks with members are keyed. Small sets are dealt to
blocks several times over, with independent hashes, until the chance that a linked pair has only empty blocks in common
in every deal is below LOSS. Large sets have far more equal blocks than the one that the pigeonhole promises; of
theirs only as many are keyed as keep the chance of missing a pair below LOSS (about 60 instead of D + 1).

Null or blank texts have an empty set and link with nothing, each its own component. Null doc_ids are
carried; a component whose ids are all null has a null component_id. Repeated rows are equal sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria.llm.common import NULL_ID, bit_map, components, discard, id_text, in_map, released, store, text_chunks, unpacked, without
from scenaria.llm.shingles import buffers, distinct, mix, shingles, words

#: Ratio of a size band's ends.
BAND_RATIO = 1.4
#: Rows of one side of a comparison cell.
CELL = 1024
#: Rows of whole cells that one call compares, about.
PACK = 16_384
#: Chance, for a linked pair at the threshold, of having no keyed block with members in common.
LOSS = 1e-12
#: Words of the sketch by which whole sets are compared.
WORDS = 32
_U = np.uint64


def most_apart(total, percent: int):
    """The largest symmetric difference of two linked sets of ``total`` members together."""
    return total * (100 - percent) // (100 + percent)


def bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, blocks) of each size band up to ``largest``; sets below the first
    band can be linked with equal sets only."""
    low = 1
    while most_apart(low + low * 100 // percent, percent) < 1:
        low += 1
    out = []
    while low <= largest:
        high = max(low, int(low * BAND_RATIO))
        out.append((low, high, most_apart(2 * high, percent) + 1))
        low = high + 1
    return out


@lru_cache(None)
def keyed(low: int, blocks: int, percent: int) -> tuple[int, int]:
    """(independent deals, blocks keyed of each) of a band whose sets have ``low`` members or more.

    Of many blocks only so many are keyed that a linked pair has an equal one with members among them but for a chance below
    LOSS: ``blocks`` - 1 members differ, the common ones are the rest, and a block is equal if none of the former is in it
    and one of the latter is. Of few blocks, all are keyed, of as many deals as it takes that a pair has only empty
    blocks in common in all deals with a chance below LOSS."""
    common = low * percent // 100
    whole = (1 - 1 / blocks) ** (blocks - 1) * (1 - (1 - 1 / blocks) ** common)
    enough = math.ceil(math.log(LOSS) / math.log(1 - whole))
    if enough < blocks:
        return 1, enough
    hit = np.zeros(blocks + 1)  # distribution of the number of blocks hit
    hit[0] = 1.0
    n = np.arange(blocks + 1)
    for _ in range(blocks - 1):
        hit = hit * n / blocks + np.concatenate([[0.0], hit[:-1] * (blocks - n[:-1]) / blocks])
    alone = float((hit * (n / blocks) ** common).sum())
    return math.ceil(math.log(LOSS) / math.log(min(alone, 0.5))), blocks


def _sketch(sets: np.ndarray, at: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of ``blocks[i]`` words for set i: (all words, index of each set's first word)."""
    count = np.diff(at)
    base = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    h = mix(sets ^ _U(0xA0761D6478BD642F))
    block = ((h >> _U(32)) * np.repeat(blocks, count).astype(_U)) >> _U(32)
    out = np.zeros(base[-1], dtype=_U)
    np.bitwise_xor.at(out, np.repeat(base[:-1], count) + block.astype(np.int64), _U(1) << (h & _U(63)))
    return out, base


def _block_values(sets: np.ndarray, at: np.ndarray, blocks: int, kept: int, deal: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, whether it has members) of the first ``kept`` of ``blocks`` blocks of each set: the XOR of its members' full
    hashes mixed with their parity bits. Each deal throws the members into blocks anew."""
    n, count = len(at) - 1, np.diff(at)
    h = mix(sets ^ _U((0xA0761D6478BD642F + deal * 0x9E3779B97F4A7C15) % 2**64))
    block = (((h >> _U(32)) * _U(blocks)) >> _U(32)).astype(np.int64)
    which = np.flatnonzero(block < kept) if kept < blocks else slice(None)
    h = h[which]
    place = np.repeat(np.arange(n) * kept, count)[which] + block[which]
    parity, total, full = np.zeros(n * kept, _U), np.zeros(n * kept, _U), np.zeros(n * kept, bool)
    np.bitwise_xor.at(parity, place, _U(1) << (h & _U(63)))
    np.bitwise_xor.at(total, place, h * _U(0xE7037ED1A0B428DB))
    full[place] = True
    return mix(parity) ^ total, full


def _sets(chunk: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    h, first, _, _ = words(*buffers(chunk))
    return distinct(*shingles(h, first, width))


def set_digest(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set: two mixed sums over its members and its size."""
    out = np.diff(at).astype(_U)
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(sets ^ _U(salt)), dtype=_U)])
        out = mix(out * _U(0x9E3779B97F4A7C15) + (total[at[1:]] - total[at[:-1]]))
    return out.view(np.int64)


def profile_batch(rows: pa.RecordBatch, sets: np.ndarray, at: np.ndarray, key: np.ndarray, base: np.ndarray, seen: set) -> pa.RecordBatch:
    """(doc_id, digest, n_shingles, node, keys); a node that this task has met before needs no keys again."""
    node = set_digest(sets, at)
    fresh = np.ones(len(node), bool)
    for i, x in enumerate(node.tolist()):
        if x in seen:
            fresh[i] = False
        else:
            seen.add(x)
    count = np.where(fresh, np.diff(base), 0)
    key = key[np.repeat(fresh, np.diff(base))]
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id"), rows.column("digest"), pa.array(np.diff(at)), pa.array(node),
         pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(key))],
        names=["doc_id", "digest", "n_shingles", "node", "keys"])


PROFILE = "doc_id long, digest long, n_shingles long, node long, keys array<long>"


def _band_entries(size: np.ndarray, percent: int) -> list[tuple[np.ndarray, int, int, int]]:
    """(indices of sets, band, blocks, smallest size of the band): each set in its own band and those larger partners may be in."""
    out = []
    for b, (low, high, blocks) in enumerate(bands(percent, int(size.max(initial=0)) * 100 // percent + 1)):
        if len(own := np.flatnonzero((size <= high) & (size * 100 // percent >= low) & (size > 0))):
            out.append((own, b, blocks, low))
    return out


def _take(sets: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(at)[which]
    to = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    return sets[np.repeat(at[which] - to[:-1], count) + np.arange(to[-1])], to


def _keys(sets: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of each set: a hash of (band, deal, block, value) for each keyed block with members."""
    n = len(at) - 1
    parts, owner = [], []
    for own, band, blocks, low in _band_entries(np.diff(at), percent):
        part = _take(sets, at, own)
        deals, kept = keyed(low, blocks, percent)
        for deal in range(deals):
            value, full = _block_values(*part, blocks, kept, deal)
            place = np.tile(np.arange(kept, dtype=_U) + _U(deal * kept), len(own))
            key = mix(mix(value ^ _U(0x8BB84B93962EACC9)) + place * _U(0x9E3779B97F4A7C15) + _U(band + 1))
            parts.append(key[full])
            owner.append(np.repeat(own, kept)[full])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    key, owner = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return key[order].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


def _profile(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for s, e, chunk in text_chunks(batch):
                sets, at = _sets(chunk, width)
                yield profile_batch(batch.slice(s, e - s), sets, at, *_keys(sets, at, percent), seen)
    return run


def _fetch(width: int, wanted: bytes, sketches: bool):
    """Sketches, or else whole sets, of the documents whose id is in the bit map, each node once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(wanted)
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(in_map(bits, ids)))
            for s, e, chunk in text_chunks(batch):
                sets, at = _sets(chunk, width)
                node = set_digest(sets, at)
                fresh = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)
                values, base = _sketch(sets, at, np.full(e - s, WORDS)) if sketches else (sets, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), pa.array(values.view(np.int64)))],
                    names=["node", "n_shingles", "held"]).filter(pa.array(fresh))
    return run


def _held(source: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, sketches: bool, name: str) -> DataFrame:
    """(node, n_shingles, held) of ``nodes``, and of some others, stored: their sketches or their whole sets. The texts are
    read again, by the smallest id that has the node, so that no set is kept or shuffled that no pair asks for."""
    ids = F.coalesce("doc_id", F.lit(NULL_ID))
    reps = rows.groupBy("node").agg(F.min(ids).alias("rep")).join(nodes, "node", "left_semi")
    return store(source.mapInArrow(released(_fetch(width, bit_map(reps, "rep"), sketches)), "node long, n_shingles long, held array<long>")
                 .where("n_shingles > 0"), name)


def _entries(full: bytes):
    """(bucket, node) of the stored keys that may lie in a bucket of several nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(full)
        for batch in batches:
            lists = batch.column("keys")
            key = lists.flatten().to_numpy(zero_copy_only=False)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            hit = in_map(bits, key)
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(node[hit])], names=["bucket", "node"])
    return run


def _near_in_cell(node, root, size, sketch, first: int, percent: int) -> np.ndarray:
    """Pairs of nodes of different components in one cell that whole sketches don't rule out: each of the rows before
    ``first`` with each from ``first`` on, or, with ``first`` 0, every two rows."""
    found = []
    for i in range(first or len(node) - 1):
        rest = slice(first or i + 1, None)
        apart = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        ok = (apart <= most_apart(size[i] + size[rest], percent)) & (root[rest] != root[i])
        if ok.any():
            other = node[rest][ok]
            found.append(np.stack([np.minimum(node[i], other), np.maximum(node[i], other)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _cells(percent: int):
    """The near pairs of all cells of a pack of cells."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bucket, low, high, chunk = (rows[c].to_numpy(np.int64) for c in ("bucket", "low", "high", "chunk"))
        order = np.lexsort((chunk, high, low, bucket))
        node, root, size = (rows[c].to_numpy(np.int64)[order] for c in ("node", "root", "n_shingles"))
        sketch = np.concatenate(rows["held"].to_list()).reshape(len(rows), WORDS).view(_U)[order]
        bucket, low, high, chunk = bucket[order], low[order], high[order], chunk[order]
        new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
        found = [np.zeros((0, 2), np.int64)]
        for s, e in zip([0, *new.tolist()], [*new.tolist(), len(node)]):
            first = 0 if low[s] == high[s] else int(np.searchsorted(chunk[s:e], high[s]))
            if first < e - s:  # else one side of the cell is empty
                found.append(_near_in_cell(node[s:e], root[s:e], size[s:e], sketch[s:e], first, percent) if first or low[s] == high[s] else found[0])
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])
    return run


def _verified(pairs: DataFrame, source: DataFrame, rows: DataFrame, sketches: DataFrame, percent: int, width: int, name: str) -> DataFrame:
    """The pairs (a, b) whose sets have the asked similarity, stored: by whole sketches, then by exact intersection."""
    def side(of: DataFrame, c: str) -> DataFrame:
        return of.select(F.col("node").alias(c), F.col("held").alias(f"held_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    apart = F.aggregate(F.zip_with("held_a", "held_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    total = F.col("n_a") + F.col("n_b")
    near = store(pairs.join(side(sketches, "b"), "b").join(side(sketches, "a"), "a")
                 .where(apart * (100 + percent) <= total * (100 - percent)).select("a", "b"), f"{name}-near")
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _held(source, rows, nodes, width, False, f"{name}-sets")
    both = F.size(F.array_intersect("held_a", "held_b"))
    out = store(near.join(side(sets, "b"), "b").join(side(sets, "a"), "a").where(100 * both >= percent * (total - both)).select("a", "b"), name)
    discard(near, sets)
    return out


def jaccard_components(docs: DataFrame, percent: int = 90, width: int = 3, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, digest, n_shingles, component_id), digest being xxhash64 of the text.

    Documents link when 100 * |a & b| >= percent * |a | b| over the sets of ``width``-word shingles;
    component_id is the smallest doc_id reachable by links, the document's own included.
    """
    source = id_text(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    rows = store(source.mapInArrow(released(_profile(width, percent)), PROFILE), "parity-rows")
    return link_classes(source, rows, percent, width)


def link_classes(source: DataFrame, rows: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id) from stored ``rows`` (PROFILE) of the texts in ``source``: sets that share
    a key are candidates, links are verified exactly. The result is stored; ``rows`` and all tables between are deleted."""
    full = (rows.select("node", F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z"))
            .where("a < z").select("bucket"))
    full = store(full, "parity-full")
    shared = store(rows.select("node", "keys").mapInArrow(released(_entries(bit_map(full, "bucket"))), "bucket long, node long")
                   .join(full, "bucket").select("bucket", "node").distinct(), "parity-entries")
    # the middle of a bucket is its node with most company over all its buckets: in a group of near copies, the least edited
    company = shared.groupBy("bucket").agg(F.count("*").alias("m"))
    score = shared.join(company, "bucket").groupBy("node").agg(F.sum("m").alias("score"))
    middle = shared.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("middle"))
    entries, shared = shared, store(shared.join(middle, "bucket"), "parity-shared")
    discard(full, entries)
    sketches = _held(source, rows, shared.select("node").distinct(), width, True, "parity-sketches")

    star = shared.where("node <> middle").select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b")).distinct()
    links = _verified(star, source, rows, sketches, percent, width, "parity-star")
    label = components(links, "parity-star")

    bucket_root = shared.join(label, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    bucket_root = store(bucket_root, "parity-roots")
    discard(shared)
    mixed = (bucket_root.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m"))
             .where("r0 < r1 and m > 2").select("bucket", "m", F.ceil(F.col("m") / CELL).cast("int").alias("chunks")))
    mixed_rows = (bucket_root.join(mixed.select("bucket", "chunks"), "bucket")
                  .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
                  .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
                  .select("bucket", "node", "root", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")))
    # many small cells make one pack, whole cells of about PACK rows together; packs are as many as the rows ask for
    packs = 1 + mixed.agg(F.coalesce(F.sum(F.col("m") * F.col("chunks")), F.lit(0))).first()[0] // PACK
    pack = F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(packs)).alias("pack")
    tasks = int(min(packs, 4 * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    more = (mixed_rows.join(sketches, "node").select("*", pack).repartition(tasks, "pack").groupBy("pack")
            .applyInPandas(_cells(percent), "a long, b long").distinct())
    found = _verified(more, source, rows, sketches, percent, width, "parity-rest")
    discard(sketches, bucket_root)
    if not found.isEmpty():
        first, label = label, components(links.union(found), "parity-all")
        discard(first)
    discard(links, found)
    by_node = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep")).join(label, "node", "left")
    by_node = by_node.select("node", "rep", F.coalesce("root", "node").alias("root"))
    smallest = by_node.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = by_node.join(smallest, "root").select("node", "component_id")
    out = store(rows.select("doc_id", "digest", "n_shingles", "node").join(named, "node", "left")
                .select("doc_id", "digest", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")),
                "parity-classes")
    discard(rows, label)
    return out


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs``, unchanged, of one document of each component: the one of smallest doc_id.

    Rows that share id and text are one document. Rows that share the smallest id with different texts all stay, and so
    do the rows of a component in which every id is null."""
    found = jaccard_components(docs, percent, width)
    kept = without(docs, found.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))))
    twice = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "digest").count().where("count > 1")
    return kept if twice.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
