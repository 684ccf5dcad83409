"""Document fingerprints by MinHash.

A document's set holds its distinct 5-word shingles (fewer words: the whole sequence as one; none: empty).
Each of ``permutations`` universal hash functions h(x) = (a x + b) mod 2**32 with odd a keeps its smallest value
over the set. The share of equal places of two signatures estimates the Jaccard similarity. The empty set has
the largest value in every place. Equal texts have equal fingerprints whatever their ids.

``fingerprints`` also signs each text after an edit: its last quarter gives way to the head of the next
document. Documents are dealt to id ranges, sorted, and streamed; the first document of each range is handed to
the range before it, so no task holds more than one range's stream position and a neighbour.

``near_groups`` joins signature bands in Spark and verifies Jaccard exactly.

Order is by doc_id, null ids first, equal ids by a hash of the text. A single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria.llm.common import NULL_ID, id_text, store, text_chunks
from scenaria.llm.parity_join import PROFILE, link_classes, profile_batch
from scenaria.llm.shingles import buffers, distinct, mix, shingles, words

_U = np.uint64


def hash_functions(permutations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, permutations, dtype=np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, permutations, dtype=np.uint32))


def least(sh: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over each segment of ``sh``; empty segments get the largest value."""
    out = np.full((len(at) - 1, len(a)), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        x = (sh >> _U(32)).astype(np.uint32)
        v = np.empty_like(x)
        for i in range(len(a)):
            np.multiply(x, a[i], out=v)
            np.add(v, b[i], out=v)
            out[full, i] = np.minimum.reduceat(v, at[:-1][full])
    return out


def _hex(signatures: np.ndarray) -> list[str]:
    width = signatures.shape[1] * 4
    whole = signatures.astype(">u4").tobytes()
    return [whole[i: i + width].hex() for i in range(0, len(whole), width)] if width else []


def _sign_with_next(ids: list, texts: list[str], a, b, width: int) -> pa.RecordBatch:
    """Rows for all of ``texts`` but the last, which only serves as the next document."""
    n = len(texts)
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    h, first, starts, ends = words(np.frombuffer(b"".join(raw), np.uint8), off)
    sh, at = shingles(h, first, width)
    tails, strict, split, digest, size = [], [], [], [], []
    for i in range(n - 1):
        t, m = texts[i], len(texts[i]) // 4
        kept = t[: len(t) - m].encode() if m else raw[i]
        new = texts[i + 1][:m].encode()
        digest.append(hashlib.sha256(kept + new).hexdigest())
        size.append(len(t))
        f, l = first[i], first[i + 1]
        whole = int(np.searchsorted(ends[f:l], off[i] + len(kept), "left"))  # words that end before the cut
        long = whole >= width
        tails.append((kept[starts[f + whole - width + 1] - off[i]:] if long else kept) + new)
        strict.append(long)
        split.append(whole - width + 1 if long else 0)
    # each text's shingles in two segments: those the edit leaves, and the others
    marks = np.empty(2 * (n - 1) + 2, np.int64)
    marks[0:-2:2] = at[:-2]
    marks[1:-2:2] = at[:-2] + np.array(split, np.int64)
    marks[-2:] = at[-2:]
    seg = least(sh, marks, a, b)
    own = np.concatenate([np.minimum(seg[0:-1:2], seg[1:-1:2]), seg[-1:]])
    toff = np.concatenate([[0], np.cumsum([len(x) for x in tails])]).astype(np.int64)
    th, tfirst, _, _ = words(np.frombuffer(b"".join(tails), np.uint8), toff)
    tsh, tat = shingles(th, tfirst, width)
    drop = np.array(strict, bool) & (np.diff(tfirst) < width)  # no shingle lies in such a tail alone
    new = least(tsh, tat, a, b)
    new[drop] = 0xFFFFFFFF
    edited = np.minimum(new, seg[0:-1:2])
    near = lambda x, y: pa.array((x == y).mean(axis=1))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[: n - 1], pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array(_hex(own[:-1])), pa.array(_hex(edited)),
         near(own[:-1], edited), near(own[:-1], own[1:])],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _stream(permutations: int, width: int, seed: int, most: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_functions(permutations, seed)
        ids, texts, total = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                texts.append(t)
                total += len(t)
                if total >= most and len(texts) > 1:
                    yield _sign_with_next(ids, texts, a, b, width)
                    ids, texts, total = ids[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:  # the last row is the next range's first
            yield _sign_with_next(ids, texts, a, b, width)
    return run


def fingerprints(docs: DataFrame, permutations: int = 128, width: int = 5, seed: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    spark = docs.sparkSession
    source = id_text(docs, id_col, text_col).withColumn("k", F.coalesce("doc_id", F.lit(NULL_ID)))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ends = source.select(F.percentile_approx("k", [i / ranges for i in range(1, ranges)] or [1.0], 10000)).first()[0]
    ends = sorted(set(ends or []))  # at most one end for each range
    bucket = F.size(F.filter(F.lit(ends) if ends else F.array().cast("array<long>"), lambda x: x < F.col("k")))
    source = source.withColumn("bucket", bucket)
    firsts = sorted(tuple(r) for r in source.groupBy("bucket").agg(F.min("k").alias("k")).collect())  # a row for each range
    if not firsts:
        return spark.createDataFrame([], OUT)
    # one row for each range; the first range's goes to the last
    before = pa.table({"k": pa.array([k for _, k in firsts], pa.int64()),
                       "bucket": pa.array([firsts[i - 1][0] for i in range(len(firsts))], pa.int32())})
    heads = (source.select("k", "doc_id", "text").join(spark.createDataFrame(before), "k")
             .groupBy("k", "bucket").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
             .select("bucket", F.lit(1).alias("guest"), "k", F.col("k").alias("doc_id"), "text"))
    dealt = source.select("bucket", F.lit(0).alias("guest"), "k", "doc_id", "text").unionByName(heads)
    return (dealt.repartitionById(len(ends) + 1, F.col("bucket"))
            .sortWithinPartitions("guest", "k", F.xxhash64("text"))
            .select("doc_id", "text").mapInArrow(_stream(permutations, width, seed), OUT))


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _banded(permutations: int, rows: int, width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_functions(permutations, seed)
        seen: set[int] = set()
        for batch in batches:
            for s, e, chunk in text_chunks(batch):
                h, first, _, _ = words(*buffers(chunk))
                sets, at = distinct(*shingles(h, first, width))
                sig = least(sets, at, a, b).reshape(e - s, permutations // rows, rows).astype(_U)
                key = np.zeros(sig.shape[:2], _U) + np.arange(1, sig.shape[1] + 1, dtype=_U)
                for j in range(rows):
                    key = mix(key * _U(0x9E3779B97F4A7C15) + sig[:, :, j])
                full = np.diff(at) > 0
                base = np.concatenate([[0], np.cumsum(np.where(full, key.shape[1], 0))]).astype(np.int64)
                yield profile_batch(batch.slice(s, e - s), sets, at, key[full].reshape(-1).view(np.int64), base, seen)
    return run


def near_groups(docs: DataFrame, percent: int = 80, permutations: int = 128, rows: int = 4, width: int = 5, seed: int = 1,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_shingles, component_id): documents that share a signature band of ``rows`` places and whose sets
    then prove to have Jaccard of ``percent`` or more are linked. At 128 places in bands of 4 a pair of similarity
    0.8 is missed with probability below 1e-7. Empty sets link with nothing."""
    source = id_text(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    profile = store(source.mapInArrow(_banded(permutations, rows, width, seed), PROFILE), "minhash-rows")
    return link_classes(source, profile, percent, width)
