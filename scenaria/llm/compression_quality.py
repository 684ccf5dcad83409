"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad labelled text. A text is cut into pieces of
``piece`` bytes (so that a long text's own past does not drown the dictionary), each is compressed with both, and
two figures follow: the difference of the two compressed sizes per byte (positive: closer to good text) and the
smaller size per byte (text that repeats itself shrinks to nothing under either). A logistic curve of second
degree in both, fitted on other labelled texts and weighted to the labels' own balance, makes the score.

Only the learning sample is bounded: at most ``per_label`` texts and ``sample_bytes`` bytes of each label, taken by
smallest hash of the id. A text of more than ``sample_bytes`` / 64 characters is learned from by its first ones, so that a
long text leaves room for others. One half builds the dictionary, the other fits the curve. Every document is scored whole.

A label row without a document or with a null label is not used. A document with several label rows is
learned from once for each. If a label has no text at all, every score is the share of label 1 with one
added observation of each. An empty or null text scores as a text of no bytes, deterministically.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenaria.llm.common import id_text, released


@dataclass(frozen=True)
class Model:
    """What scoring needs; a few hundred kB whatever the input."""
    dictionaries: tuple[bytes, bytes]  # of label 0 and label 1
    centre: tuple[float, float]
    spread: tuple[float, float]
    weights: tuple[float, ...]
    piece: int
    level: int


def _pieces(text: bytes, size: int) -> list[bytes]:
    return [text[i: i + size] for i in range(0, len(text), size)]


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(pieces)[-size:]


class _Sizes:
    def __init__(self, dictionaries: tuple[bytes, bytes], piece: int, level: int):
        self.piece = piece
        self.compress = []
        for d in dictionaries:
            held = zstandard.ZstdCompressionDict(d)
            held.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False,
                                                          write_checksum=False, write_dict_id=False).compress)

    def figures(self, text: bytes) -> tuple[float, float]:
        bad = good = 0
        for p in _pieces(text, self.piece):
            bad += len(self.compress[0](p))
            good += len(self.compress[1](p))
        n = max(1, len(text))
        return (bad - good) / n, min(bad, good) / n


def _terms(x: np.ndarray, centre, spread) -> np.ndarray:
    q = np.clip((x - np.asarray(centre)) / np.asarray(spread), -4, 4)
    return np.column_stack([np.ones(len(q)), q[:, 0], q[:, 1], q[:, 0] ** 2, q[:, 0] * q[:, 1], q[:, 1] ** 2])


def fit(texts: list[tuple[str, int]], share: float, piece: int = 512, level: int = 3, dictionary: int = 112 * 1024) -> Model | None:
    """A model from (text, label) pairs; ``share`` is the labels' true share of 1."""
    by = {q: [t.encode() for t, y in texts if y == q] for q in (0, 1)}
    if not by[0] or not by[1]:
        return None
    half = {q: by[q][::2] for q in by}
    rest = {q: by[q][1::2] or by[q] for q in by}
    dicts = tuple(_dictionary([p for t in half[q] for p in _pieces(t, piece)], dictionary) for q in (0, 1))
    if not all(dicts):
        return None
    sizes = _Sizes(dicts, piece, level)
    x = np.array([sizes.figures(t) for q in (0, 1) for t in rest[q]])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    w = np.where(y == 1, share / len(rest[1]), (1 - share) / len(rest[0])) * len(y)
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    p = _terms(x, centre, spread)
    a = np.zeros(p.shape[1])
    for _ in range(40):  # Newton steps with a slight ridge
        z = 1 / (1 + np.exp(-np.clip(p @ a, -30, 30)))
        a = a + np.linalg.solve((p * (w * z * (1 - z))[:, None]).T @ p + 0.05 * np.eye(len(a)), p.T @ (w * (y - z)) - 0.05 * a)
    return Model(dicts, tuple(centre), tuple(spread), tuple(a), piece, level)


def learning_rows(labels: DataFrame, docs: DataFrame, per_label: int, sample_bytes: int) -> DataFrame:
    """(text, quality) of the bounded sample of the given label rows (doc_id, quality)."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = None
    for q in (0, 1):  # a bounded top-k for each label
        top = labels.where(F.col("quality") == q).orderBy(*order).limit(per_label)
        few = top if few is None else few.unionByName(top)
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("quality").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    docs = docs.withColumn("text", F.substring("text", 1, max(1, sample_bytes // 64)))  # at most a sixteenth in bytes
    return docs.join(F.broadcast(few), "doc_id").withColumn("so_far", size).where(F.col("so_far") <= sample_bytes).select("text", "quality")


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2000, sample_bytes: int = 16 << 20) -> tuple[Model | None, float]:
    """(model, share of label 1) from all label rows given; docs (doc_id, text), labels (doc_id, quality)."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    n, ones = labels.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    share = (ones + 1) / (n + 2)
    texts = [(r.text, r.quality) for r in learning_rows(labels, id_text(docs), per_label, sample_bytes).collect()]
    return fit(sorted(texts), share), share


def _scores(model: Model, sizes: _Sizes, texts: pa.Array) -> np.ndarray:
    x = np.array([sizes.figures((t or "").encode()) for t in texts.to_pylist()]).reshape(-1, 2)
    return 1 / (1 + np.exp(-np.clip(_terms(x, model.centre, model.spread) @ np.asarray(model.weights), -30, 30)))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(model.dictionaries, model.piece, model.level)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, sizes, batch.column("text")))], names=["doc_id", "score"])
    return run


def scored(docs: DataFrame, model: Model | None, share: float) -> DataFrame:
    """(doc_id, score) of every row; docs (doc_id, text)."""
    docs = id_text(docs)
    if model is None or math.isnan(sum(model.weights)):
        return docs.select("doc_id", F.lit(share).alias("score"))
    return docs.mapInArrow(released(_scorer(model)), "doc_id long, score double")


def held_out(column: str = "doc_id"):
    """True for the rows labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from the labels that are not held out."""
    model, share = train(docs, labels.where(F.coalesce(~held_out(), F.lit(False))))
    return scored(docs, model, share).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores ``threshold`` or more."""
    model, share = train(docs, labels.where(F.coalesce(~held_out(), F.lit(False))))
    if model is None:
        return docs if share >= threshold else docs.limit(0)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(model.dictionaries, model.piece, model.level)
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, sizes, batch.column("text")) >= threshold))
    return docs.mapInArrow(released(run), docs.schema)
