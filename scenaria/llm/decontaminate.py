"""Benchmark decontamination: n-gram seeds, then Smith-Waterman.

Words are runs of letters and digits of any script (A-Z lower-cased), so that case, punctuation and spaces play no part;
each character of a script without spaces (Han, kana, Thai and others) is a word. Every run of ``width`` words of a test
item is a seed; an item of fewer words is one seed as a whole.

1. Documents are searched for seeds in one pass; stretches around hits are cut out (as word hashes) with a margin
   of the longest item. A fixed-size bit map leaves out other n-grams before the exact join on the seed.
2. Each stretch is taken with every item it shares a seed with, however often the seed occurs in the corpus, so that
   edited and partial copies repeated any number of times are found. Stretches of equal words are aligned once. A pair
   is spared its alignment only where the item's words that occur in the stretch cannot add up to the threshold.
3. Word-level Smith-Waterman (match 2, mismatch and gap -1) aligns item and stretch; the best local score divided by
   that of the whole item is the score: 1 for a verbatim copy, lower for edited, paraphrased or partial ones (a copy
   with three words of ten replaced scores 0.55, one half of an item 0.5).

Texts without a word match nothing. Items are told apart by id and text, those with a null id too.
Repeated document rows share one result. Several items with equal texts are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria.llm.common import bit_map, id_text, in_map, released, store, text_chunks, unpacked, without
from scenaria.llm.shingles import buffers, mix, shingles, words

#: Score of a matching word; a word replaced, left out or put in costs 1.
MATCH = 2


def _seeds(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``width`` words as in ``shingles``; runs of different widths differ."""
    sh, at = shingles(h, first, width, short=False)
    return mix(sh ^ np.uint64(width)), at


def _items(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, chunk in text_chunks(batch):
                h, first, _, _ = words(*buffers(chunk), of=None)
                size = np.diff(first)
                out = [np.zeros(0, np.int64)] * len(size)
                for w in range(1, width + 1):
                    sh, at = _seeds(h, first, w)
                    for i in np.flatnonzero((size == w) | (w == width) & (size > w)).tolist():
                        out[i] = sh[at[i]: at[i + 1]].view(np.int64)
                at = np.concatenate([[0], np.cumsum([len(x) for x in out])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s, e - s), batch.column("item").slice(s, e - s), pa.array(np.minimum(size, width).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(out)))],
                    names=["item_id", "item", "width", "words", "seeds"])
    return run


def _hits(bits: np.ndarray, h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, width, seed) of the seeds in the map."""
    sh, at = _seeds(h, first, width)
    hit = np.flatnonzero(in_map(bits, sh.view(np.int64)))
    doc = np.searchsorted(at, hit, "right") - 1
    return doc, hit - at[doc], np.full(len(hit), width), sh[hit]


def _stretches(widths: list[int], margin: int, seeds: bytes):
    """Runs of words around the hits of each text; hits nearer than twice the margin share a run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(seeds)
        for batch in batches:
            for s, e, chunk in text_chunks(batch):
                h, first, _, _ = words(*buffers(chunk), of=None)
                doc, place, wide, seed = (np.concatenate(x) for x in zip(*(_hits(bits, h, first, w) for w in widths)))
                if not len(doc):
                    continue
                if len(widths) > 1:
                    order = np.lexsort((wide, place, doc))
                    doc, place, wide, seed = doc[order], place[order], wide[order], seed[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > 2 * margin)
                run_at = np.append(np.flatnonzero(new), len(doc))
                begin = np.maximum(place[run_at[:-1]] - margin, 0)
                d = doc[run_at[:-1]]
                end = np.minimum(np.maximum.reduceat(place + wide, run_at[:-1]) + margin, np.diff(first)[d])
                count = end - begin
                base = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
                flat = h[np.repeat(first[d] + begin - base[:-1], count) + np.arange(base[-1])]
                rows = pa.array(d + s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("digest").take(rows), pa.array(begin),
                     pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), pa.array(flat.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(run_at.astype(np.int32)), pa.array(seed.view(np.int64)))],
                    names=["doc_id", "digest", "start", "words", "hits"])
    return run


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local score, place after its last word in ``text``)."""
    m = len(text)
    step = np.arange(m + 1)
    row = np.zeros(m + 1, np.int64)
    best, at = 0, 0
    for w in item:
        new = np.maximum(row - 1, 0)
        np.maximum(new[1:], row[:-1] + np.where(text == w, MATCH, -1), out=new[1:])
        new = np.maximum.accumulate(new + step) - step  # gaps along the text
        j = int(new.argmax())
        if new[j] > best:
            best, at = int(new[j]), j
        row = new
    return best, at


def _align(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (item, text) in enumerate(zip(batch.column("item_words"), batch.column("words"))):
                a, b = (x.values.to_numpy(zero_copy_only=False) for x in (item, text))
                whole = MATCH * len(a)
                if MATCH * np.isin(a, b).sum() / whole < threshold:  # no alignment has more matches
                    continue
                best, end = smith_waterman(a, b)
                if best / whole < threshold:
                    continue
                back, length = smith_waterman(a[::-1], b[:end][::-1])
                out.append((k, best / whole, end - length, end))
            k, score, begin, end = (np.array(x) for x in zip(*out)) if out else [np.zeros(0, int)] * 4
            rows = pa.array(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("stretch").take(rows), batch.column("item").take(rows), pa.array(score.astype(float)),
                 pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64))],
                names=["stretch", "item", "score", "begin", "end"])
    return run


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 3, threshold: float = 0.45, common: int = 8,
            floor: int = 1000, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(doc_id, digest, item_id, score, first_word, end_word): the best alignment of each document (told apart by id and
    xxhash64 of its text) with each item, where the score reaches ``threshold``. ``common`` and ``floor`` are accepted
    from earlier callers and have no effect: no seed is dropped for its frequency."""
    source = id_text(benchmark, item_col).withColumn("item", F.xxhash64("text")).distinct()
    named = store(source.mapInArrow(released(_items(width)), "item_id long, item long, width int, words array<long>, seeds array<long>"), "leak-items")
    # equal texts are searched for once
    items = named.groupBy("item").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds"))
    seeds = store(items.select("item", F.explode("seeds").alias("seed")).distinct(), "leak-seeds")
    margin = named.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()[0]
    widths = sorted(r.width for r in named.select("width").where("width > 0").distinct().collect()) or [width]
    source = id_text(docs, id_col).withColumn("digest", F.xxhash64("text"))
    stretches = store(source.mapInArrow(released(_stretches(widths, margin, bit_map(seeds, "seed"))),
                                        "doc_id long, digest long, start long, words array<long>, hits array<long>")
                      .withColumn("stretch", F.xxhash64("words")), "leak-stretches")
    # equal words have equal hits
    texts = store(stretches.groupBy("stretch").agg(F.first("words").alias("words"), F.first("hits").alias("hits")), "leak-texts")
    hits = texts.select("stretch", F.explode(F.array_distinct("hits")).alias("seed"))
    pairs = hits.join(seeds, "seed").select("stretch", "item").distinct()
    rows = (pairs.join(items.select("item", F.col("words").alias("item_words")), "item")
            .join(texts.drop("hits"), "stretch").select("stretch", "item", "item_words", "words"))
    found = store(rows.mapInArrow(released(_align(threshold)), "stretch long, item long, score double, begin long, end long"), "leak-found")
    found = (stretches.select("doc_id", "digest", "start", "stretch").join(found, "stretch")
             .select("doc_id", "digest", "item", "score", (F.col("start") + F.col("begin")).alias("first_word"),
                     (F.col("start") + F.col("end")).alias("end_word"))
             .join(named.select("item_id", "item"), "item"))
    best = F.max(F.struct("score", -F.col("first_word"), "first_word", "end_word"))
    nameless = F.when(F.col("item_id").isNull(), F.col("item")).alias("nameless")
    return (found.groupBy("doc_id", "digest", "item_id", nameless).agg(best.alias("b"))
            .select("doc_id", "digest", "item_id", "b.score", "b.first_word", "b.end_word"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, unchanged, that match no item."""
    return without(docs, matches(docs, benchmark, **options))
