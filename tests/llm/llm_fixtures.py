"""Small made-up tables shared by the tests of the corpus operators."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASH = ["node", "bucket", "digest", "keys", "row", "k", "h", "root", "score", "spans", "base", "out_id", "p0", "shard", "tokens"]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}{'abcdefgh'[rng.randrange(8)]}" for _ in range(n)]


def edited(rng, w, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else x for x in w]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids, texts)], DOCS)


def odd(spark):
    """Null ids and texts, empty and blank texts, a very long one, ties, repeated rows, and clashing columns."""
    from pyspark.sql import functions as F

    long = " ".join(words(random.Random(5), 40_000))
    texts = [None, "", "   \n\t", "one", "one", "same text here now", "same text here now", long, "Ünïcode – 漢字 🙂 ▁x", "\0nul", "a b", None]
    ids = [0, 1, 2, 3, 3, 4, 5, 6, 7, 8, None, None]
    df = frame(spark, texts, ids)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(ids, texts, width, percent):
    sets = [shingle_set(t, width) for t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y, key=lambda k: ids[k])] = min(x, y, key=lambda k: ids[k])
    return {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(ids))}
