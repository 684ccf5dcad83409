"""Secret scan with built-in functions only: fixed patterns, and character Markov models.

Base patterns give spans of kinds assign, access and hex. Further spans of kind ``markov`` come from long tokens
whose log-likelihood ratio between a Markov chain of random strings and one of ordinary identifiers is high enough;
both chains are trained from labelled samples. Positions count code points from 0, ends exclusive.

A null or empty text has no spans. Repeated rows are scanned each. Spans of one text sort by start, then kind as
listed in KINDS; a markov span that meets a base span is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria.llm.common import id_text, unused

#: The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters or more
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: Tokens the models judge: 16 characters or more with a letter, not part of a longer word.
TOKEN = r"(?<![\p{L}\p{N}+/_-])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}(?![\p{L}\p{N}])"
#: Characters that the chains know; others never occur in tokens.
ALPHABET = 26 + 26 + 10 + 5
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _hits(text: Column, pattern: str, kind: int, keep=None, marks: tuple[str, ...] = ()) -> Column:
    """Spans of the leftmost non-overlapping matches for which ``keep(match)`` holds: the text's pieces between the
    matches give the positions. Every match holds one of ``marks``; texts without them skip the pattern."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    whole = F.struct(pieces.alias("p"), hits.alias("h"))
    def step(acc, i, w):
        hit = F.get(w["h"], i)
        start = acc["at"] + F.length(F.get(w["p"], i))
        end = start + F.length(hit)
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        good = F.lit(True) if keep is None else keep(hit)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))
    none = F.array().cast(_SPANS)
    def walk(w):
        return F.aggregate(F.sequence(F.lit(0), F.size(w["h"]) - 1), F.struct(F.lit(0).alias("at"), none.alias("spans")),
                           lambda acc, i: step(acc, i, w), lambda acc: acc["spans"])
    # one-element transform: pieces and hits are computed once
    some = reduce(lambda a, b: a | b, [text.contains(m) for m in marks]) if marks else F.lit(True)
    return F.when(some & text.rlike(pattern), F.get(F.transform(F.array(whole), walk), F.lit(0))).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(_hits(text, ASSIGN, 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 8, ("=", ":")),
                                 _hits(text, ACCESS, 1, marks=("AKIA",)), _hits(text, HEX, 2)))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of (previous, next) ASCII codes, at 128 * previous + next, from labelled samples
    (token string, secret boolean). Code 0 stands before a token. The counts brought to the driver are at most
    2 * 128 * 128. Without samples of a label its chain is uniform."""
    chars = F.split("token", "")
    pairs = samples.where("token is not null and secret is not null").select("secret", F.explode(F.arrays_zip(
        F.concat(F.array(F.lit("\0")), F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0)))).alias("p"), chars.alias("c"))).alias("x"))
    counted = (pairs.select("secret", F.ascii("x.p").alias("p"), F.ascii("x.c").alias("c")).where("p < 128 and c < 128")
               .groupBy("secret", "p", "c").agg(F.count("*").alias("n")).collect())
    n = {True: {}, False: {}}
    row = {True: {}, False: {}}
    for r in counted:
        n[r.secret][r.p, r.c] = r.n
        row[r.secret][r.p] = row[r.secret].get(r.p, 0) + r.n
    def log(secret, p, c):
        from math import log as ln
        return ln((n[secret].get((p, c), 0) + smoothing) / (row[secret].get(p, 0) + smoothing * ALPHABET))
    return [log(True, p, c) - log(False, p, c) for p in range(128) for c in range(128)]


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum of the ratios along a token of ASCII characters."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")  # one constant
    start = F.struct(F.lit(0).alias("prev"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.split(token, ""), start, lambda a, ch: F.struct(
        F.ascii(ch).alias("prev"), (a["sum"] + F.get(table, a["prev"] * 128 + F.ascii(ch))).alias("sum")), lambda a: a["sum"])


def labelled_samples(docs: DataFrame, sample_docs: int = 500) -> DataFrame:
    """(token, secret) from the ``sample_docs`` documents of smallest id hash, a documented bound.

    Secret: what the base patterns catch there, and strings made from hashes of the ids in the alphabets of keys.
    Ordinary: the words of these texts without the base matches, and identifiers joined from neighbouring words.
    """
    docs = id_text(docs)
    few = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.join(F.broadcast(few.distinct()), "doc_id").limit(sample_docs)
    caught = [sample.select(F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(g))).alias("token")) for p, g in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0))]
    digest = F.sha2(F.concat_ws(":", F.lit("random"), "doc_id"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    made = sample.select(F.explode(F.array(digest, b64, b64, F.substring(F.upper(b64), 1, 24), F.substring(F.translate(b64, "+/", "-_"), 1, 32))).alias("token"))
    secret = reduce(DataFrame.unionByName, [*caught, made]).where(F.length("token") >= 8).withColumn("secret", F.lit(True))
    clean = reduce(lambda t, p: F.regexp_replace(t, p, " "), (ASSIGN, ACCESS, HEX), F.col("text"))
    found = sample.select(F.regexp_extract_all(clean, F.lit(r"(?<![\p{L}\p{N}])[A-Za-z][A-Za-z0-9_+/-]{3,}(?![\p{L}\p{N}])"), F.lit(0)).alias("w"))
    pair = lambda f: F.zip_with(F.slice("w", 2, 1 << 30), "w", f)  # noqa: E731  the last pair is null
    joined = [pair(lambda a, b: F.concat(F.lower(a), F.lit("_"), F.lower(b))), pair(lambda a, b: F.concat(F.lower(a), F.initcap(b))),
              pair(lambda a, b: F.concat(F.upper(a), F.lit("_"), F.upper(b))), pair(lambda a, b: F.concat(F.lower(a), F.lit("/"), F.lower(b)))]
    plain = found.select(F.explode(F.concat("w", "w", "w", *joined)).alias("token")).where("token is not null").withColumn("secret", F.lit(False))
    return secret.unionByName(plain)


def with_spans(docs: DataFrame, ratios: list[float], min_llr: float = 12.0, min_mean: float = 1.5,
               base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with two arrays of (start, kind, end) in new columns: ``base``, and ``spans`` which holds all. A token is a secret
    if its log-likelihood ratio reaches ``min_llr`` (which outweighs the rarity of secrets) and ``min_mean`` a character."""
    text = F.coalesce(F.col("text"), F.lit(""))
    apart = lambda m: ~F.exists(F.col(base), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    tokens = F.when(text.rlike(TOKEN), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    likely = lambda h: log_ratio(h, ratios) >= F.greatest(F.lit(min_llr), F.length(h) * min_mean)
    marked = F.when(F.exists(tokens, likely), _hits(text, TOKEN, 3, likely)).otherwise(F.array().cast(_SPANS))
    both = docs.withColumn(base, base_spans(text)).withColumn(spans, marked)
    return both.withColumn(spans, F.array_sort(F.concat(base, F.filter(spans, apart))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, min_llr: float = 12.0, sample_docs: int = 500) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    ratios = train(labelled_samples(docs, sample_docs))
    found = with_spans(id_text(docs), ratios, min_llr)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]", min_llr: float = 12.0, sample_docs: int = 500) -> DataFrame:
    """``docs`` with every span's text replaced by ``mark`` (spans that overlap share one) and n_chars to match. Rows
    without spans come out unchanged."""
    ratios = train(labelled_samples(docs, sample_docs))
    base, spans = unused(docs, "base"), unused(docs, "spans")
    found = with_spans(docs, ratios, min_llr, base=base, spans=spans)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    def cut(text):
        def step(a, s):
            new = F.concat(a["parts"], F.array(F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], new).otherwise(a["parts"]).alias("parts"))
        return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, a["at"] + 1)))
    hit = F.size(spans) > 0
    return (found.withColumn("text", F.when(hit, cut(F.col("text"))).otherwise(F.col("text")))
            .withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
            .drop(base, spans))
