"""Joins against dimensions, crosswalks and bloc maps.

No side is hinted for broadcast: Spark's ``autoBroadcastJoinThreshold`` decides by size at planning time, and AQE
by the real shuffle sizes at run time; beyond them a shuffled join is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_left_dim(
    fact: DataFrame, dim: DataFrame, on: str | Sequence[str], null_safe: bool = False,
) -> DataFrame:
    """``left_join(dim, by = on)``: duplicates on the right fan out; ``null_safe`` matches null to null."""
    keys = [on] if isinstance(on, str) else list(on)
    if not null_safe:
        return fact.join(dim, keys, "left")
    renamed = dim.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in dim.columns if c not in keys])
    cond = None
    for k in keys:
        c = fact[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return fact.join(renamed, cond, "left").drop(*[f"_r_{k}" for k in keys])


def join_left_renamed(fact: DataFrame, dim: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left_join(dim, by = c(a = b))``: the right key column is dropped, as dplyr does."""
    return fact.join(dim, fact[left_key] == dim[right_key], "left").drop(dim[right_key])


def join_right_distinct(df: DataFrame, keys_from: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``right_join(distinct(keys_from, k))``: every key value survives, with null rows where unmatched."""
    distinct_keys = keys_from.select(*keys).distinct()
    return df.join(distinct_keys, list(keys), "right")


def cross_small(df: DataFrame, small: DataFrame) -> DataFrame:
    """Cartesian product with a literal table (``merge(x, s)`` with no common column)."""
    return df.crossJoin(small)


def normalise_name(c: str | Column) -> Column:
    """Match key for free-text names: lower case, single spaces, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def xwalk_name_to_code(
    df: DataFrame, name_col: str, xwalk: DataFrame, out_col: str = "country_code",
    name_key: str = "country_name", code_key: str = "iso3",
) -> DataFrame:
    """Name -> code through a crosswalk table (one code per normalised name; aliases allowed)."""
    xw = (
        xwalk.select(normalise_name(name_key).alias("_xw_name"), F.col(code_key).alias("_xw_code"))
        .groupBy("_xw_name").agg(F.min("_xw_code").alias("_xw_code"))
    )
    out = df.join(xw, normalise_name(name_col) == F.col("_xw_name"), "left").drop("_xw_name")
    return out.withColumnRenamed("_xw_code", out_col) if out_col not in df.columns else (
        out.withColumn(out_col, F.col("_xw_code")).drop("_xw_code"))


def pattern_matches(names: DataFrame, name_col: str, patterns: DataFrame) -> DataFrame:
    """(name, codes): the normalised distinct names with the sorted codes of all patterns that match them.

    ``patterns`` has ``pattern`` (a regular expression for part of a normalised name), ``unless`` (one that must not match, or
    null), ``code``, and ``words``: words (small letters) that the name must hold, too. A name meets only the patterns whose
    rarest word, by the number of names that hold it, is among its own words: no name is tried against every pattern. The
    names are made distinct first, so a name that a third of the rows carry is matched once.
    """
    p = patterns.select(F.xxhash64("pattern", "unless", "code").alias("_id"), "pattern", "unless", "code", "words").dropDuplicates(["_id"])
    listed = p.select("_id", F.explode_outer("words").alias("word"))
    listed = listed.withColumn("word", F.coalesce("word", F.raise_error(F.lit("a pattern without words cannot be looked up"))))
    known = names.select(normalise_name(name_col).alias("name")).where("name is not null").distinct()
    known = known.withColumn("of", F.array_distinct(F.split("name", r"[^\p{L}\p{N}]+")))
    held = known.select("name", "of", F.explode("of").alias("word")).join(listed.select("word").distinct(), "word", "left_semi")
    often = held.groupBy("word").count()
    rarest = (listed.join(often, "word", "left").groupBy("_id")
              .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word"))["word"].alias("word")))
    tried = held.join(rarest.join(p, "_id"), "word")
    hits = tried.where((F.size(F.array_except("words", "of")) == 0) & F.regexp_like("name", F.col("pattern")) & ~F.coalesce(F.regexp_like("name", F.col("unless")), F.lit(False)))
    return hits.groupBy("name").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def xwalk_pattern_to_code(
    df: DataFrame, name_col: str, patterns: DataFrame, out_col: str = "country_code", candidates: str | None = None,
) -> DataFrame:
    """Free-text name -> code through patterns (``pattern_matches``). A name that patterns of several codes match is
    ambiguous and gets none, like a name without match; ``candidates`` names a column with all matching codes."""
    found = pattern_matches(df, name_col, patterns).withColumnRenamed("name", "_xw_name")
    out = df.drop(out_col).join(found, normalise_name(name_col) == F.col("_xw_name"), "left").drop("_xw_name")
    out = out.withColumn(out_col, F.when(F.size("codes") == 1, F.col("codes")[0]))
    return out.withColumnRenamed("codes", candidates) if candidates else out.drop("codes")


def ambiguous_names(df: DataFrame, name_col: str, patterns: DataFrame) -> DataFrame:
    """(name, codes) of the normalised names that patterns of several codes match."""
    return pattern_matches(df, name_col, patterns).where(F.size("codes") > 1)


def xwalk_code_to_name(
    df: DataFrame, code_col: str, xwalk: DataFrame, out_col: str = "country", default: str | None = None,
    name_key: str = "country_name", code_key: str = "iso3",
) -> DataFrame:
    """Code -> name (first name per code); unmatched codes take ``default``."""
    xw = xwalk.groupBy(F.col(code_key).alias("_xw_code")).agg(F.min(name_key).alias("_xw_name"))
    out = df.join(xw, F.col(code_col) == F.col("_xw_code"), "left").drop("_xw_code")
    name = F.coalesce(F.col("_xw_name"), F.lit(default)) if default is not None else F.col("_xw_name")
    return out.withColumn(out_col, name).drop("_xw_name")


def rollup_bloc(df: DataFrame, code_col: str, members: Sequence[str] | DataFrame, bloc: str = "EU",
                out_col: str | None = None) -> DataFrame:
    """Replace member codes by the bloc code (``ifelse(code %in% members, bloc, code)``)."""
    out_col = out_col or code_col
    if isinstance(members, DataFrame):
        m = members.select(F.col(members.columns[0]).alias("_member"), F.lit(bloc).alias("_bloc")).distinct()
        out = df.join(m, F.col(code_col) == F.col("_member"), "left")
        return out.withColumn(out_col, F.coalesce(F.col("_bloc"), F.col(code_col))).drop("_member", "_bloc")
    return df.withColumn(out_col, F.when(F.col(code_col).isin(list(members)), F.lit(bloc)).otherwise(F.col(code_col)))


def join_fanout(fact: DataFrame, membership: DataFrame, key: str, group: str) -> DataFrame:
    """A fact row joins every group its key belongs to; duplicate (key, group) pairs count once."""
    return fact.join(membership.select(key, group).dropDuplicates([key, group]), key, "left")
