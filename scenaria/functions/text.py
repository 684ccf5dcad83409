"""Text helpers with first-match semantics and lenient number parsing.

Spark's ``regexp_replace`` replaces every match; the panels edit only the first one. Anchoring the
pattern behind a lazy prefix (``^(?s)(.*?)PATTERN``) turns the built-in into a first-match edit that
stays a JVM expression inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenaria.constants import NA_TOKENS


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_text(c: str | Column, text: str = "NA") -> Column:
    """A null rendered as text, as ``paste`` does."""
    return F.coalesce(_col(c).cast("string"), F.lit(text))


def paste0(*cols: str | Column) -> Column:
    """Concatenate without separator; nulls become ``NA`` (collisions are possible, as in the source)."""
    return F.concat(*[null_text(c) for c in cols])


def _java_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def replace_first(c: str | Column, pattern: str, replacement: str, literal: bool = False) -> Column:
    """Replace the first match of ``pattern`` (a Java regex, or a literal text with ``literal=True``)."""
    pat = re.escape(pattern) if literal else pattern
    return F.regexp_replace(_col(c), rf"^(?s)(.*?)(?:{pat})", "$1" + _java_replacement(replacement))


def remove_first(c: str | Column, pattern: str, literal: bool = False) -> Column:
    return replace_first(c, pattern, "", literal=literal)


def to_number(c: str | Column, na_tokens: tuple[str, ...] = NA_TOKENS, dtype: str = "double") -> Column:
    """Text to number: any of the NA tokens (after trimming) is null, unparsable text is null."""
    s = F.trim(_col(c).cast("string"))
    return F.when(s.isin(*na_tokens), F.lit(None)).otherwise(s).try_cast(dtype)


def strip_percent_number(c: str | Column) -> Column:
    """Remove the first ``%`` and parse the rest as a double (bad text gives null)."""
    return remove_first(c, "%", literal=True).try_cast("double")


def label_to_year(c: str | Column, prefix: str = "x") -> Column:
    """``x2019`` -> 2019 (first occurrence of the prefix removed, then an int cast)."""
    return remove_first(c, prefix, literal=True).try_cast("int")
