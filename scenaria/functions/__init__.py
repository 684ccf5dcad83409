from scenaria.functions.nulls import (
    skipna_sum,
    strict,
    strict_max,
    strict_mean,
    strict_min,
    strict_sum,
)
from scenaria.functions.text import (
    label_to_year,
    null_text,
    paste0,
    remove_first,
    replace_first,
    strip_percent_number,
    to_number,
)
from scenaria.functions.arith import pct_of, rnd, rnd_sig, safe_div, scale_units

__all__ = [
    "strict", "strict_sum", "strict_mean", "strict_min", "strict_max", "skipna_sum",
    "paste0", "null_text", "replace_first", "remove_first", "strip_percent_number", "to_number", "label_to_year",
    "pct_of", "safe_div", "scale_units", "rnd", "rnd_sig",
]
