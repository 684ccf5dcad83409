"""DataFrame -> DataFrame verbs (each a short composition of built-in Spark operators)."""

from scenaria.operators.aggregate import (
    attach_global_stat,
    attach_group_stat,
    control_total,
    envelope,
    grouping_sets_total,
    member_stats,
    share_of_total,
    spread_summary,
    two_stage,
)
from scenaria.operators.filters import (
    drop_null_rows,
    filter_first_and_pred,
    filter_in,
    filter_not_equal,
    first_per_key,
)
from scenaria.operators.joins import (
    cross_small,
    join_fanout,
    join_left_dim,
    join_left_renamed,
    join_right_distinct,
    rollup_bloc,
    xwalk_code_to_name,
    xwalk_name_to_code,
    xwalk_pattern_to_code,
)
from scenaria.operators.order import as_levels, order_by_stat, sort_asc
from scenaria.operators.project import (
    column_range,
    derive_chained,
    normalise_headers,
    q,
    rename,
    select_range,
)
from scenaria.operators.reshape import (
    column_to_row,
    densify,
    pivot_difference,
    pivot_wide,
    unpivot,
    unpivot_range,
)
from scenaria.operators.setops import distinct_keys, union_by_name
from scenaria.operators.timeseries import interpolate_linear, restrict_period
from scenaria.operators.window import attach_net, attach_two_grains, stack_offsets
