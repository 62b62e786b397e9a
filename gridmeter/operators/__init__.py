"""DataFrame -> DataFrame building blocks (see the README's coverage table)."""

from gridmeter.operators.aggregates import (
    day_hour_profile, fleet_sum, min_max_range, month_hour_profile, order_levels, rollup_total, rollup_zone_pivot,
    semi_join_built, sum_filtered,
)
from gridmeter.operators.curves import power_curve
from gridmeter.operators.joins import inner_join_chain, join_day_profile, left_join_chain, right_join_keep_all
from gridmeter.operators.periods import (
    ExtremeRule, cluster_periods, extreme_periods, period_features, period_weights, reduced_series, scale_features,
    step_weights,
)
from gridmeter.operators.reshape import (
    matrix_to_rows, name_to_flag, net_of_charge, pivot_wider, row_total, union_sources, unpivot_all_but,
)
from gridmeter.operators.settlement import (
    annual_sum, capacity_balance, capacity_factor, cost_components, cost_rollup, net_revenue, settle, step_total,
    unserved_energy_cost,
)
from gridmeter.operators.stats import (
    bandwidth_nrd0, ecdf, exact_quantiles, grouped_linear_fit, kernel_density, predict_linear,
)
from gridmeter.operators.timeseries import (
    assign_period, day_profile_long, expand_period_map, interpolate_columns, interpolate_linear,
    interpolate_month_to_day, resample_grid, slice_period, split_period_index,
)
from gridmeter.operators.windows import cumsum, index_from_label, offset_from_first
