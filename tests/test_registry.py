"""The registered queries against their oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"

# The query names the blueprint asks for.
WANTED = """
scan_parse_time scan_sites mask_targets forecast_valid_time calendar_features wind_dir_bucket
poly_features polar_to_uv lead_category block_position clamp_power binary_label class_label
one_hot_label class_decode inverse_scale coerce_numeric flatten_window warmup_filter drop_nulls
power_threshold_filter time_range first_days null_audit join_power_forecast join_benchmark_run
lag_join_history category_pivot_join join_site_results latest_forecast_asof write_back
union_sites extend_horizon mean_by_date zero_ratio group_describe group_head box_stats
first_run_per_date time_gaps lag_columns interpolate_linear interpolate_cubic max_scale gap_islands
neighbour_features rolling_stats cross_site_features limit_rows rank_importance sort_quantiles
minmax_apply minmax_fit_subset standard_scale mean_range_scale clean_sigma kmeans_outliers
denoise_power kmeans_elbow dbscan isolation_forest unpivot_sites pivot_sites clamp_quantiles
quantile_postprocess window_index window_tensor channel_swap sequence_dataset history_plus_run
update_features lagged_slide offset_pair reverse_pair window_consistency hash_split site_and_total
rmse_pooled rmse_window_mean mape rmse_by_site pinball_loss persistence_baseline gbt_regress
gbt_gate param_sweep batch_predict recursive_forecast recursive_cross_site stack_ensemble
feature_importance per_site_apply window_regress histogram cumulative_histogram lag_correlation
site_correlation feature_correlation wind_rose zero_scatter power_curve kde_2d interval_bands
compare_slice metric_log_pivot
""".split()

# One of each plan family; check.py runs them all.
CHECKED = """
rmse_by_site lag_join_history extend_horizon interpolate_linear rolling_stats sequence_dataset
history_plus_run update_features category_pivot_join box_stats minmax_fit_subset
clean_sigma hash_split purged_split pinball_loss wind_rose feature_correlation recursive_forecast scan_sites
feature_table
""".split()


def test_blueprint_is_covered():
    assert not set(WANTED) - set(entry.queries())


def test_every_oracle_has_a_query():
    assert not set(entry.oracle_sql()) - set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in CHECKED if n in entry.oracle_sql()])
def test_against_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toArrow()
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert compare(got, want) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
