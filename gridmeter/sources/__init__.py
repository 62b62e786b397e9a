"""Readers and writers: typed CSV, result tables, run trees, templates, generators."""

from gridmeter.sources.csv import (
    mangle_names, read_by_position, read_csv_typed, read_side_by_side, read_skip_meta, read_time_indexed, write_csv,
    write_parquet,
)
from gridmeter.sources.generate import gen_range, literal_product
from gridmeter.sources.results import (
    scan_json_template, scan_result_report, scan_run_tree, scan_solver_meta, scan_solver_wide,
)
