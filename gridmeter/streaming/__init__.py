"""Structured Streaming form of the step-series aggregation (see intervals.py)."""

from gridmeter.streaming.intervals import read_readings, start_step_series, step_series

__all__ = ["read_readings", "start_step_series", "step_series"]
