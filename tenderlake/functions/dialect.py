"""The few functions that DuckDB spells in its own way, for the SQL of results."""

from __future__ import annotations


class Duck:
    add_months = staticmethod(lambda d, n: f"CAST({d} + to_months(CAST({n} AS INT)) AS DATE)")
    half_even = staticmethod(lambda x: f"round_even({x}, 0)")
    days = staticmethod(lambda a, b: f"date_diff('day', {b}, {a})")
    median = staticmethod(lambda x: f"percentile_cont(0.5) WITHIN GROUP (ORDER BY {x})")
