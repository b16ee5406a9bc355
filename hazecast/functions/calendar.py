"""Calendar features of an event time, read in the session zone (UTC)."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazecast.fixed_values import DAY_SEGMENTS, INTERACTION_PAIRS


def _circle(name: str, value: str, period: float) -> dict[str, Column]:
    angle = f"{value} * {2.0 * math.pi!r}D / {float(period)!r}D"
    return {f"{name}_sin": F.expr(f"sin({angle})"), f"{name}_cos": F.expr(f"cos({angle})")}


def _local(zone: str | None) -> str:
    return "timestamp" if zone is None else f"from_utc_timestamp(timestamp, '{zone}')"


def with_time_features(df: DataFrame, zone: str | None = None) -> DataFrame:
    """hour, day_of_week (Monday is 0), month, is_weekend and their circles."""
    ts = _local(zone)
    return df.withColumns({
        "hour": F.expr(f"hour({ts})"),
        "day_of_week": F.expr(f"weekday({ts})"),
        "month": F.expr(f"month({ts})"),
        "is_weekend": F.expr(f"CAST(weekday({ts}) >= 5 AS INT)"),
        **_circle("hour", f"hour({ts})", 24),
        **_circle("month", f"month({ts})", 12),
    })


def with_calendar_features(df: DataFrame, zone: str | None = None) -> DataFrame:
    """day_segment and the circles of day of year and ISO week."""
    ts = _local(zone)
    arms = " ".join(f"WHEN hour({ts}) >= {first} AND hour({ts}) < {last} THEN {code}"
                    for code, (first, last) in enumerate(DAY_SEGMENTS))
    return df.withColumns({
        "day_segment": F.expr(f"CASE {arms} ELSE 0 END"),
        **_circle("day_of_year", f"dayofyear({ts})", 365.25),
        **_circle("week_of_year", f"weekofyear({ts})", 52),
    })


def with_interactions(df: DataFrame) -> DataFrame:
    """Pollutant x weather products, where both columns are present."""
    products = {f"{a}_x_{b}": F.expr(f"{a} * {b}")
                for a, b in INTERACTION_PAIRS
                if a in df.columns and b in df.columns}
    if {"temperature", "humidity"} <= set(df.columns):
        products["temp_humidity_idx"] = F.expr("temperature * humidity / 100D")
    return df.withColumns(products) if products else df
