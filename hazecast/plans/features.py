"""The full feature table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.fixed_values import (
    CHANGE_WINDOWS, EWMA_SPANS, HORIZONS, INTERACTION_PAIRS, LAG_STEPS, POLLUTANTS,
    ROLLING_WINDOWS, TARGETS, WEATHER, WINDOWED)
from hazecast.functions import aqi, calendar, cleaning
from hazecast.operators import layout, windows

ALL_GROUPS = ["rolling_mean", "rolling_std", "ewma", "rolling_minmax",
              "lags", "change_rate", "targets"]
NOT_FEATURES = {"station_id", "timestamp", "date", *TARGETS}


def feature_columns(df: DataFrame) -> list[str]:
    """Everything but keys and targets."""
    return [c for c in df.columns if c not in NOT_FEATURES]


def column_order() -> list[str]:
    names = ["station_id", "timestamp", *POLLUTANTS, *WEATHER, "aqi",
             "hour", "day_of_week", "month", "is_weekend",
             "hour_sin", "hour_cos", "month_sin", "month_cos",
             "day_segment", "day_of_year_sin", "day_of_year_cos",
             "week_of_year_sin", "week_of_year_cos"]
    for c in WINDOWED:
        for n in ROLLING_WINDOWS:
            names += [f"{c}_rolling_mean_{n}h", f"{c}_rolling_std_{n}h"]
    names += [f"{c}_ewma_{n}h" for c in WINDOWED for n in EWMA_SPANS]
    for c in WINDOWED:
        for n in ROLLING_WINDOWS:
            names += [f"{c}_rolling_min_{n}h", f"{c}_rolling_max_{n}h", f"{c}_range_{n}h"]
    names += [f"{c}_lag_{n}h" for c in WINDOWED for n in LAG_STEPS]
    names += [f"aqi_change_rate_{n}h" for n in CHANGE_WINDOWS]
    names += [f"{a}_x_{b}" for a, b in INTERACTION_PAIRS] + ["temp_humidity_idx"]
    return names + [f"aqi_target_{n}h" for n in HORIZONS]


def build_features(observations: DataFrame, frame: str = "rows",
                   zone: str | None = None, epoch: bool = True,
                   block_rows: int = layout.BLOCK_ROWS, seed: DataFrame | None = None,
                   weights: bool = False, numbered: bool = False) -> DataFrame:
    """Joined observations -> the feature table.

    The observations travel through two shuffles with the columns made of them; what a row
    gives by itself (calendar, interactions) is added after them. ``seed``, ``weights`` and
    ``numbered`` are for parts of series: see ``windows.with_window_features``.
    """
    clean = aqi.with_aqi(cleaning.normalize_nan(observations))
    wide = windows.with_window_features(clean, ALL_GROUPS, frame, block_rows, seed, weights, numbered)
    wide = calendar.with_interactions(
        calendar.with_calendar_features(
            calendar.with_time_features(wide, zone), zone))
    if epoch:
        wide = wide.withColumn("timestamp", F.unix_millis("timestamp"))
    order = column_order()
    extra = [c for c in observations.columns if c not in order and c in wide.columns]
    if weights:
        extra += [c for c in windows.state_columns() if "_weight_" in c]
    return wide.select(*order, *extra)
