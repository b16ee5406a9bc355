"""Scoring: latest row per station to forecasts, alerts and display rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazecast.fixed_values import ALERT_THRESHOLD, HORIZONS, POLLUTANT_NAMES, POLLUTANTS, TARGETS
from hazecast.functions import aqi
from hazecast.functions.aqi import category
from hazecast.functions.cleaning import align_features, impute_zero
from hazecast.operators.matching import latest_per_station


def clamp(prediction: Column) -> Column:
    """An index cannot be negative; a missing forecast stays missing."""
    return F.when(prediction.isNotNull(), F.greatest(F.lit(0.0), prediction))


def forecast(features: DataFrame, models: dict, feature_names: dict[str, list[str]]) -> DataFrame:
    """One row per station: time of its last row and a forecast per model.

    ``models`` maps a target to a fitted pipeline that reads its features and
    adds ``prediction``.
    """
    rows = latest_per_station(features)
    for target, model in models.items():
        names = feature_names[target]
        ready = impute_zero(align_features(rows, names), names)
        scored = model.transform(ready)
        rows = scored.select(*rows.columns, clamp(F.col("prediction")).alias(f"_{target}"))
    return rows.select("station_id", "timestamp", "aqi",
                       *[F.col(f"_{t}").alias(t) for t in models])


def persistence(latest: DataFrame) -> DataFrame:
    """The last index carried to every horizon: the baseline forecaster."""
    return latest.select("station_id", "timestamp", "aqi",
                         *[clamp(F.col("aqi")).alias(t) for t in TARGETS])


def _by_horizon() -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"aqi_target_{h}h").alias("forecast"))
        for h in HORIZONS]))


def forecast_series(forecasts: DataFrame, history: DataFrame) -> DataFrame:
    """Points of the forecast line, from the last valid index of the history."""
    points = forecasts.select("station_id", "timestamp", _by_horizon()).filter(
        F.col("forecast").isNotNull()).select(
        "station_id", "horizon",
        (F.col("timestamp") + F.make_dt_interval(hours=F.col("horizon"))).alias("at"),
        F.col("forecast").alias("value"))
    known = F.when(F.col("aqi").isNotNull(), F.col("timestamp"))
    anchors = history.groupBy("station_id").agg(
        F.max("timestamp").alias("at"),
        F.coalesce(F.max_by("aqi", known), F.lit(0.0)).alias("value"))
    return points.unionByName(
        anchors.select("station_id", F.lit(0).alias("horizon"), "at", "value"))


def alerts(forecasts: DataFrame, threshold: float = ALERT_THRESHOLD,
           strict: bool = False) -> DataFrame:
    """Forecasts above the threshold: day label, whole value, category."""
    return forecasts.select("station_id", _by_horizon()).filter(
        F.col("forecast") > threshold).select(
        "station_id",
        F.concat(F.lit("Day "), (F.col("horizon") / 24).cast("int").cast("string")).alias("day"),
        F.floor("forecast").cast("int").alias("value"),
        category(F.col("forecast"), strict).alias("category"))


def forecast_cards(forecasts: DataFrame, strict: bool = False) -> DataFrame:
    """Whole value and category per station and horizon, nulls kept."""
    return forecasts.select("station_id", _by_horizon()).select(
        "station_id", "horizon", F.floor("forecast").cast("int").alias("value"),
        F.coalesce(category(F.col("forecast"), strict), F.lit("No Model Loaded"))
        .alias("category"))


def _shown(column: str, pattern: str, unit: str) -> Column:
    """A number as text; a tie goes to the even digit, as C and Python print it (``format_string`` rounds it up)."""
    text = F.expr(f"format_number({column}, '{pattern}')")
    return F.when(F.col(column).isNotNull(), F.concat(text, F.lit(unit))).otherwise("N/A")


def current_conditions(observations: DataFrame, strict: bool = False) -> DataFrame:
    """Index, category and weather text of each station's latest row."""
    latest = aqi.with_aqi(latest_per_station(observations))
    value = F.coalesce("aqi", F.lit(0.0))
    return latest.select(
        "station_id", "timestamp", F.floor(value).cast("int").alias("aqi"),
        category(value, strict).alias("category"),
        category(value, strict, "message").alias("message"),
        _shown("temperature", "0.0", "°C").alias("temperature"),
        _shown("humidity", "0", "%").alias("humidity"),
        _shown("wind_speed", "0.0", " km/h").alias("wind_speed"),
        _shown("wind_direction", "0", "°").alias("wind_direction"),
        _shown("pressure", "0", " hPa").alias("pressure"))


def pollutant_breakdown(observations: DataFrame, strict: bool = False) -> DataFrame:
    """Sub-index (0 when invalid) and category per pollutant of the latest row."""
    latest = latest_per_station(observations)
    long = aqi.sub_indices_long(latest, ["station_id"])
    value = F.coalesce("sub_index", F.lit(0.0))
    return long.select("station_id", "pollutant", value.alias("sub_index"),
                       category(value, strict).alias("category"))
