"""Exploratory tables over the feature table (``timestamp`` as a timestamp)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from hazecast.fixed_values import CATEGORIES, DAY_NAMES, MONTH_NAMES, POLLUTANTS, WEATHER
from hazecast.functions.aqi import category
from hazecast.functions.cleaning import half_even
from hazecast.operators.comoments import co_moments
from hazecast.operators.quantiles import exact_quantiles, melt

CORE = [*POLLUTANTS, *WEATHER, "aqi"]
QUARTILES = [0.25, 0.5, 0.75]
FENCE = 1.5


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd").alias("last_date"))


def missing(df: DataFrame, columns: list[str] = CORE) -> DataFrame:
    """Share of nulls in percent per column, and whether it exceeds 5."""
    counted = df.agg(F.count("*").alias("rows"),
                     *[F.count(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("present"))
                      for c in columns])
    share = half_even(F.try_divide((F.col("rows") - F.col("present")) * 100.0,
                                   F.col("rows")), 2)
    return (counted.select("rows", F.inline(cells))
            .select("variable", share.alias("missing_pct"),
                    (share > 5).alias("above_5_pct")))


def describe(df: DataFrame, columns: list[str] = CORE) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, 2 decimals."""
    return exact_quantiles(df, columns, QUARTILES).select(
        "variable", F.col("n").alias("count"),
        # rounded to 9 decimals first: the last bits of an interpolated value
        # must not decide which way a tie at 2 decimals goes
        *[half_even(half_even(F.col(source), 9), 2).alias(name) for source, name in (
            ("mean", "mean"), ("std", "std"), ("low", "min"), ("q0", "p25"),
            ("q1", "p50"), ("q2", "p75"), ("high", "max"))])


def histogram(df: DataFrame, columns: list[str] = CORE, bins: int = 50) -> DataFrame:
    """Counts in equal bins between each column's extremes, empty bins too."""
    long = melt(df, columns)
    range_ = long.groupBy("variable").agg(
        F.min("value").alias("low"), F.max("value").alias("high"))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    place = F.floor((F.col("value") - F.col("low")) / width) + 1
    number = F.when(F.col("high") > F.col("low"),
                    F.least(place, F.lit(bins))).otherwise(F.lit(1)).cast("int")
    # one row per named column: always small enough to broadcast
    counted = (long.join(F.broadcast(range_), "variable")
               .groupBy("variable", number.alias("bin"))
               .agg(F.count("*").alias("bin_count")))
    spine = range_.select(
        "variable", "low", "high", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return spine.join(counted, ["variable", "bin"], "left").select(
        "variable", "bin",
        (F.col("low") + (F.col("bin") - 1) * width).alias("bin_start"),
        (F.col("low") + F.col("bin") * width).alias("bin_end"),
        F.coalesce("bin_count", F.lit(0)).alias("bin_count"))


def correlations(df: DataFrame, columns: list[str] = CORE) -> DataFrame:
    """Pearson correlation of every pair, over rows where both are present.

    Null where a column is constant. One pass over the rows: see ``operators.comoments``.
    """
    r = F.try_divide(F.col("c"), F.sqrt("m2_x") * F.sqrt("m2_y"))
    one_side = co_moments(df, columns).select("i", "j", F.when(F.col("n") > 0, r).alias("r"))
    spread = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")),
                     F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    named = F.array(*[F.lit(c) for c in columns])
    mirrored = one_side.select("r", F.explode(
        F.when(F.col("i") == F.col("j"), F.slice(spread, 1, 1)).otherwise(spread)).alias("p"))
    return mirrored.select(named[F.col("p.a")].alias("variable"),
                           named[F.col("p.b")].alias("other"),
                           half_even(F.col("r"), 3).alias("r"))


def top_correlations(df: DataFrame, target: str = "aqi", n: int = 10,
                     columns: list[str] = CORE) -> DataFrame:
    """The n columns most correlated with the target, either way."""
    others = correlations(df, columns).filter(
        (F.col("variable") == target) & (F.col("other") != target) & F.col("r").isNotNull())
    return (others.select(
        F.col("other").alias("feature"), F.abs("r").alias("abs_correlation"),
        F.when(F.col("r") > 0, F.lit("positive")).otherwise(F.lit("negative"))
        .alias("direction"))
        .orderBy(F.desc("abs_correlation"), "feature").limit(n))


def raw_series(df: DataFrame, columns: list[str]) -> DataFrame:
    """Hourly rows with a time, in time order: an output edge, so sorted."""
    return (df.filter(F.col("timestamp").isNotNull())
            .select("station_id", "timestamp", *columns)
            .orderBy("timestamp", "station_id"))


def _period_start(period: str) -> Column:
    day = F.to_date("timestamp")
    return day if period == "day" else F.trunc(day, period).cast("date")


def _label(period: str, start: Column) -> Column:
    """Weeks end on Sunday and are named by it, months by their last day."""
    if period == "week":
        return F.date_add(start, 6)
    return F.last_day(start) if period == "month" else start


def resample_mean(df: DataFrame, columns: list[str], period: str) -> DataFrame:
    """Mean per station and day, week or month; empty periods give nulls.

    Each period also emits the empty ones up to the station's next period, so
    the gaps need no calendar table and no join. What the window sees is one
    row per station and period, bounded by the calendar.
    """
    means = (df.filter(F.col("timestamp").isNotNull())
             .groupBy("station_id", _period_start(period).alias("start"))
             .agg(*[F.avg(c).alias(c) for c in columns]))
    after = F.lead("start").over(Window.partitionBy("station_id").orderBy("start"))
    until = F.coalesce(F.date_sub(F.col("after"), 1), F.col("start"))
    step = F.expr(f"INTERVAL 1 {period}")
    filled = (means.withColumn("after", after)
              .withColumn("at", F.explode(F.sequence(F.col("start"), until, step))))
    known = F.col("at") == F.col("start")
    return filled.select("station_id", _label(period, F.col("at")).alias("period"),
                         *[F.when(known, F.col(c)).alias(c) for c in columns])


def pollutant_daily(df: DataFrame) -> DataFrame:
    """Daily mean of each pollutant and the running total across them."""
    daily = resample_mean(df, POLLUTANTS, "day")
    stacked, total = {}, None
    for c in POLLUTANTS:
        part = F.coalesce(F.col(c), F.lit(0.0))
        total = part if total is None else total + part
        stacked[f"{c}_stacked"] = total
    return daily.withColumns(stacked)


def category_distribution(df: DataFrame, strict: bool = False) -> DataFrame:
    """Hours per category, most first, with their share."""
    counts = (df.filter(F.col("aqi").isNotNull())
              .groupBy(category(F.col("aqi"), strict).alias("category"))
              .agg(F.count("*").alias("hours")))
    # at most one row per category reaches this window
    everything = Window.partitionBy(F.lit(1))
    return counts.select(
        "category", "hours",
        (F.col("hours") / F.sum("hours").over(everything)).alias("share")
    ).orderBy(F.desc("hours"), "category")


# The index takes 501 whole values, so the exact median's buffer per group is
# bounded and `median` may be used for it.

def seasonal_hour(df: DataFrame) -> DataFrame:
    stats = df.groupBy(F.hour("timestamp").alias("hour")).agg(
        F.avg("aqi").alias("mean"), F.median("aqi").alias("median"),
        F.stddev_samp("aqi").alias("std"))
    return stats.withColumns({"band_low": F.col("mean") - F.col("std"),
                              "band_high": F.col("mean") + F.col("std")})


def seasonal_month(df: DataFrame) -> DataFrame:
    stats = df.groupBy(F.month("timestamp").alias("month")).agg(
        F.avg("aqi").alias("mean"), F.median("aqi").alias("median"),
        F.coalesce(F.stddev_samp("aqi"), F.lit(0.0)).alias("std"))
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    return stats.withColumn("month_name", F.element_at(names, F.col("month")))


def seasonal_dow(df: DataFrame) -> DataFrame:
    stats = df.groupBy(F.weekday("timestamp").alias("day_of_week")).agg(
        F.avg("aqi").alias("mean"),
        F.coalesce(F.stddev_samp("aqi"), F.lit(0.0)).alias("std"))
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    return stats.withColumns({
        "day_name": F.element_at(names, F.col("day_of_week") + 1),
        "is_weekend": F.col("day_of_week") >= 5})


def box_statistics(df: DataFrame, columns: list[str] = POLLUTANTS) -> DataFrame:
    return exact_quantiles(df, columns, QUARTILES).filter("n > 0").select(
        "variable", "n", F.col("q0").alias("q1"), F.col("q1").alias("median"),
        F.col("q2").alias("q3"), "mean", "std", F.col("low").alias("min"),
        F.col("high").alias("max"))


def fences(df: DataFrame, columns: list[str] = CORE) -> DataFrame:
    """Quartile fences: one row per column."""
    spread = F.col("q1") - F.col("q0")
    return exact_quantiles(df, columns, [0.25, 0.75]).filter("n > 0").select(
        "variable", "n", spread.alias("iqr"),
        (F.col("q0") - F.lit(FENCE) * spread).alias("lower_bound"),
        (F.col("q1") + F.lit(FENCE) * spread).alias("upper_bound"))


def _outside() -> Column:
    return ((F.col("value") < F.col("lower_bound"))
            | (F.col("value") > F.col("upper_bound")))


def outlier_summary(df: DataFrame, columns: list[str] = CORE) -> DataFrame:
    return (melt(df, columns).join(F.broadcast(fences(df, columns)), "variable")
            .groupBy("variable", "n", "iqr", "lower_bound", "upper_bound")
            .agg(F.count_if(_outside()).alias("outliers"))
            .withColumn("outlier_pct", F.col("outliers") * 100.0 / F.col("n")))


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """Every value of the column with its time and whether it is an outlier."""
    bounds = fences(df, [column]).drop("n")
    rows = df.select("station_id", "timestamp", F.lit(column).alias("variable"),
                     F.col(column).cast("double").alias("value")).dropna()
    return rows.join(F.broadcast(bounds), "variable").select(
        "station_id", "timestamp", "variable", "value", _outside().alias("is_outlier"))
