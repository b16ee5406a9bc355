"""Missing values, headers, keys and feature alignment."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from hazecast.fixed_values import POLLUTANTS


def half_even(value: Column, digits: int) -> Column:
    """Rounded to decimals as the binary value stands, ties to even."""
    scale = F.lit(10.0 ** digits)
    return F.rint(value * scale) / scale


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (DoubleType, FloatType))]


def _finite(name: str) -> str:
    c = f"`{name}`"
    return f"CASE WHEN NOT isnan({c}) AND abs({c}) < double('Infinity') THEN {c} END"


def normalize_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN and infinities become null, so null is the only missing value."""
    names = double_columns(df) if columns is None else columns
    return df.withColumns({c: F.expr(_finite(c)) for c in names})


def impute_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, NaN and infinities become 0."""
    doubles = set(double_columns(df))
    return df.withColumns({
        c: F.expr(f"coalesce({_finite(c)}, 0D)" if c in doubles else f"coalesce(`{c}`, 0)")
        for c in columns})


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def drop_all_null_pollutants(df: DataFrame) -> DataFrame:
    present = [c for c in POLLUTANTS if c in df.columns]
    return df.dropna(how="all", subset=present) if present else df


def epoch_millis(df: DataFrame, column: str = "timestamp") -> Column:
    """The column as epoch milliseconds, null where it cannot be read.

    Text is read row by row: digits are milliseconds, the rest is a date.
    """
    kind = df.schema[column].dataType.typeName()
    value = F.col(column)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_millis(value.cast("timestamp"))
    if kind == "string":
        text = F.trim(value)
        number = F.floor(text.try_cast("double")).try_cast("bigint")
        return F.coalesce(text.try_cast("bigint"),
                          number,
                          F.unix_millis(F.try_to_timestamp(text)))
    return value.try_cast("bigint")


def normalize_timestamp(df: DataFrame, column: str = "timestamp",
                        strict: bool = False) -> DataFrame:
    """Replace the column by epoch milliseconds and drop unreadable rows.

    With ``strict`` a text column is taken as a whole: if any value is no
    date, every value is read as a number instead, and dates are dropped.
    """
    if strict and df.schema[column].dataType.typeName() == "string":
        moment = F.try_to_timestamp(F.trim(F.col(column)))
        # one Boolean row decides for the whole column
        all_dates = df.agg(F.coalesce(F.bool_and(moment.isNotNull()), F.lit(True))
                           .alias("all_dates")).scalar()
        number = F.floor(F.trim(F.col(column)).try_cast("double")).try_cast("bigint")
        key = F.when(all_dates, F.unix_millis(moment)).otherwise(number)
    else:
        key = epoch_millis(df, column)
    return df.withColumn(column, key).filter(F.col(column).isNotNull())


def align_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Add model columns the table lacks, as 0."""
    missing = [c for c in features if c not in df.columns]
    return df.withColumns({c: F.lit(0.0) for c in missing}) if missing else df
