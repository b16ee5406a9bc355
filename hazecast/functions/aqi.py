"""Air Quality Index as native column expressions.

Inputs are finite or null: clean NaN and infinities on ingest
(``cleaning.normalize_nan``), since Spark orders NaN above every number.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazecast.fixed_values import (
    AQI_CAP, BREAKPOINTS, CATEGORIES, POLLUTANT_NAMES, POLLUTANTS)


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _truncated(pollutant: str) -> str:
    cut = (f"floor({pollutant} * 10D) / 10D" if pollutant == "pm2_5"
           else f"CAST(floor({pollutant}) AS DOUBLE)")
    return f"CASE WHEN {pollutant} >= 0 THEN {cut} END"


def _sub_index(pollutant: str) -> str:
    c = f"({_truncated(pollutant)})"
    arms = ""
    for c_low, c_high, i_low, i_high in BREAKPOINTS[pollutant]:
        slope = _number((i_high - i_low) / (c_high - c_low))
        arms += (f" WHEN {c} BETWEEN {_number(c_low)} AND {_number(c_high)}"
                 f" THEN rint({slope} * ({c} - {_number(c_low)}) + {_number(i_low)})")
    top = _number(BREAKPOINTS[pollutant][-1][1])
    return f"CASE{arms} WHEN {c} > {top} THEN {_number(AQI_CAP)} END"


# Expressions are handed over as SQL text: one call per column, not one per
# operator in it, which keeps wide tables quick to plan.

def truncated(pollutant: str) -> Column:
    """Concentration cut to the precision of its breakpoint table."""
    return F.expr(_truncated(pollutant))


def sub_index(pollutant: str) -> Column:
    """Piecewise linear index of the truncated concentration, half-even rounded.

    Values above the last band give the cap; truncation leaves no value
    between two bands, negative or null values give null.
    """
    return F.expr(_sub_index(pollutant))


def sub_name(pollutant: str) -> str:
    return f"{pollutant}_sub"


def with_sub_indices(df: DataFrame) -> DataFrame:
    return df.withColumns({sub_name(p): sub_index(p)
                           for p in POLLUTANTS if p in df.columns})


def with_aqi(df: DataFrame) -> DataFrame:
    """Add ``aqi``: the largest valid sub-index, null when none is valid."""
    present = [_sub_index(p) for p in POLLUTANTS if p in df.columns]
    # greatest() skips nulls but wants two arguments
    return df.withColumn("aqi", F.expr(
        f"greatest({', '.join([*present, 'CAST(NULL AS DOUBLE)', 'CAST(NULL AS DOUBLE)'])})"))


def dominant() -> Column:
    """First pollutant, in table order, whose index equals ``aqi``."""
    return F.coalesce(*[
        F.when(F.col(sub_name(p)) == F.col("aqi"), F.lit(POLLUTANT_NAMES[p]))
        for p in POLLUTANTS])


def sub_indices_long(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per observation and pollutant."""
    wide = with_sub_indices(df)
    pairs = F.array(*[
        F.struct(F.lit(POLLUTANT_NAMES[p]).alias("pollutant"),
                 F.col(sub_name(p)).alias("sub_index"))
        for p in POLLUTANTS])
    return wide.select(*keep, F.inline(pairs))


def category(value: Column, strict: bool = False, field: str = "label") -> Column:
    """Category of an index value.

    The whole part decides, so 100.4 is Moderate. With ``strict`` the integer
    ranges hold literally: 100.4 lies in none and falls to the last category.
    Null and negative values have no category, unless ``strict`` gives
    negative ones the last.
    """
    position = {"label": 2, "colour": 3, "message": 4}[field]
    tested = value if strict else F.floor(value)
    last = F.lit(CATEGORIES[-1][position])
    arms = [(tested.between(row[0], row[1]), F.lit(row[position])) for row in CATEGORIES]
    chain = reduce(lambda acc, arm: acc.when(*arm), arms[1:], F.when(*arms[0]))
    valid = value.isNotNull() if strict else value >= 0
    return F.when(valid, chain.otherwise(last))
