"""Small inputs and brute-force results for the tests."""

import numpy as np
import pandas as pd

from hazecast.fixed_values import POLLUTANTS, WEATHER


def series(hours: int, seed: int = 1, station: int = 0, start: str = "2024-01-01",
           missing: float = 0.1, gaps: float = 0.0) -> pd.DataFrame:
    """Hourly readings of one station with missing values and missing hours."""
    rng = np.random.default_rng(seed)
    times = pd.date_range(start, periods=hours, freq="h")
    df = pd.DataFrame({"station_id": station, "timestamp": times})
    scale = dict(zip(POLLUTANTS + WEATHER, [60, 120, 90, 60, 60, 4000, 40, 100, 20, 360, 1000]))
    for c, s in scale.items():
        values = np.round(rng.gamma(2.0, s / 2.0, hours), 2)
        values[rng.random(hours) < missing] = np.nan
        df[c] = values
    return df[rng.random(hours) >= gaps].reset_index(drop=True)


def to_spark(spark, df: pd.DataFrame, schema: str | None = None):
    """NaN becomes null, as the readers leave it."""
    clean = df.astype(object).where(df.notna(), None)
    if schema is None:
        kinds = {"i": "int", "f": "double", "M": "timestamp", "b": "boolean", "O": "string"}
        schema = ", ".join(f"`{c}` {kinds[df[c].dtype.kind]}" for c in df.columns)
    rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r)
            for r in clean.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


def same(a, b, tolerance=1e-8) -> bool:
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    return np.allclose(a, b, rtol=tolerance, atol=tolerance, equal_nan=True)
