import datetime as dt

from hazecast.plans import forecasting

READINGS = ["temperature", "humidity", "wind_speed", "wind_direction", "pressure"]
SCHEMA = "station_id int, timestamp timestamp, pm2_5 double, " + ", ".join(f"{c} double" for c in READINGS)


def test_readings_are_shown_as_python_prints_them(spark):
    """Ties go to the even digit of the exact value; thousands are not grouped."""
    rows = [(0.25, 44.5, 4.35, 1016.5, 1016.5), (-0.04, 45.5, 0.15, 2.5, 12345.5), (12.0, 0.5, 0.05, 359.5, 999.5)]
    table = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1), 10.0, *r) for i, r in enumerate(rows)]
        + [(9, dt.datetime(2024, 1, 1), 10.0, *[None] * 5)], SCHEMA)
    got = {r.station_id: tuple(r[c] for c in READINGS) for r in forecasting.current_conditions(table).collect()}
    assert got.pop(9) == ("N/A",) * 5
    assert got == {i: (f"{t:.1f}°C", f"{h:.0f}%", f"{w:.1f} km/h", f"{d:.0f}°", f"{p:.0f} hPa")
                   for i, (t, h, w, d, p) in enumerate(rows)}
