"""The SQL each registered query is checked against (DuckDB)."""

from hazecast.fixed_values import (
    BREAKPOINTS, CATEGORIES, CHANGE_WINDOWS, DAY_NAMES, EWMA_SPANS, HORIZONS,
    INTERACTION_PAIRS, LAG_STEPS, MONTH_NAMES, POLLUTANT_NAMES, POLLUTANTS, ROLLING_WINDOWS,
    TARGETS, WEATHER, WINDOWED)

USERS_PER_STATION = 10
CORE = [*POLLUTANTS, *WEATHER, "aqi"]
KEY = "station_id, timestamp"


def num(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def r6(expression: str, name: str) -> str:
    """Rounded like ``spark_queries.shown``, and without a negative zero."""
    return (f"round_even(round_even(({expression}) * 1e9, 0) / 1e9 * 1e6, 0) / 1e6 + 0e0 "
            f"AS {name}")


def half_even(expression: str, scale: str) -> str:
    return f"round_even(({expression}) * {scale}, 0) / {scale} + 0e0"


def rounded(names) -> str:
    return ", ".join(r6(c, c) for c in names)


def truncated(p: str) -> str:
    cut = f"floor({p} * 10e0) / 10e0" if p == "pm2_5" else f"floor({p})"
    return f"CASE WHEN {p} >= 0 THEN {cut} END"


def sub(p: str) -> str:
    t = f"({truncated(p)})"
    arms = [f"WHEN {t} BETWEEN {num(cl)} AND {num(ch)} THEN round_even("
            f"{num((ih - il) / (ch - cl))} * ({t} - {num(cl)}) + {num(il)}, 0)"
            for cl, ch, il, ih in BREAKPOINTS[p]]
    return f"CASE {' '.join(arms)} WHEN {t} > {num(BREAKPOINTS[p][-1][1])} THEN 500e0 END"


def category(value: str, strict: bool = False, position: int = 2) -> str:
    tested = value if strict else f"floor({value})"
    arms = " ".join(f"WHEN {tested} BETWEEN {c[0]} AND {c[1]} THEN '{c[position]}'"
                    for c in CATEGORIES)
    valid = f"{value} IS NOT NULL" if strict else f"{value} >= 0"
    return f"CASE WHEN {valid} THEN CASE {arms} ELSE '{CATEGORIES[-1][position]}' END END"


def peak(kind: str, scale: str) -> str:
    return f"max(value) FILTER (WHERE event_type = '{kind}') * {scale}"


AIR = f"""air AS (
  SELECT CAST(user_id // {USERS_PER_STATION} AS INTEGER) AS station_id, date_trunc('hour', ts) AS timestamp,
    {peak('view', '0.6e0')} AS pm2_5, {peak('click', '1.2e0')} AS pm10,
    {peak('purchase', '3e0')} AS no2, {peak('signup', '2e0')} AS so2,
    {peak('error', '1e0')} AS o3, max(value) * 20e0 AS co
  FROM events GROUP BY 1, 2)"""
WX = f"""wx AS (
  SELECT station_id, timestamp, max(k) * 0.4e0 AS temperature, min(k) * 1e0 AS humidity,
    max(value) * 0.1e0 AS wind_speed,
    max(k) FILTER (WHERE event_type = 'click') * 3.6e0 AS wind_direction,
    1000e0 + min(value) AS pressure
  FROM (SELECT CAST(user_id // {USERS_PER_STATION} AS INTEGER) AS station_id,
          date_trunc('hour', ts) + INTERVAL 1 HOUR AS timestamp, value, event_type,
          CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events) GROUP BY 1, 2)"""
OBS = "obs AS (SELECT * FROM air JOIN wx USING (station_id, timestamp))"
SUBS = ("subs AS (SELECT *, " + ", ".join(f"{sub(p)} AS {p}_sub" for p in POLLUTANTS)
        + " FROM obs)")
GREATEST = "greatest(" + ", ".join(f"{p}_sub" for p in POLLUTANTS) + ")"
CORE_TABLE = (f"core AS (SELECT {KEY}, {', '.join(POLLUTANTS + WEATHER)}, "
              f"{GREATEST} AS aqi FROM subs)")
COPIES = """copies AS (
  SELECT *, 1::BIGINT AS ingest_seq FROM air
  UNION ALL BY NAME
  SELECT * REPLACE (pm2_5 + 1e0 AS pm2_5, NULL::DOUBLE AS o3), 2::BIGINT AS ingest_seq
  FROM air WHERE hour(timestamp) % 3 <> 0)"""


def with_air(body: str) -> str:
    return f"WITH {AIR} {body}"


def with_wx(body: str) -> str:
    return f"WITH {WX} {body}"


def with_obs(body: str) -> str:
    return f"WITH {AIR}, {WX}, {OBS} {body}"


def with_core(body: str) -> str:
    return f"WITH {AIR}, {WX}, {OBS}, {SUBS}, {CORE_TABLE} {body}"


ALL_AIR = f"SELECT {KEY}, {rounded(POLLUTANTS)} FROM air"
ALL_WX = f"SELECT {KEY}, {rounded(WEATHER)} FROM wx"
ALL_OBS = f"SELECT {KEY}, {rounded(POLLUTANTS + WEATHER)} FROM obs"
ALL_CORE = f"SELECT {KEY}, {rounded(CORE)} FROM core"
ALL_CORE_MS = f"SELECT station_id, epoch_ms(timestamp) AS timestamp, {rounded(CORE)} FROM core"

# --- Windows --------------------------------------------------------------------


def frame(n: int, by_hour: bool, ahead: bool = False) -> str:
    if by_hour:
        return f"RANGE BETWEEN INTERVAL {n - 1} HOUR PRECEDING AND CURRENT ROW"
    return f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


SERIES = "PARTITION BY station_id ORDER BY timestamp"


def shifted(c: str, n: int, by_hour: bool) -> str:
    if by_hour:
        way = "FOLLOWING" if n > 0 else "PRECEDING"
        at = f"INTERVAL {abs(n)} HOUR {way}"
        return f"max({c}) OVER ({SERIES} RANGE BETWEEN {at} AND {at})"
    return f"{'lead' if n > 0 else 'lag'}({c}, {abs(n)}) OVER ({SERIES})"


def over(function: str, c: str, n: int, by_hour: bool) -> str:
    return f"{function}({c}) OVER ({SERIES} {frame(n, by_hour)})"


def window_columns(group: str, by_hour: bool = False) -> dict[str, str]:
    out = {}
    if group == "rolling_mean":
        for c in WINDOWED:
            for n in ROLLING_WINDOWS:
                out[f"{c}_rolling_mean_{n}h"] = over("avg", c, n, by_hour)
    if group == "rolling_std":
        for c in WINDOWED:
            for n in ROLLING_WINDOWS:
                out[f"{c}_rolling_std_{n}h"] = (
                    f"coalesce({over('stddev_samp', c, n, by_hour)}, 0e0)")
    if group == "rolling_minmax":
        for c in WINDOWED:
            for n in ROLLING_WINDOWS:
                low, high = over("min", c, n, by_hour), over("max", c, n, by_hour)
                out[f"{c}_rolling_min_{n}h"] = low
                out[f"{c}_rolling_max_{n}h"] = high
                out[f"{c}_range_{n}h"] = f"{high} - {low}"
    if group == "lags":
        for c in WINDOWED:
            for n in LAG_STEPS:
                out[f"{c}_lag_{n}h"] = shifted(c, -n, by_hour)
    if group == "change_rate":
        for n in CHANGE_WINDOWS:
            out[f"aqi_change_rate_{n}h"] = f"(aqi - {shifted('aqi', -n, by_hour)}) / {n}e0"
    if group == "targets":
        for n in HORIZONS:
            out[f"aqi_target_{n}h"] = shifted("aqi", n, by_hour)
    return out


def named(columns: dict[str, str]) -> str:
    return ", ".join(r6(e, c) for c, e in columns.items())


def windowed(group: str) -> str:
    return with_core(f"SELECT {KEY}, {rounded(WINDOWED)}, {named(window_columns(group))} FROM core")


EWMA_NAMES = [f"{c}_ewma_{s}h" for c in WINDOWED for s in EWMA_SPANS]


def ewma_table(by_hour: bool = False) -> str:
    """Definition: every earlier value of the series, weighted by its age."""
    at = ("CAST(epoch(timestamp) AS BIGINT) // 3600" if by_hour
          else f"row_number() OVER ({SERIES})")
    cells = []
    for c in WINDOWED:
        for s in EWMA_SPANS:
            w = f"pow({num(1 - 2 / (s + 1))}, a.i - b.i)"
            cells.append(f"sum(b.{c} * {w}) / sum(CASE WHEN b.{c} IS NOT NULL THEN {w} END) "
                         f"AS {c}_ewma_{s}h")
    return (f"placed AS (SELECT {KEY}, {', '.join(WINDOWED)}, {at} AS i FROM core), "
            f"ewma AS (SELECT a.station_id, a.timestamp, {', '.join(cells)} "
            "FROM placed a JOIN placed b ON a.station_id = b.station_id AND b.i <= a.i "
            "GROUP BY 1, 2)")


TIME = {
    "hour": "CAST(hour(timestamp) AS INTEGER)",
    "day_of_week": "CAST(isodow(timestamp) - 1 AS INTEGER)",
    "month": "CAST(month(timestamp) AS INTEGER)",
    "is_weekend": "CAST(isodow(timestamp) >= 6 AS INTEGER)",
}
SEGMENT = ("CAST(CASE WHEN hour(timestamp) < 6 THEN 0 WHEN hour(timestamp) < 12 THEN 1 "
           "WHEN hour(timestamp) < 18 THEN 2 ELSE 3 END AS INTEGER)")


def circle(name: str, value: str, period: str) -> dict[str, str]:
    return {f"{name}_{f}": f"{f}(2e0 * pi() * {value} / {period}e0)" for f in ("sin", "cos")}


CYCLIC = circle("hour", "hour(timestamp)", "24") | circle("month", "month(timestamp)", "12")
CALENDAR = (circle("day_of_year", "dayofyear(timestamp)", "365.25")
            | circle("week_of_year", "week(timestamp)", "52"))
PRODUCTS = {f"{a}_x_{b}": f"{a} * {b}" for a, b in INTERACTION_PAIRS} | {
    "temp_humidity_idx": "temperature * humidity / 100e0"}


def plain(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def feature_sql(by_hour: bool = False, last_days: int | None = None) -> str:
    groups = {}
    for g in ("rolling_mean", "rolling_std", "rolling_minmax", "lags", "change_rate", "targets"):
        groups |= window_columns(g, by_hour)
    body = (
        f", {ewma_table(by_hour)} SELECT station_id, epoch_ms(timestamp) AS timestamp, "
        f"{rounded(CORE)}, {plain(TIME)}, {named(CYCLIC)}, {SEGMENT} AS day_segment, "
        f"{named(CALENDAR)}, {named(groups)}, {rounded(EWMA_NAMES)}, {named(PRODUCTS)} "
        "FROM core JOIN ewma USING (station_id, timestamp)")
    if last_days is None:
        return with_core(body)
    since = "timestamp >= (SELECT max(timestamp) FROM {0}) - INTERVAL {1} DAY"
    return (f"WITH {AIR}, {WX}, {OBS}, {SUBS}, {CORE_TABLE.replace('core AS', 'whole AS')}, "
            f"core AS (SELECT * FROM whole WHERE {since.format('air', last_days)} "
            f"AND {since.format('wx', last_days)}){body}")


# --- Exploration --------------------------------------------------------------------

LONG = ("long AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS value, station_id, timestamp FROM core" for c in CORE)
    + ") WHERE value IS NOT NULL)")
QUARTILES = ("quartiles AS (SELECT variable, count(*) AS n, quantile_cont(value, 0.25) AS q1, "
             "quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, "
             "avg(value) AS mean, stddev_samp(value) AS std, min(value) AS low, "
             "max(value) AS high FROM long GROUP BY 1)")
FENCES = ("fences AS (SELECT variable, n, q3 - q1 AS iqr, q1 - 1.5e0 * (q3 - q1) AS lower_bound, "
          "q3 + 1.5e0 * (q3 - q1) AS upper_bound FROM quartiles)")


def correlation_pairs(columns, table: str) -> str:
    return "pairs AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS variable, '{b}' AS other, "
        f"round_even((CASE WHEN stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) > 0 "
        f"AND stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL) > 0 "
        f"THEN covar_pop({a}, {b}) / (stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) "
        f"* stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL)) END) * 1e3, 0) / 1e3 + 0e0 AS r FROM {table}"
        for a in columns for b in columns) + ")"


def resample(period: str, columns, table: str = "core", having: str = "") -> str:
    start = f"CAST(date_trunc('{period}', timestamp) AS DATE)"
    label = {"day": "start", "week": "CAST(start + INTERVAL 6 DAY AS DATE)",
             "month": "last_day(start)"}[period]
    means = ", ".join(f"avg({c}) AS {c}" for c in columns)
    return (f"means AS (SELECT station_id, {start} AS start, {means} FROM {table} GROUP BY 1, 2), "
            "spine AS (SELECT station_id, CAST(unnest(generate_series(first::TIMESTAMP, "
            f"last::TIMESTAMP, INTERVAL 1 {period})) AS DATE) AS start FROM "
            "(SELECT station_id, min(start) AS first, max(start) AS last FROM means GROUP BY 1)), "
            f"filled AS (SELECT station_id, {label} AS period, {', '.join(columns)} "
            "FROM spine LEFT JOIN means USING (station_id, start))")


def resample_sql(period: str) -> str:
    return with_core(f", {resample(period, CORE)} SELECT station_id, period, {rounded(CORE)} FROM filled")


def seasonal(part: str, name: str, extra: str, std: str = "coalesce(stddev_samp(aqi), 0e0)") -> str:
    return with_core(
        f", s AS (SELECT {part} AS {name}, avg(aqi) AS mean, quantile_cont(aqi, 0.5) AS median, "
        f"{std} AS std FROM core GROUP BY 1) SELECT {name}, {extra} FROM s")


STACKED = ", ".join(
    r6(" + ".join(f"coalesce({p}, 0e0)" for p in POLLUTANTS[:i + 1]), f"{c}_stacked")
    for i, c in enumerate(POLLUTANTS))

# --- Latest rows and forecasts ------------------------------------------------------

LATEST = ("latest AS (SELECT * FROM core QUALIFY row_number() OVER "
          "(PARTITION BY station_id ORDER BY timestamp DESC) = 1)")
SCALED = "scaled AS (" + " UNION ALL ".join(
    f"SELECT station_id, {h} AS horizon, aqi * (1e0 + {h} / 48e0) AS forecast FROM latest"
    for h in HORIZONS) + ")"
NAN_COLUMNS = {"pm2_5": "> 50", "pm10": "> 100", "no2": "> 200"}


def nan_to(value: str, columns) -> str:
    return ", ".join(
        r6(f"CASE WHEN {c} {NAN_COLUMNS[c]} THEN {value} ELSE {c} END"
           if c in NAN_COLUMNS else c, c) for c in columns)


def targets_table() -> str:
    return f"made AS (SELECT *, {plain(window_columns('targets'))} FROM core)"


def metrics_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{t}' AS target, {t} AS y, aqi AS p FROM made" for t in TARGETS)
    return with_core(
        f", {targets_table()}, scored AS (SELECT * FROM ({parts}) WHERE y IS NOT NULL AND p IS NOT NULL) "
        "SELECT target, " + ", ".join([
            r6("sqrt(avg((y - p) * (y - p)))", "rmse"), r6("avg(abs(y - p))", "mae"),
            r6("1e0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))", "r2")])
        + ", count(*) AS n FROM scored GROUP BY 1")


def constant_models_sql() -> str:
    """Rules that say one number of the training labels; the first target has been retrained."""
    first = TARGETS[0]
    parts = " UNION ALL ".join(
        f"SELECT '{t}' AS target, {KEY}, {t} AS y FROM made WHERE {t} IS NOT NULL" for t in TARGETS)
    rules = " UNION ALL ".join(
        f"SELECT target, {n} AS nth, '{model}' AS model, {f}(y) AS p FROM split WHERE is_train GROUP BY target"
        for n, (model, f) in enumerate((("mean", "avg"), ("greatest", "max"), ("least", "min"))))
    return with_core(
        f", {targets_table()}, labelled AS ({parts}), split AS (SELECT *, "
        f"row_number() OVER (PARTITION BY target, station_id ORDER BY timestamp) - 1 < "
        "floor(count(*) OVER (PARTITION BY target, station_id) * 0.8e0) AS is_train FROM labelled), "
        f"rules AS ({rules}), tried AS (SELECT target, nth, model, sqrt(avg((y - p) * (y - p))) AS rmse, "
        "avg(abs(y - p)) AS mae FROM split JOIN rules USING (target) WHERE NOT is_train GROUP BY ALL), "
        f"kept AS (SELECT * FROM tried WHERE target <> '{first}' OR model = 'greatest' QUALIFY "
        "row_number() OVER (PARTITION BY target ORDER BY rmse, nth) = 1) "
        f"SELECT target, model, {rounded(['rmse', 'mae'])}, (SELECT count(*) FROM made) AS training_rows FROM kept")


def split_sql() -> str:
    """Labelled rows of each target, the first four fifths of a station's for training."""
    parts = " UNION ALL ".join(
        f"SELECT '{t}' AS target, {KEY}, coalesce(pm10, 0e0) AS a, coalesce(aqi, 0e0) AS b, {t} AS y "
        f"FROM made WHERE {t} IS NOT NULL" for t in TARGETS)
    return (f"{targets_table()}, labelled AS ({parts}), split AS (SELECT *, "
            "row_number() OVER (PARTITION BY target, station_id ORDER BY timestamp) - 1 < "
            "floor(count(*) OVER (PARTITION BY target, station_id) * 0.8e0) AS is_train FROM labelled)")


def rule_report_sql(rules: dict[str, str], columns: str) -> str:
    """The best of rules that say one number of the training labels, per target."""
    said = " UNION ALL ".join(
        f"SELECT target, {n} AS nth, '{model}' AS model, {f}(y) AS p FROM split WHERE is_train GROUP BY target"
        for n, (model, f) in enumerate(rules.items()))
    return with_core(
        f", {split_sql()}, rules AS ({said}), tried AS (SELECT target, nth, model, "
        "sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, "
        "1e0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 "
        "FROM split JOIN rules USING (target) WHERE NOT is_train GROUP BY ALL), "
        "kept AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY target ORDER BY rmse, nth) = 1) "
        f"SELECT {columns} FROM kept")


def pair_sql(body: str) -> str:
    """Ridge of penalty 1 over pm10 and the index, by Cramer's rule on centred sums."""
    return with_core(
        f", {split_sql()}, sums AS (SELECT target, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, "
        "var_pop(a) * count(*) + 1e0 AS aa, var_pop(b) * count(*) + 1e0 AS bb, covar_pop(a, b) * count(*) AS ab, "
        "covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_ FROM split WHERE is_train GROUP BY 1), "
        "fit AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, "
        f"(by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM sums) {body}")


def shown(c: str, digits: int, unit: str) -> str:
    pattern = f"%.{digits}f{unit}".replace("%'", "%%'")
    return f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE printf('{pattern}', {c}) END AS {c}"


# --- Store --------------------------------------------------------------------------

MIXED = ("CASE WHEN station_id % 4 <> 3 OR hour(timestamp) % 2 = 0 "
         "THEN epoch_ms(timestamp) END")
BATCHES = f"""staged AS (SELECT station_id, epoch_ms(timestamp) AS ms, day(timestamp) AS d,
    {', '.join(CORE)} FROM core),
  old AS (SELECT * FROM staged WHERE d <= 20),
  new AS (SELECT * REPLACE (CASE WHEN station_id % 2 = 0 THEN pm2_5 + 1e0 END AS pm2_5,
    co + 5e0 AS co) FROM staged WHERE d > 15)"""


def upsert_sql(keep_known: bool) -> str:
    def cell(c):
        fresh = f"coalesce(n.{c}, o.{c})" if keep_known else \
            f"CASE WHEN n.ms IS NOT NULL THEN n.{c} ELSE o.{c} END"
        return r6(fresh, c)
    return with_core(
        f", {BATCHES} SELECT coalesce(n.station_id, o.station_id) AS station_id, "
        f"coalesce(n.ms, o.ms) AS timestamp, {', '.join(cell(c) for c in CORE)} "
        "FROM old o FULL OUTER JOIN new n ON o.station_id = n.station_id AND o.ms = n.ms")


def survivors(order: str) -> str:
    return (f"WITH {AIR}, {COPIES} SELECT {KEY}, {rounded(POLLUTANTS)}, ingest_seq FROM copies "
            f"QUALIFY row_number() OVER (PARTITION BY station_id, timestamp ORDER BY ingest_seq {order}) = 1")


def uniqueness(table: str) -> str:
    return (f"SELECT '{table}' AS name, CAST(sum(n) AS BIGINT) AS row_count, "
            f"count(*) AS key_count, max(n) = 1 AS is_unique FROM "
            f"(SELECT count(*) AS n FROM {table} GROUP BY {KEY})")


def stream_means(period: str) -> str:
    start = f"CAST(date_trunc('{period}', timestamp) AS DATE)"
    span = {"day": 1, "week": 7}[period]
    return with_core(
        f", means AS (SELECT station_id, {start} AS start, "
        f"{', '.join(f'avg({c}) AS {c}' for c in WINDOWED)} FROM core GROUP BY 1, 2) "
        f"SELECT station_id, CAST(start + INTERVAL {span - 1} DAY AS DATE) AS period, "
        f"{rounded(WINDOWED)} FROM means WHERE start + INTERVAL {span} DAY <= "
        "(SELECT max(timestamp) FROM core) - INTERVAL 5 DAY")


def stump_sql() -> str:
    """Every cut of four features tried; the best one's two leaves, shrunk, on the mean."""
    features = {"hour": "CAST(hour(timestamp) AS BIGINT)", "day_of_week": "isodow(timestamp) - 1",
                "is_weekend": "CAST(isodow(timestamp) >= 6 AS BIGINT)", "day_segment": SEGMENT}
    sides = " UNION ALL ".join(f"SELECT {i} AS f, CAST({e} AS BIGINT) AS x, {KEY}, y, is_train FROM split"
                               for i, e in enumerate(features.values()))

    def soft(g):
        return f"(sign({g}) * greatest(abs({g}) - 0.1e0, 0e0))"

    return with_core(
        f", {targets_table()}, split AS (SELECT {KEY}, aqi_target_24h AS y, row_number() OVER (PARTITION BY station_id "
        "ORDER BY timestamp) - 1 < floor(count(*) OVER (PARTITION BY station_id) * 0.8e0) AS is_train "
        "FROM made WHERE aqi_target_24h IS NOT NULL), base AS (SELECT avg(y) AS base, count(*) AS n FROM split WHERE is_train), "
        f"sides AS ({sides}), bins AS (SELECT f, x, sum(base - y) AS g, count(*) AS h FROM sides, base WHERE is_train GROUP BY 1, 2), "
        "cuts AS (SELECT f, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY f) AS g, "
        "sum(h) OVER (PARTITION BY f) AS h FROM bins WINDOW w AS (PARTITION BY f ORDER BY x)), "
        f"best AS (SELECT f, x, -{soft('gl')} / (hl + 1e0) AS low, -{soft('(g - gl)')} / (h - hl + 1e0) AS high FROM cuts "
        f"WHERE hl >= 3 AND h - hl >= 3 ORDER BY {soft('gl')} ** 2 / (hl + 1e0) + {soft('(g - gl)')} ** 2 / (h - hl + 1e0) "
        "DESC, f, x LIMIT 1) "
        f"SELECT {KEY}, {r6('y', 'label')}, {r6('base + 0.3e0 * CASE WHEN s.x <= b.x THEN low ELSE high END', 'prediction')} "
        "FROM sides s JOIN best b USING (f), base WHERE NOT is_train")


ORACLES = {
    "gbt_stump": stump_sql(),
    "parse_air_quality": with_air(ALL_AIR),
    "parse_weather": with_wx(ALL_WX),
    "scan_history": with_obs(
        ALL_OBS + " WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'"),
    "scan_recent": with_air(
        ALL_AIR + " WHERE timestamp >= (SELECT max(timestamp) FROM air) - INTERVAL 5 DAY"),
    "backfill_chunks": with_air(
        ", spans AS (SELECT station_id, CAST(min(timestamp) AS DATE) AS s, "
        "CAST(max(timestamp) AS DATE) AS e FROM air GROUP BY 1), "
        "steps AS (SELECT station_id, s, e, CAST(unnest(range(0, (e - s) // 7 + 1)) AS INTEGER) "
        "AS chunk FROM spans) SELECT station_id, chunk, CAST(s + 7 * chunk AS DATE) AS chunk_start, "
        "least(CAST(s + 7 * chunk + 6 AS DATE), e) AS chunk_end FROM steps"),
    "backfill_union": with_obs(
        ", chunks AS (SELECT *, c AS ingest_seq FROM obs, (SELECT unnest([0, 1, 3, 4]) AS c) "
        "WHERE day(timestamp) - 1 BETWEEN c * 7 AND c * 7 + 7), "
        f"kept AS (SELECT {KEY}, {', '.join(POLLUTANTS[:-1] + WEATHER)}, co + ingest_seq AS co "
        "FROM chunks QUALIFY row_number() OVER (PARTITION BY station_id, timestamp "
        f"ORDER BY ingest_seq) = 1) SELECT {KEY}, {rounded(POLLUTANTS + WEATHER)} FROM kept"),
    "features_csv_roundtrip": with_core(ALL_CORE),
    "training_scan": with_core(ALL_CORE_MS),
    "join_aq_weather": with_obs(ALL_OBS),
    "join_recent": f"WITH {AIR}, {WX}, "
        "a AS (SELECT * FROM air WHERE timestamp >= (SELECT max(timestamp) FROM air) - INTERVAL 5 DAY), "
        "w AS (SELECT * FROM wx WHERE timestamp >= (SELECT max(timestamp) FROM wx) - INTERVAL 5 DAY), "
        f"obs AS (SELECT * FROM a JOIN w USING (station_id, timestamp)) {ALL_OBS}",
    "join_match_report": with_obs(
        "SELECT (SELECT count(*) FROM air) AS air_rows, (SELECT count(*) FROM wx) AS weather_rows, "
        "(SELECT count(*) FROM obs) AS matched_rows"),
    "dedup_keep_first": survivors("ASC"),
    "dedup_keep_last": survivors("DESC"),
    "normalize_headers": with_wx(
        f"SELECT {KEY}, {rounded(['wind_speed', 'pressure'])} FROM wx"),
    "normalize_timestamp": with_air(
        f", t AS (SELECT * REPLACE ({MIXED} AS timestamp) FROM air) "
        f"SELECT {KEY}, {rounded(POLLUTANTS)} FROM t WHERE timestamp IS NOT NULL"),
    "drop_all_null_pollutants": with_air(
        ", t AS (SELECT * REPLACE (CASE WHEN hour(timestamp) % 2 = 1 THEN co END AS co) FROM air) "
        f"SELECT {KEY}, {rounded(POLLUTANTS)} FROM t WHERE coalesce({', '.join(POLLUTANTS)}) IS NOT NULL"),
    "normalize_nan": with_air(f"SELECT {KEY}, {nan_to('NULL', POLLUTANTS)} FROM air"),
    "align_features": with_core(
        f"SELECT {KEY}, {rounded(['pm2_5', 'aqi'])}, 0e0 AS pm2_5_rolling_mean_6h, "
        "0e0 AS aqi_lag_1h FROM core"),
    "latest_observation": with_core(
        f", {LATEST} SELECT {KEY}, {rounded(POLLUTANTS + WEATHER)} FROM latest"),
    "aqi_truncation": with_air(
        f"SELECT {KEY}, {', '.join(r6(truncated(p), p) for p in POLLUTANTS)} FROM air"),
    "aqi_sub_indices": with_air(
        f"SELECT {KEY}, {', '.join(f'{sub(p)} AS {p}_sub' for p in POLLUTANTS)} FROM air"),
    "aqi_sub_indices_long": with_air(" UNION ALL ".join(
        f"SELECT {KEY}, '{POLLUTANT_NAMES[p]}' AS pollutant, {sub(p)} AS sub_index FROM air"
        for p in POLLUTANTS)),
    "aqi_overall": with_air(
        f"SELECT {KEY}, greatest({', '.join(sub(p) for p in POLLUTANTS)}) AS aqi FROM air"),
    "aqi_dominant": f"WITH {AIR}, {SUBS.replace('FROM obs', 'FROM air')} "
        f"SELECT {KEY}, {GREATEST} AS aqi, CASE "
        + " ".join(f"WHEN {p}_sub = {GREATEST} THEN '{POLLUTANT_NAMES[p]}'" for p in POLLUTANTS)
        + " END AS dominant FROM subs",
    "aqi_category": with_core(
        f"SELECT {KEY}, {category('aqi')} AS category, {category('aqi', position=3)} AS colour, "
        f"{category('aqi', position=4)} AS message, "
        f"{category('(pm2_5 * 2.5e0)')} AS part_category, "
        f"{category('(pm2_5 * 2.5e0)', strict=True)} AS part_category_strict FROM core"),
    "pollutant_breakdown": with_core(
        f", {LATEST}, long AS (" + " UNION ALL ".join(
            f"SELECT station_id, '{POLLUTANT_NAMES[p]}' AS pollutant, coalesce({sub(p)}, 0e0) "
            "AS sub_index FROM latest" for p in POLLUTANTS)
        + f") SELECT *, {category('sub_index')} AS category FROM long"),
    "time_features": with_obs(f"SELECT {KEY}, {plain(TIME)} FROM obs"),
    "cyclic_features": with_obs(f"SELECT {KEY}, {named(CYCLIC)} FROM obs"),
    "day_segment": with_obs(f"SELECT {KEY}, {SEGMENT} AS day_segment FROM obs"),
    "calendar_cyclic": with_obs(f"SELECT {KEY}, {named(CALENDAR)} FROM obs"),
    "interactions": with_obs(f"SELECT {KEY}, {named(PRODUCTS)} FROM obs"),
    **{g: windowed(g) for g in ("rolling_mean", "rolling_std", "rolling_minmax", "lags",
                                "change_rate", "targets")},
    "ewma": with_core(f", {ewma_table()} SELECT {KEY}, {rounded(WINDOWED + EWMA_NAMES)} "
                      "FROM core JOIN ewma USING (station_id, timestamp)"),
    "target_coverage": with_core(
        f", {targets_table()} SELECT station_id, count(*) AS rows_total, "
        + ", ".join(f"count({t}) AS {t}_valid" for t in TARGETS) + " FROM made GROUP BY 1"),
    "feature_build": feature_sql(),
    "feature_build_time": feature_sql(by_hour=True),
    "eda_overview": with_core(
        "SELECT count(*) AS row_count, 14 AS column_count, "
        "strftime(min(timestamp), '%Y-%m-%d') AS first_date, "
        "strftime(max(timestamp), '%Y-%m-%d') AS last_date FROM core"),
    "eda_missing": with_core(", m AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {half_even(f'(count(*) - count({c})) * 100e0 / count(*)', '1e2')} "
        "AS missing_pct FROM core" for c in CORE)
        + ") SELECT variable, missing_pct, missing_pct > 5 AS above_5_pct FROM m"),
    "eda_describe": with_core(
        f", {LONG}, {QUARTILES} SELECT variable, n AS count, " + ", ".join(
            f"{half_even(half_even(a, '1e9'), '1e2')} AS {b}" for a, b in (
                ("mean", "mean"), ("std", "std"), ("low", "min"), ("q1", "p25"), ("q2", "p50"),
                ("q3", "p75"), ("high", "max"))) + " FROM quartiles"),
    "eda_histogram": with_core(
        f", {LONG}, ranges AS (SELECT variable, min(value) AS low, max(value) AS high, "
        "(max(value) - min(value)) / 50e0 AS width FROM long GROUP BY 1), "
        "counted AS (SELECT variable, CASE WHEN high > low THEN least(CAST(floor((value - low) "
        "/ width) AS INTEGER) + 1, 50) ELSE 1 END AS bin, count(*) AS bin_count "
        "FROM long JOIN ranges USING (variable) GROUP BY 1, 2), "
        "spine AS (SELECT *, CAST(unnest(range(1, 51)) AS INTEGER) AS bin FROM ranges) "
        f"SELECT variable, bin, {r6('low + (bin - 1) * width', 'bin_start')}, "
        f"{r6('low + bin * width', 'bin_end')}, coalesce(bin_count, 0) AS bin_count "
        "FROM spine LEFT JOIN counted USING (variable, bin)"),
    "eda_corr_matrix": with_core(
        f", {correlation_pairs(CORE, 'core')} SELECT variable, other, r FROM pairs"),
    "eda_top_corr": with_core(
        f", {correlation_pairs(CORE, 'core')} SELECT other AS feature, abs(r) AS abs_correlation, "
        "CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM pairs "
        "WHERE variable = 'aqi' AND other <> 'aqi' AND r IS NOT NULL "
        "ORDER BY abs(r) DESC, other LIMIT 10"),
    "eda_series_raw": with_core(f"SELECT {KEY}, {rounded(['pm2_5', 'pm10', 'aqi'])} FROM core"),
    "resample_daily": resample_sql("day"),
    "resample_weekly": resample_sql("week"),
    "resample_monthly": resample_sql("month"),
    "category_distribution": with_core(
        f", c AS (SELECT {category('aqi')} AS category, count(*) AS hours FROM core "
        "WHERE aqi IS NOT NULL GROUP BY 1) SELECT category, hours, "
        f"{r6('hours::DOUBLE / sum(hours) OVER ()', 'share')} FROM c"),
    "seasonal_hour": seasonal(
        TIME["hour"], "hour", rounded(["mean", "median", "std"]) + ", "
        + r6("mean - std", "band_low") + ", " + r6("mean + std", "band_high"), "stddev_samp(aqi)"),
    "seasonal_month": seasonal(
        TIME["month"], "month", rounded(["mean", "median", "std"])
        + f", ({MONTH_NAMES})[month] AS month_name"),
    "seasonal_dow": seasonal(
        TIME["day_of_week"], "day_of_week", rounded(["mean", "std"])
        + f", ({DAY_NAMES})[day_of_week + 1] AS day_name, day_of_week >= 5 AS is_weekend"),
    "pollutant_daily": with_core(
        f", {resample('day', POLLUTANTS)} SELECT station_id, period, {rounded(POLLUTANTS)}, "
        f"{STACKED} FROM filled"),
    "pollutant_box": with_core(
        f", {LONG}, {QUARTILES} SELECT variable, n, {rounded(['q1'])}, {r6('q2', 'median')}, "
        f"{rounded(['q3', 'mean', 'std'])}, {r6('low', 'min')}, {r6('high', 'max')} FROM quartiles "
        f"WHERE variable IN ({', '.join(repr(p) for p in POLLUTANTS)})"),
    "outlier_summary": with_core(
        f", {LONG}, {QUARTILES}, {FENCES}, o AS (SELECT variable, count(*) FILTER (WHERE "
        "value < lower_bound OR value > upper_bound) AS outliers FROM long JOIN fences "
        f"USING (variable) GROUP BY 1) SELECT variable, n, "
        f"{rounded(['iqr', 'lower_bound', 'upper_bound'])}, outliers, "
        f"{r6('outliers * 100e0 / n', 'outlier_pct')} FROM fences JOIN o USING (variable)"),
    "outlier_rows": with_core(
        f", {LONG}, {QUARTILES}, {FENCES} SELECT station_id, timestamp, variable, {rounded(['value'])}, "
        "value < lower_bound OR value > upper_bound AS is_outlier FROM long JOIN fences "
        "USING (variable) WHERE variable = 'pm2_5'"),
    "training_rows": with_core(
        f", {targets_table()} SELECT {KEY}, {rounded(WINDOWED + TARGETS)} FROM made "
        "WHERE aqi_target_24h IS NOT NULL"),
    "time_split": with_core(
        f"SELECT {KEY}, {rounded(['aqi'])}, row_number() OVER ({SERIES}) - 1 < "
        "floor(count(*) OVER (PARTITION BY station_id) * 0.8e0) AS is_train FROM core"),
    "impute_zero": with_core(
        f"SELECT {KEY}, " + ", ".join(
            r6(f"CASE WHEN {c} {NAN_COLUMNS[c]} THEN 0e0 ELSE coalesce({c}, 0e0) END"
               if c in NAN_COLUMNS else f"coalesce({c}, 0e0)", c) for c in CORE) + " FROM core"),
    "regression_metrics": metrics_sql(),
    "top_features": with_core(
        f", {targets_table()}, {correlation_pairs([*POLLUTANTS, *WEATHER, *TARGETS], 'made')} "
        "SELECT variable AS target, other AS feature, abs(r) AS importance, "
        "CAST(row_number() OVER (PARTITION BY variable ORDER BY abs(r) DESC NULLS LAST, other) "
        f"AS INTEGER) AS place FROM pairs WHERE variable IN ({', '.join(repr(t) for t in TARGETS)}) "
        f"AND other IN ({', '.join(repr(c) for c in POLLUTANTS + WEATHER)}) QUALIFY place <= 10"),
    "forecast_series": with_core(
        f", {LATEST} " + " UNION ALL ".join(
            f"SELECT station_id, {h} AS horizon, timestamp + INTERVAL {h} HOUR AS at, "
            "aqi + 0e0 AS value FROM latest WHERE aqi IS NOT NULL" for h in HORIZONS)
        + " UNION ALL SELECT station_id, 0, max(timestamp), coalesce(arg_max(aqi, timestamp) "
          "FILTER (WHERE aqi IS NOT NULL), 0e0) FROM core GROUP BY 1"),
    "forecast_alerts": with_core(
        f", {LATEST}, {SCALED} SELECT station_id, 'Day ' || (horizon // 24) AS day, "
        f"CAST(floor(forecast) AS INTEGER) AS value, {category('forecast')} AS category "
        "FROM scaled WHERE forecast > 150"),
    "forecast_cards": with_core(
        f", {LATEST}, {SCALED} SELECT station_id, horizon, CAST(floor(forecast) AS INTEGER) AS value, "
        f"coalesce({category('forecast')}, 'No Model Loaded') AS category FROM scaled"),
    "current_conditions": with_core(
        f", {LATEST} SELECT {KEY}, CAST(floor(coalesce(aqi, 0e0)) AS INTEGER) AS aqi, "
        f"{category('coalesce(aqi, 0e0)')} AS category, "
        f"{category('coalesce(aqi, 0e0)', position=4)} AS message, "
        + ", ".join([shown("temperature", 1, "°C"), shown("humidity", 0, "%%"),
                     shown("wind_speed", 1, " km/h"), shown("wind_direction", 0, "°"),
                     shown("pressure", 0, " hPa")]) + " FROM latest"),
    "sanitize_features": f"WITH {AIR}, {COPIES}, t AS (SELECT * REPLACE ({MIXED} AS timestamp, "
        "CASE WHEN hour(timestamp) % 2 = 1 THEN co END AS co) FROM copies), "
        f"u AS (SELECT * FROM t WHERE timestamp IS NOT NULL AND coalesce({', '.join(POLLUTANTS)}) "
        f"IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY ingest_seq DESC) = 1) "
        f"SELECT {KEY}, {rounded(POLLUTANTS)}, ingest_seq FROM u",
    "upsert_features": upsert_sql(False),
    "upsert_coalesce": upsert_sql(True),
    "upsert_report": with_core(
        f", {BATCHES} SELECT count(*) AS prepared, count(*) FILTER (WHERE o.ms IS NULL) AS inserted, "
        "count(*) FILTER (WHERE o.ms IS NOT NULL) AS updated FROM new n LEFT JOIN old o "
        "ON o.station_id = n.station_id AND o.ms = n.ms"),
    "key_uniqueness": f"WITH {AIR}, {COPIES} {uniqueness('air')} UNION ALL {uniqueness('copies')}",
    "stream_join": with_obs(ALL_OBS),
    "stream_daily_mean": stream_means("day"),
    "stream_weekly_mean": stream_means("week"),
    "stream_upsert": f"WITH {AIR}, {COPIES} SELECT station_id, epoch_ms(timestamp) AS timestamp, "
        f"{rounded(POLLUTANTS)}, ingest_seq FROM copies QUALIFY row_number() OVER "
        "(PARTITION BY station_id, timestamp ORDER BY ingest_seq DESC) = 1",
    "stream_features": feature_sql(),
    "backfill_features": feature_sql(),
    "hourly_features": feature_sql(last_days=5),
}
ORACLES["scan_recent_stored"] = ORACLES["scan_recent"]
ORACLES["store_overview"] = with_air(
    "SELECT count(*) AS row_count, count(DISTINCT CAST(timestamp AS DATE)) AS day_count, "
    "epoch_ms(min(timestamp)) AS first, epoch_ms(max(timestamp)) AS last FROM air")
ORACLES["stream_corrected_mean"] = (
    f"WITH {AIR}, {COPIES}, kept AS (SELECT * FROM copies "
    "QUALIFY row_number() OVER (PARTITION BY station_id, timestamp ORDER BY ingest_seq DESC) = 1), "
    "means AS (SELECT station_id, CAST(timestamp AS DATE) AS period, avg(pm2_5) AS pm2_5, avg(pm10) AS pm10, "
    "avg(o3) AS o3 FROM kept GROUP BY 1, 2) SELECT station_id, period, "
    f"{rounded(['pm2_5', 'pm10', 'o3'])} FROM means WHERE period + INTERVAL 1 DAY <= "
    "(SELECT max(timestamp) FROM air) - INTERVAL 5 DAY")
ORACLES["stream_replay"] = ORACLES["stream_upsert"]
ORACLES["source_fallback"] = ORACLES["features_csv_roundtrip"]
ORACLES["models_by_target"] = constant_models_sql()
ORACLES["model_fallback"] = rule_report_sql(
    {"greatest": "max"}, f"target, model, {rounded(['rmse', 'mae'])}")
ORACLES["report_by_rule"] = rule_report_sql(
    {"mean": "avg", "greatest": "max", "least": "min"},
    f"upper(replace(target, 'aqi_target_', '')) AS horizon, model, {rounded(['rmse', 'mae', 'r2'])}, "
    f"{len(WINDOWED)} AS n_features, (SELECT count(*) FROM made) AS training_rows")
ORACLES["ridge_pair"] = pair_sql(
    f"SELECT {KEY}, {r6('y', 'label')}, {half_even('my + wa * (a - ma) + wb * (b - mb)', '1e4')} AS prediction "
    f"FROM split JOIN fit USING (target) WHERE target = '{TARGETS[0]}' AND NOT is_train")
ORACLES["importance_pair"] = pair_sql(
    ", w AS (SELECT target, 'pm10' AS feature, abs(wa) AS w FROM fit UNION ALL SELECT target, 'aqi', abs(wb) FROM fit) "
    f"SELECT target, feature, {half_even('w', '1e6')} AS importance, "
    "CAST(row_number() OVER (PARTITION BY target ORDER BY w DESC, feature) AS INTEGER) AS place FROM w")
ORACLES["forecast_pair"] = pair_sql(
    f", {LATEST}, said AS (SELECT station_id, timestamp, aqi, target, "
    "greatest(0e0, my + wa * (coalesce(pm10, 0e0) - ma) + wb * (coalesce(aqi, 0e0) - mb)) AS p FROM latest, fit), "
    "wide AS (SELECT station_id, timestamp, aqi, "
    + ", ".join(f"max(p) FILTER (WHERE target = '{t}') AS {t}" for t in TARGETS) + " FROM said GROUP BY 1, 2, 3) "
    f"SELECT {KEY}, {r6('aqi', 'aqi')}, " + ", ".join(f"{half_even(t, '1e4')} AS {t}" for t in TARGETS) + " FROM wide")
ORACLES["feature_columns"] = with_core(
    f", lagged AS (SELECT *, {plain(window_columns('lags'))} FROM core) " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS row_count FROM lagged" for c in [*CORE, *window_columns("lags")]))
ORACLES["payload_rejects"] = with_air(
    "SELECT CASE day(timestamp) % 7 WHEN 0 THEN 'malformed' WHEN 1 THEN 'no hourly data' "
    "ELSE 'accepted' END AS reason, count(DISTINCT (station_id, CAST(timestamp AS DATE))) AS documents "
    "FROM air GROUP BY 1")
