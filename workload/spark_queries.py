"""One Spark query per operator, over sensor tables read from ``events``."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.fixed_values import (
    AIR_QUALITY_FIELDS, HORIZONS, POLLUTANTS, TARGETS, WEATHER, WEATHER_FIELDS, WINDOWED)
from hazecast.functions import aqi, calendar, cleaning
from hazecast.operators import matching, windows
from hazecast.operators.tree_growth import BoostedTrees, Growth
from hazecast.plans import exploration, features, forecasting, jobs, sensor_tables, training
from hazecast.session import work_folder
from hazecast.sources import feature_csv, feature_store, history, payloads
from hazecast.streaming import joins as stream_joins
from hazecast.streaming import resample as stream_resample
from hazecast.streaming import upserts as stream_upserts

KEY = matching.KEY
# the fixture covers 30 days; the smallest block lets series span two of them
BLOCK_ROWS = 512


# --- Inputs and output form ---------------------------------------------------

def air(spark: SparkSession, folder: str) -> DataFrame:
    return sensor_tables.air_quality(spark, folder)


def wx(spark: SparkSession, folder: str) -> DataFrame:
    return sensor_tables.weather(spark, folder)


def obs(spark: SparkSession, folder: str) -> DataFrame:
    return sensor_tables.observations(spark, folder)


def core(spark: SparkSession, folder: str) -> DataFrame:
    return aqi.with_aqi(obs(spark, folder))


def shown(df: DataFrame) -> DataFrame:
    """Doubles rounded, timestamps without a zone: equal in every engine.

    Means of short decimals often tie at the sixth place, where the last bits
    would decide; rounding to nine places first takes those bits away.
    """
    def cell(field) -> str:
        name, kind = f"`{field.name}`", field.dataType.typeName()
        if kind == "double":
            return f"rint(rint({name} * 1e9D) / 1e9D * 1e6D) / 1e6D + 0D AS {name}"
        if kind == "timestamp":
            return f"CAST({name} AS TIMESTAMP_NTZ) AS {name}"
        return name
    return df.selectExpr(*[cell(f) for f in df.schema.fields])


def on(table, operator):
    """A query that shows what an operator makes of a table."""
    return lambda spark, folder: shown(operator(table(spark, folder)))


# --- Sources and sinks ----------------------------------------------------------

def parse_air_quality(spark, folder):
    path = work_folder(spark, "air-json")
    payloads.write_payloads(air(spark, folder), AIR_QUALITY_FIELDS, path)
    return shown(payloads.read_air_quality(spark, path))


def parse_weather(spark, folder):
    path = work_folder(spark, "weather-json")
    payloads.write_payloads(wx(spark, folder), WEATHER_FIELDS, path)
    return shown(payloads.read_weather(spark, path))


def scan_history(spark, folder):
    path = work_folder(spark, "raw")
    history.write_raw(obs(spark, folder), path)
    return shown(history.read_range(spark, path, "2024-01-08", "2024-01-21"))


def backfill_chunks(spark, folder):
    day = F.to_date("timestamp")
    spans = air(spark, folder).groupBy("station_id").agg(
        F.min(day).alias("start_date"), F.max(day).alias("end_date"))
    return history.chunk_ranges(spans, 7)


def backfill_union(spark, folder):
    """Weekly chunks that overlap by a day; the folder of chunk 2 is missing."""
    root = work_folder(spark, "chunks")
    day_of_month = F.dayofmonth("timestamp") - 1
    folders = []
    for chunk in range(5):
        paths = (f"{root}/air-{chunk}", f"{root}/weather-{chunk}")
        folders.append(paths)
        if chunk == 2:
            continue
        within = day_of_month.between(chunk * 7, chunk * 7 + 7)
        payloads.write_payloads(
            air(spark, folder).filter(within).withColumn("co", F.col("co") + chunk),
            AIR_QUALITY_FIELDS, paths[0])
        payloads.write_payloads(wx(spark, folder).filter(within), WEATHER_FIELDS, paths[1])
    combined, _ = history.backfill(
        spark, folders, payloads.read_air_quality, payloads.read_weather)
    return shown(combined)


def payload_rejects(spark, folder):
    """Documents of two days in seven are spoiled: one cut short, one without hours."""
    path = work_folder(spark, "spoiled")
    docs = payloads.to_payloads(air(spark, folder), AIR_QUALITY_FIELDS)
    line, kind = F.to_json(F.struct("station_id", "hourly")), F.dayofmonth(F.col("hourly.time")[0]) % 7
    docs.select(F.when(kind == 0, F.substring(line, 1, 60))
                .when(kind == 1, F.to_json(F.struct("station_id"))).otherwise(line)).write.text(path)
    return payloads.rejected(payloads.read_payloads(spark, path, AIR_QUALITY_FIELDS))


def source_fallback(spark, folder):
    """A folder that is not there, an empty store, then the table itself."""
    root = work_folder(spark, "fallback")
    return shown(history.first_available([
        lambda: spark.read.parquet(f"{root}/none"),
        lambda: feature_store.FeatureStore(spark, f"{root}/store").training_scan(),
        lambda: core(spark, folder).limit(0), lambda: core(spark, folder)]))


def features_csv_roundtrip(spark, folder):
    path = work_folder(spark, "csv")
    table = core(spark, folder)
    feature_csv.write_csv(table, path)
    return shown(feature_csv.read_csv(spark, path, feature_csv.csv_schema(table)))


def _stored(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.unix_millis("timestamp"))


def training_scan(spark, folder):
    store = feature_store.FeatureStore(spark, work_folder(spark, "store"))
    store.upsert(_stored(core(spark, folder)))
    return shown(store.training_scan())


# --- Joins, copies, cleaning ------------------------------------------------------

def air_store(spark, folder) -> feature_store.FeatureStore:
    store = feature_store.FeatureStore(spark, work_folder(spark, "air-store"))
    store.upsert(air(spark, folder).withColumn("timestamp", F.unix_millis("timestamp")))
    return store


def scan_recent_stored(spark, folder):
    """The last days out of a store; its listing knows the newest hour."""
    return shown(air_store(spark, folder).recent(5).withColumn("timestamp", F.timestamp_millis("timestamp")))


def store_overview(spark, folder):
    return air_store(spark, folder).overview()


def join_recent(spark, folder):
    return shown(matching.join_observations(
        history.recent(air(spark, folder), 5), history.recent(wx(spark, folder), 5)))


def join_match_report(spark, folder):
    return matching.match_report(air(spark, folder), wx(spark, folder))


def copies(spark, folder) -> DataFrame:
    """Every reading once, and again, changed, for two hours in three."""
    first = air(spark, folder).withColumn("ingest_seq", F.lit(1).cast("bigint"))
    again = (air(spark, folder).filter(F.hour("timestamp") % 3 != 0)
             .withColumn("pm2_5", F.col("pm2_5") + 1.0)
             .withColumn("o3", F.lit(None).cast("double"))
             .withColumn("ingest_seq", F.lit(2).cast("bigint")))
    return first.unionByName(again)


def headers(df: DataFrame) -> DataFrame:
    raw = df.select(F.col("station_id").alias("Station ID"), F.col("timestamp").alias("TIMESTAMP"),
                    F.col("wind_speed").alias("Wind Speed"), F.col("pressure").alias("Pressure"))
    return cleaning.normalize_headers(raw)


def mixed_times(df: DataFrame) -> DataFrame:
    """The time as text, in another form from station to station."""
    ts, kind = F.col("timestamp"), F.col("station_id") % 4
    millis = F.unix_millis(ts).cast("string")
    text = (F.when(kind == 0, millis)
            .when(kind == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
            .when(F.hour(ts) % 2 == 0, F.concat(millis, F.lit(".0")))
            .otherwise(F.lit("no time")))
    return df.withColumn("timestamp", text)


def thin_pollutants(df: DataFrame) -> DataFrame:
    return df.withColumn("co", F.when(F.hour("timestamp") % 2 == 1, F.col("co")))


def with_nan(df: DataFrame) -> DataFrame:
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return df.withColumns({
        "pm2_5": F.when(F.col("pm2_5") > 50, nan).otherwise(F.col("pm2_5")),
        "pm10": F.when(F.col("pm10") > 100, inf).otherwise(F.col("pm10")),
        "no2": F.when(F.col("no2") > 200, -inf).otherwise(F.col("no2"))})


def aligned(df: DataFrame) -> DataFrame:
    wanted = ["pm2_5", "aqi", "pm2_5_rolling_mean_6h", "aqi_lag_1h"]
    return cleaning.align_features(df.select(*KEY, "pm2_5", "aqi"), wanted)


# --- Index and calendar ---------------------------------------------------------

def truncation(df: DataFrame) -> DataFrame:
    return df.select(*KEY, *[aqi.truncated(p).alias(p) for p in POLLUTANTS])


def sub_indices(df: DataFrame) -> DataFrame:
    return aqi.with_sub_indices(df).select(*KEY, *[aqi.sub_name(p) for p in POLLUTANTS])


def overall(df: DataFrame) -> DataFrame:
    return aqi.with_aqi(df).select(*KEY, "aqi")


def dominant(df: DataFrame) -> DataFrame:
    both = aqi.with_sub_indices(aqi.with_aqi(df))
    return both.select(*KEY, "aqi", aqi.dominant().alias("dominant"))


def categories(df: DataFrame) -> DataFrame:
    """Categories of the whole index, and of a fractional value both ways."""
    part = F.col("pm2_5") * 2.5
    return df.select(
        *KEY, aqi.category(F.col("aqi")).alias("category"),
        aqi.category(F.col("aqi"), field="colour").alias("colour"),
        aqi.category(F.col("aqi"), field="message").alias("message"),
        aqi.category(part).alias("part_category"),
        aqi.category(part, strict=True).alias("part_category_strict"))


def only_new(df: DataFrame, make) -> DataFrame:
    made = make(df)
    return made.select(*KEY, *[c for c in made.columns if c not in df.columns])


# --- Windows ------------------------------------------------------------------------

def windowed(*groups: str):
    def query(spark, folder):
        table = core(spark, folder).select(*KEY, *WINDOWED)
        return shown(windows.with_window_features(table, list(groups), block_rows=BLOCK_ROWS))
    return query


def target_coverage(spark, folder):
    table = core(spark, folder).select(*KEY, *WINDOWED)
    made = windows.with_window_features(table, ["targets"], block_rows=BLOCK_ROWS)
    return made.groupBy("station_id").agg(
        F.count("*").alias("rows_total"), *[F.count(t).alias(f"{t}_valid") for t in TARGETS])


def feature_build(spark, folder):
    return shown(features.build_features(obs(spark, folder), block_rows=BLOCK_ROWS))


def feature_build_time(spark, folder):
    return shown(features.build_features(obs(spark, folder), frame="time", block_rows=BLOCK_ROWS))


def backfill_features(spark, folder):
    """Payload files of two chunks through to the feature store."""
    root = work_folder(spark, "backfill")
    folders = []
    for chunk, half in enumerate(("day(timestamp) <= 15", "day(timestamp) > 15")):
        folders.append((f"{root}/air-{chunk}", f"{root}/weather-{chunk}"))
        payloads.write_payloads(air(spark, folder).filter(half), AIR_QUALITY_FIELDS, folders[-1][0])
        payloads.write_payloads(wx(spark, folder).filter(half), WEATHER_FIELDS, folders[-1][1])
    jobs.backfill(spark, folders, f"{root}/raw", f"{root}/store", block_rows=BLOCK_ROWS)
    store = feature_store.FeatureStore(spark, f"{root}/store")
    return shown(store.training_scan().select(*features.column_order()))


def hourly_features(spark, folder):
    """The last five days on their own, as an hourly run without context."""
    root = work_folder(spark, "hourly")
    jobs.hourly(air(spark, folder), wx(spark, folder), f"{root}/raw", f"{root}/store",
                sequence=1, with_context=False, block_rows=BLOCK_ROWS)
    store = feature_store.FeatureStore(spark, f"{root}/store")
    return shown(store.read().select(*features.column_order()))


# --- Training and forecasting ---------------------------------------------------------

def feature_table(spark, folder) -> DataFrame:
    """The feature table, written once and read back with its timestamps."""
    path = work_folder(spark, "features")
    features.build_features(obs(spark, folder), epoch=False, block_rows=BLOCK_ROWS) \
        .write.parquet(path)
    return spark.read.parquet(path)


def with_targets(spark, folder) -> DataFrame:
    table = core(spark, folder).select(*KEY, *WINDOWED)
    return windows.with_window_features(table, ["targets"], block_rows=BLOCK_ROWS)


def training_rows(spark, folder):
    return shown(training.training_rows(with_targets(spark, folder), "aqi_target_24h"))


def time_split(spark, folder):
    return shown(training.with_split(core(spark, folder).select(*KEY, "aqi")))


def impute_zero(spark, folder):
    return shown(cleaning.impute_zero(with_nan(core(spark, folder)), [*POLLUTANTS, *WEATHER, "aqi"]))


def regression_metrics(spark, folder):
    """Persistence forecast: the index now against the index later."""
    made = with_targets(spark, folder).select("aqi", F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).alias("label")) for t in TARGETS])))
    return shown(training.regression_metrics(made, "label", "aqi", ["target"]))


def fitted(estimator):
    def query(spark, folder):
        _, scored = training.fit_one(feature_table(spark, folder), "aqi_target_24h", estimator)
        return scored.select(*KEY, "label", "prediction")
    return query


def gbt_stump(spark, folder):
    """One round of one cut over features of few values: what an exhaustive search finds."""
    table = calendar.with_calendar_features(calendar.with_time_features(with_targets(spark, folder))).select(
        *KEY, "hour", "day_of_week", "is_weekend", "day_segment", *TARGETS)
    _, scored = training.fit_one(table, "aqi_target_24h", lambda train: BoostedTrees(
        1, 0.3, Growth(1, alpha=0.1, lam=1.0, child_weight=3.0), rows=1.0, features=1.0))
    return shown(scored.select(*KEY, "label", "prediction"))


def trained(spark, folder) -> training.Trained:
    return training.train(feature_table(spark, folder))


def model_selection(spark, folder):
    return training.select_models(trained(spark, folder).metrics)


def feature_importance(spark, folder):
    return trained(spark, folder).importance


def model_report(spark, folder):
    path = work_folder(spark, "models")
    training.save(trained(spark, folder), path)
    _, _, metrics = training.load(spark, path)
    return training.report(metrics)


def always(aggregate):
    """A candidate that says the same for every row: one number of the training labels."""
    def estimator(train):
        value = train.agg(aggregate("label")).first()[0]
        return Pipeline(stages=[SQLTransformer(
            statement=f"SELECT *, {value!r}D AS prediction FROM __THIS__")])
    return estimator


def models_by_target(spark, folder):
    """All targets in one run, one of them again in a later run; what is loaded is listed."""
    path = work_folder(spark, "models")
    with_targets(spark, folder).write.parquet(f"{path}-table")
    table = spark.read.parquet(f"{path}-table")
    rules = {"mean": always(F.avg), "greatest": always(F.max), "least": always(F.min)}
    training.save(training.train(table, candidates=rules, minimum=1), path)
    training.save(training.train(table, [TARGETS[0]], {"greatest": rules["greatest"]}, minimum=1), path)
    models, _, metrics = training.load(spark, path)
    return shown(metrics.filter(F.col("target").isin(list(models))).select(
        "target", "model", "rmse", "mae", "training_rows"))


def model_fallback(spark, folder):
    """The preferred folder lacks a model's files, so all models come from the next one."""
    path = work_folder(spark, "models")
    with_targets(spark, folder).write.parquet(f"{path}-table")
    table = spark.read.parquet(f"{path}-table")
    training.save(training.train(table, candidates={"greatest": always(F.max)}, minimum=1), f"{path}/next")
    lost = training.train(table, candidates={"least": always(F.min)}, minimum=1)
    listed = training.select_models(lost.metrics).withColumn("run", F.lit("lost"))
    listed.write.parquet(f"{path}/preferred/model_metrics")
    _, models, _, metrics = training.load_first(spark, [f"{path}/none", f"{path}/preferred", f"{path}/next"])
    return shown(metrics.filter(F.col("target").isin(list(models))).select("target", "model", "rmse", "mae"))


def report_by_rule(spark, folder):
    """The report of a saved run whose candidates say one number of the training labels."""
    path = work_folder(spark, "models")
    with_targets(spark, folder).write.parquet(f"{path}-table")
    rules = {"mean": always(F.avg), "greatest": always(F.max), "least": always(F.min)}
    training.save(training.train(spark.read.parquet(f"{path}-table"), candidates=rules, minimum=1), path)
    return shown(training.report(training.load(spark, path)[2]))


def pair_table(spark, folder) -> DataFrame:
    """Two features and the targets: few enough that ridge has a closed form in SQL."""
    path = work_folder(spark, "pair")
    with_targets(spark, folder).drop("pm2_5").write.parquet(path)
    return spark.read.parquet(path)


def pair_run(table: DataFrame) -> training.Trained:
    return training.train(table, candidates={"ridge_regression": training.ridge}, minimum=1)


def to_places(df: DataFrame, names: list[str], digits: int) -> DataFrame:
    """Fitted values end in noise, which fewer places leave out."""
    scale = F.lit(10.0 ** digits)
    return df.withColumns({c: F.rint(F.col(c) * scale) / scale for c in names})


def ridge_pair(spark, folder):
    """Ridge over two features, scored on the rows it has not seen."""
    _, scored = training.fit_one(pair_table(spark, folder), TARGETS[0], training.ridge, minimum=1)
    return shown(to_places(scored.select(*KEY, "label", "prediction"), ["prediction"], 4))


def importance_pair(spark, folder):
    """Features ranked per target by the coefficients of ridge over two features."""
    ranked = training.top_features(pair_run(pair_table(spark, folder)).importance)
    return shown(to_places(ranked, ["importance"], 6))


def forecast_pair(spark, folder):
    """Forecasts of every target from ridge over two features."""
    table = pair_table(spark, folder)
    run = pair_run(table)
    made = forecasting.forecast(table, run.models, {t: run.feature_names for t in run.models})
    return shown(to_places(made, TARGETS, 4))


def feature_columns(spark, folder):
    """Names that count as features and how many rows have each; keys, dates and targets do not."""
    table = windows.with_window_features(core(spark, folder), ["targets", "lags"], block_rows=BLOCK_ROWS)
    names = features.feature_columns(table.withColumn("date", F.to_date("timestamp")))
    counts = table.agg(*[F.count(f"`{c}`").alias(c) for c in names])
    return counts.unpivot([], names, "feature", "row_count")


def forecast(spark, folder):
    table = feature_table(spark, folder)
    run = training.train(table, candidates={"ridge_regression": training.ridge})
    return forecasting.forecast(table, run.models, {t: run.feature_names for t in run.models})


def top_features(spark, folder):
    """Raw columns ranked per target by the size of their correlation."""
    columns = [*POLLUTANTS, *WEATHER]
    made = windows.with_window_features(core(spark, folder), ["targets"], block_rows=BLOCK_ROWS)
    pairs = exploration.correlations(made, [*columns, *TARGETS])
    table = pairs.filter(F.col("variable").isin(TARGETS) & F.col("other").isin(columns)).select(
        F.col("variable").alias("target"), F.col("other").alias("feature"),
        F.abs("r").alias("importance"))
    return shown(training.top_features(table))


def persisted(spark, folder) -> DataFrame:
    return forecasting.persistence(matching.latest_per_station(core(spark, folder)))


def forecast_series(spark, folder):
    return shown(forecasting.forecast_series(persisted(spark, folder), core(spark, folder)))


def scaled_forecasts(df: DataFrame) -> DataFrame:
    """Persistence forecasts stretched by horizon, so that alerts occur."""
    latest = matching.latest_per_station(df)
    return latest.select("station_id", *[
        (F.col("aqi") * (1.0 + h / 48.0)).alias(f"aqi_target_{h}h") for h in HORIZONS])


# --- Store --------------------------------------------------------------------------

def dirty(spark, folder) -> DataFrame:
    """Copies, an odd header, times as text and rows without a pollutant."""
    odd = mixed_times(copies(spark, folder).withColumn("co", F.when(
        F.hour("timestamp") % 2 == 1, F.col("co"))))
    return odd.withColumnRenamed("pm2_5", "PM2 5")


def sanitize_features(spark, folder):
    return shown(feature_store.sanitize(dirty(spark, folder)))


def store_batches(spark, folder) -> tuple[DataFrame, DataFrame]:
    """What is stored first, and a later batch that changes and extends it."""
    day = F.dayofmonth("timestamp")
    table = _stored(core(spark, folder).withColumn("_day", day))
    old = table.filter(F.col("_day") <= 20).drop("_day")
    new = table.filter(F.col("_day") > 15).drop("_day").withColumns({
        "pm2_5": F.when(F.col("station_id") % 2 == 0, F.col("pm2_5") + 1.0),
        "co": F.col("co") + 5.0})
    return old, new


def upsert_into(keep_known: bool):
    def query(spark, folder):
        old, new = store_batches(spark, folder)
        store = feature_store.FeatureStore(spark, work_folder(spark, "store"))
        store.upsert(old)
        store.upsert(new, keep_known)
        return shown(store.read())
    return query


def upsert_report(spark, folder):
    return feature_store.report(*store_batches(spark, folder))


def key_uniqueness(spark, folder):
    once = feature_store.key_uniqueness(air(spark, folder)).select(F.lit("air").alias("name"), "*")
    twice = feature_store.key_uniqueness(copies(spark, folder)).select(
        F.lit("copies").alias("name"), "*")
    return once.unionByName(twice)


# --- Streams, run to the end of what is there ------------------------------------------

def stream_join(spark, folder):
    root = work_folder(spark, "stream-join")
    air(spark, folder).write.parquet(f"{root}/air")
    wx(spark, folder).write.parquet(f"{root}/weather")
    return shown(stream_joins.run_join(spark, f"{root}/air", f"{root}/weather",
                                       f"{root}/out", f"{root}/progress"))


def stream_means(period: str):
    def query(spark, folder):
        root = work_folder(spark, "stream-means")
        core(spark, folder).select(*KEY, *WINDOWED).write.parquet(f"{root}/in")
        return shown(stream_resample.run_means(
            spark, f"{root}/in", WINDOWED, period, f"{root}/out", f"{root}/progress"))
    return query


def stream_corrected_mean(spark, folder):
    """Daily means of a stream that holds each reading and, for many, its correction."""
    root = work_folder(spark, "stream-corrected")
    copies(spark, folder).select(*KEY, "ingest_seq", "pm2_5", "pm10", "o3").write.parquet(f"{root}/in")
    return shown(stream_resample.run_means(
        spark, f"{root}/in", ["pm2_5", "pm10", "o3"], "day", f"{root}/out", f"{root}/progress", order="ingest_seq"))


def stream_upsert(spark, folder):
    root = work_folder(spark, "stream-upsert")
    copies(spark, folder).write.parquet(f"{root}/in")
    return shown(stream_upserts.run_upserts(
        spark, f"{root}/in", f"{root}/store", f"{root}/progress"))


def stream_replay(spark, folder):
    """The same files once more, as after a lost progress log: nothing changes."""
    root = work_folder(spark, "stream-replay")
    copies(spark, folder).write.parquet(f"{root}/in")
    for run in (1, 2):
        made = stream_upserts.run_upserts(spark, f"{root}/in", f"{root}/store", f"{root}/progress-{run}")
    return shown(made)


def stream_features(spark, folder):
    """Observations arrive in two drops; features equal one whole build."""
    root = work_folder(spark, "stream-features")
    day = F.dayofmonth("timestamp")
    table = obs(spark, folder).persist()
    try:
        for low, high in ((1, 17), (18, 31)):
            table.filter(day.between(low, high)).withColumn("ingest_seq", F.lit(low).cast("bigint")) \
                .write.mode("append").parquet(f"{root}/in")
            made = stream_upserts.run_features(
                spark, f"{root}/in", f"{root}/raw", f"{root}/store", f"{root}/progress",
                block_rows=BLOCK_ROWS)
    finally:
        table.unpersist()
    return shown(made.select(*features.column_order()))


QUERIES = {
    "parse_air_quality": parse_air_quality,
    "parse_weather": parse_weather,
    "scan_history": scan_history,
    "scan_recent": on(air, lambda d: history.recent(d, 5)),
    "scan_recent_stored": scan_recent_stored,
    "store_overview": store_overview,
    "backfill_chunks": backfill_chunks,
    "backfill_union": backfill_union,
    "features_csv_roundtrip": features_csv_roundtrip,
    "training_scan": training_scan,
    "join_aq_weather": on(obs, lambda d: d),
    "join_recent": join_recent,
    "join_match_report": join_match_report,
    "dedup_keep_first": on(copies, matching.keep_first),
    "dedup_keep_last": on(copies, matching.keep_last),
    "normalize_headers": on(wx, headers),
    "normalize_timestamp": on(air, lambda d: cleaning.normalize_timestamp(mixed_times(d))),
    "drop_all_null_pollutants": on(
        air, lambda d: cleaning.drop_all_null_pollutants(thin_pollutants(d))),
    "normalize_nan": on(air, lambda d: cleaning.normalize_nan(with_nan(d))),
    "align_features": on(core, aligned),
    "latest_observation": on(obs, matching.latest_per_station),
    "aqi_truncation": on(air, truncation),
    "aqi_sub_indices": on(air, sub_indices),
    "aqi_sub_indices_long": on(air, lambda d: aqi.sub_indices_long(d, KEY)),
    "aqi_overall": on(air, overall),
    "aqi_dominant": on(air, dominant),
    "aqi_category": on(core, categories),
    "pollutant_breakdown": on(obs, forecasting.pollutant_breakdown),
    "time_features": on(obs, lambda d: only_new(d, calendar.with_time_features).select(
        *KEY, "hour", "day_of_week", "month", "is_weekend")),
    "cyclic_features": on(obs, lambda d: only_new(d, calendar.with_time_features).select(
        *KEY, "hour_sin", "hour_cos", "month_sin", "month_cos")),
    "day_segment": on(obs, lambda d: calendar.with_calendar_features(d).select(
        *KEY, "day_segment")),
    "calendar_cyclic": on(obs, lambda d: only_new(d, calendar.with_calendar_features)
                          .drop("day_segment")),
    "interactions": on(obs, lambda d: only_new(d, calendar.with_interactions)),
    "rolling_mean": windowed("rolling_mean"),
    "rolling_std": windowed("rolling_std"),
    "rolling_minmax": windowed("rolling_minmax"),
    "ewma": windowed("ewma"),
    "lags": windowed("lags"),
    "change_rate": windowed("change_rate"),
    "targets": windowed("targets"),
    "target_coverage": target_coverage,
    "feature_build": feature_build,
    "feature_build_time": feature_build_time,
    "backfill_features": backfill_features,
    "hourly_features": hourly_features,
    "eda_overview": on(core, exploration.overview),
    "eda_missing": on(core, exploration.missing),
    "eda_describe": on(core, exploration.describe),
    "eda_histogram": on(core, exploration.histogram),
    "eda_corr_matrix": on(core, exploration.correlations),
    "eda_top_corr": on(core, exploration.top_correlations),
    "eda_series_raw": on(core, lambda d: exploration.raw_series(d, ["pm2_5", "pm10", "aqi"])),
    "resample_daily": on(core, lambda d: exploration.resample_mean(d, exploration.CORE, "day")),
    "resample_weekly": on(core, lambda d: exploration.resample_mean(d, exploration.CORE, "week")),
    "resample_monthly": on(core, lambda d: exploration.resample_mean(d, exploration.CORE, "month")),
    "category_distribution": on(core, exploration.category_distribution),
    "seasonal_hour": on(core, exploration.seasonal_hour),
    "seasonal_month": on(core, exploration.seasonal_month),
    "seasonal_dow": on(core, exploration.seasonal_dow),
    "pollutant_daily": on(core, exploration.pollutant_daily),
    "pollutant_box": on(core, exploration.box_statistics),
    "outlier_summary": on(core, exploration.outlier_summary),
    "outlier_rows": on(core, lambda d: exploration.outlier_rows(d, "pm2_5")),
    "training_rows": training_rows,
    "time_split": time_split,
    "impute_zero": impute_zero,
    "ridge_fit": fitted(training.ridge),
    "forest_fit": fitted(training.random_forest),
    "gbt_fit": fitted(training.boosted_trees),
    "gbt_stump": gbt_stump,
    "regression_metrics": regression_metrics,
    "model_selection": model_selection,
    "feature_importance": feature_importance,
    "top_features": top_features,
    "model_report": model_report,
    "forecast": forecast,
    "forecast_series": forecast_series,
    "forecast_alerts": on(core, lambda d: forecasting.alerts(scaled_forecasts(d))),
    "forecast_cards": on(core, lambda d: forecasting.forecast_cards(scaled_forecasts(d))),
    "current_conditions": on(obs, forecasting.current_conditions),
    "sanitize_features": sanitize_features,
    "upsert_features": upsert_into(keep_known=False),
    "upsert_coalesce": upsert_into(keep_known=True),
    "upsert_report": upsert_report,
    "key_uniqueness": key_uniqueness,
    "stream_join": stream_join,
    "stream_daily_mean": stream_means("day"),
    "stream_weekly_mean": stream_means("week"),
    "stream_corrected_mean": stream_corrected_mean,
    "stream_upsert": stream_upsert,
    "stream_features": stream_features,
    "stream_replay": stream_replay,
    "payload_rejects": payload_rejects,
    "source_fallback": source_fallback,
    "models_by_target": models_by_target,
    "model_fallback": model_fallback,
    "report_by_rule": report_by_rule,
    "ridge_pair": ridge_pair,
    "importance_pair": importance_pair,
    "forecast_pair": forecast_pair,
    "feature_columns": feature_columns,
}
