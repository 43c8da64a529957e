"""The public functions: exports in, analysed tables out.

``cache_dir`` names a folder of cached results (see ``sources.store``).
``home_zone`` is a zone's name or a function from the UTC time column to one.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import expressions as X
from waymark.functions import units, zones
from waymark.functions.expressions import eer_female, eer_male
from waymark.operators import activity, geocode, models, relational, routes, timeseries
from waymark.operators.geocode import GeocodingConfig, GeocodingProvider
from waymark.operators.routes import RouteClusterConfig
from waymark.scratch import stored
from waymark.sources import tables, tracks
from waymark.sources.store import Store

HomeZone = str | Callable[[Column], Column]


@dataclass(frozen=True)
class ActivitiesConfig:
    """``zone_file`` is a GeoJSON file of time zones; without one the table of boxes counts."""

    power_curve_max_s: int = 12 * 3600
    power_curve_density: int = 50
    ftp_window_s: float = 1200.0
    ftp_factor: float = 0.95
    weekly_anchor: str = "W-SUN"
    clustering: RouteClusterConfig | None = field(default_factory=RouteClusterConfig)
    zone_file: str | None = None


@dataclass(frozen=True)
class CommuteConfig:
    """Speeds are in km/h; ``zone_file`` is as in ``ActivitiesConfig``."""

    delta: timedelta = timedelta(minutes=90)
    inactive_speed: float = 2.5
    stopped_speed: float = 1.0
    min_stop_duration: timedelta = timedelta(seconds=10)
    morning_cutoff_hour: int = 12
    clustering: RouteClusterConfig | None = field(default_factory=RouteClusterConfig)
    span_penalty: float = 100.0
    span_min_size: int = 2
    zone_file: str | None = None


@dataclass(frozen=True)
class MndTuning:
    """Half-lives are texts such as ``3D`` or ``36h``, or times."""

    weight_halflife: str | timedelta = "3D"
    calorie_halflife: str | timedelta = "9D"
    rate_window_days: int = 28


def _days(span: str | timedelta) -> float:
    if isinstance(span, timedelta):
        return span / timedelta(days=1)
    m = re.fullmatch(r"([\d.]*)\s*([smhDW])", span)
    if not m:
        raise ValueError(f"no time span: {span}")
    return float(m[1] or 1) * units.SECONDS[m[2]] / units.SECONDS["D"]


def _home(home_zone: HomeZone, utc: Column) -> Column:
    return home_zone(utc) if callable(home_zone) else F.lit(home_zone)


def _zoned(first: DataFrame, keys: list[str], zone_file: str | None) -> DataFrame:
    """(keys, lat, lon) with ``timezone``; null without a position."""
    if zone_file is None:
        return first.withColumn("timezone", zones.zone(F.col("lat"), F.col("lon")))
    found = zones.lookup(first.withColumn("__at", F.struct(*keys)), "__at", "lat", "lon", zones.polygons(first.sparkSession, zone_file))
    return first.join(found.select("__at.*", F.col("zone").alias("timezone")), keys, "left")


def _config_key(config: object) -> str:
    """What the metrics of single files depend on."""
    return repr({k: v for k, v in asdict(config).items() if k not in ("clustering", "weekly_anchor", "span_penalty", "span_min_size")})


# Records.


_RECORDS = "filename string, segment int, seq int, ts timestamp_ntz, latitude double, longitude double, distance double, heart_rate double, power double"


def _asked(spark: SparkSession, files: DataFrame | Iterable[str], segments: Iterable[float | None] | None = None) -> DataFrame:
    """(filename, segment) of what is wanted; a segment that is NaN or missing means the whole file."""
    if not isinstance(files, DataFrame):
        number = lambda s: None if s is None or s != s else int(s)
        pairs = zip(files, segments, strict=True) if segments is not None else ((f, None) for f in files)
        files = spark.createDataFrame([(f, number(s)) for f, s in pairs], "filename string, segment int")
    segment = F.nanvl(F.col("segment").cast("double"), F.lit(None)).cast("int") if "segment" in files.columns else F.lit(None).cast("int")
    return files.where("filename is not null").select("filename", segment.alias("segment")).distinct()


def load_activity_records(spark: SparkSession, files: DataFrame | Iterable[str], segments: Iterable[float | None] | None, path: str, cache_dir: str | None = None) -> DataFrame:
    """(filename, segment, seq, ts, sensors) of the wanted files; files is a list, or a table with ``filename`` and perhaps ``segment``.

    With a cache only files that it lacks are decoded, and their records are
    added to it; without one they are decoded once and written for this
    application.  Segments are those that ``load_commute_activities`` cached:
    ValueError without a cache, FileNotFoundError for one that it lacks.
    """
    asked = _asked(spark, files, segments)
    parts = asked.where("segment is not null")
    whole = asked.where("segment is null")
    if not cache_dir:
        if parts.limit(1).count():
            raise ValueError("segments are read from a cache: cache_dir is required")
        found = tracks.records(spark, path, wanted=whole)
        return stored(found.select("filename", F.lit(None).cast("int").alias("segment"), *tracks.COLUMNS), "records")
    store = Store(spark, cache_dir)
    known = store.read("records_keys")
    lacking = asked if known is None else asked.join(known, relational.same(asked, known, ["filename", "segment"]), "left_anti")
    lost = lacking.where("segment is not null").first()
    if lost:
        raise FileNotFoundError(f"segment {lost.segment} of {lost.filename} is not in the cache")
    cold = lacking.where("segment is null")
    if cold.limit(1).count():
        rows = tracks.records(spark, path, wanted=cold)
        store.put_parts("records", rows.withColumn("segment", F.lit(None).cast("int")), cold)
    return store.read_parts("records", asked, _RECORDS).select("filename", "segment", *tracks.COLUMNS)


def load_activity_coords(spark: SparkSession, files: DataFrame | Iterable[str], segments: Iterable[float | None] | None, path: str, cache_dir: str | None = None) -> DataFrame:
    """(filename, segment, seq, latitude, longitude), trimmed to valid positions; files without one have no rows."""
    return tracks.coords(load_activity_records(spark, files, segments, path, cache_dir), ["filename", "segment"])


# Rides.


def file_metrics(rows: DataFrame, config: ActivitiesConfig, curves: DataFrame | None = None) -> DataFrame:
    """(filename, timezone, has_location, max_heart_rate, estimated_ftp) of each file."""
    t = rows.withColumn("t", X.seconds("ts"))
    first = _zoned(activity.first_position(t, ["filename"], "t", "seq"), ["filename"], config.zone_file)
    base = t.groupBy("filename").agg(F.max("heart_rate").alias("max_heart_rate"))
    curves = curves if curves is not None else power_curves_of(rows, config)
    ftp = activity.estimated_ftp(curves, ["filename"], config.ftp_window_s, config.ftp_factor).withColumnRenamed("ftp", "estimated_ftp")
    out = base.join(first, "filename", "left").join(ftp, "filename", "left")
    return out.select("filename", "timezone", F.col("lat").isNotNull().alias("has_location"), "max_heart_rate", "estimated_ftp")


def power_curves_of(rows: DataFrame, config: ActivitiesConfig) -> DataFrame:
    windows = units.power_windows(config.power_curve_max_s, config.power_curve_density)
    return activity.power_curve(rows.withColumn("t", X.seconds("ts")), ["filename"], "t", "power", windows)


def _with_metrics(spark: SparkSession, path: str, home_zone: HomeZone, cache_dir: str | None, config: ActivitiesConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    summary = tables.activities(spark, path)
    rows = load_activity_records(spark, summary.select(F.col("Filename").alias("filename")), None, path, cache_dir)
    if cache_dir:
        # The configuration is part of the key, so a change never meets stale metrics.
        store, key = Store(spark, cache_dir), _config_key(config)
        have = store.read("activities") if store.fingerprint("activities") == key else None
        cold = rows if have is None else rows.join(have.select("filename"), "filename", "left_anti")
        new = file_metrics(cold, config)
        metrics = store.write("activities", new if have is None else have.unionByName(new), key) if have is None or cold.limit(1).count() else have
    else:
        metrics = stored(file_metrics(rows, config), "metrics")
    both = summary.join(metrics.withColumnRenamed("filename", "__file"), F.col("Filename") == F.col("__file"), "left").drop("__file")
    trainer = (F.col("Activity Type") == "Virtual Ride") | (~F.coalesce("has_location", F.lit(False)) & F.col("Filename").isNotNull())
    both = both.withColumn("trainer", trainer)
    zone = F.when(F.col("trainer") | F.col("timezone").isNull(), _home(home_zone, F.col("date"))).otherwise(F.col("timezone"))
    return both.withColumn("local", X.local_time(F.col("date"), zone)), rows, metrics


def cluster_coords(activities: DataFrame, coords: DataFrame, config: RouteClusterConfig = RouteClusterConfig(), store: Store | None = None) -> DataFrame:
    """(node, cluster_id, cluster_name, positions[, addresses]).

    activities: (node, filename, name); coords: (filename, seq, latitude, longitude),
    or with segment in both.
    """
    keys = [c for c in ("filename", "segment") if c in activities.columns and c in coords.columns]
    places = coords.join(activities.select("node", *keys), relational.same(coords, activities, keys)).select("node", F.col("seq").alias("at"), "latitude", "longitude")
    gps = places.where("latitude is not null and longitude is not null").select("node").distinct().withColumn("g", F.lit(True))
    names = activities.join(gps, "node", "left").select("node", "name", F.col("filename").isNotNull().alias("has_file"), F.coalesce("g", F.lit(False)).alias("has_gps"))
    out = routes.cluster(places, names, config)
    if config.geocoding:
        out = stored(out, "clusters")
        spots = out.select(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")).union(out.select("end_lat", "end_lon"))
        found = geocode.reverse(spots, store, config.geocoding)
        for which in ("start", "end"):
            side = found.select(F.col("lat").alias(f"{which}_lat"), F.col("lon").alias(f"{which}_lon"), F.col("address").alias(f"{which}_address"))
            out = out.join(side, [f"{which}_lat", f"{which}_lon"], "left")
    return out


def cluster_routes(activities: DataFrame, segments: str | None, path: str, cache_dir: str | None = None, config: RouteClusterConfig = RouteClusterConfig()) -> DataFrame:
    """(row_id, cluster_id, cluster_name, positions[, addresses]) of (row_id, filename, description); ``segments`` names a column of segments, if any."""
    spark = activities.sparkSession
    nodes = activities.select(F.col("row_id").alias("node"), "filename", (F.col(segments) if segments else F.lit(None)).cast("int").alias("segment"), F.col("description").alias("name"))
    coords = load_activity_coords(spark, nodes, None, path, cache_dir)
    return cluster_coords(nodes, coords, config, Store(spark, cache_dir) if cache_dir else None).withColumnRenamed("node", "row_id")


def _clusters_cached(store: Store | None, table: str, rides: DataFrame, coords: DataFrame, config: RouteClusterConfig) -> DataFrame:
    make = lambda: cluster_coords(rides, coords, config, store)
    if store is None:
        return make()
    keys = ["node", "name", "filename", *(["segment"] if "segment" in rides.columns else [])]
    key = relational.fingerprint(rides, [], [F.to_json(F.struct(*keys))], repr(config)).first()
    return store.cached(f"clusters_{table}", key.fingerprint if key else "", make)


def load_strava_activities(spark: SparkSession, path: str, home_zone: HomeZone, cache_dir: str | None = None, config: ActivitiesConfig = ActivitiesConfig()) -> tuple[DataFrame, DataFrame]:
    """(activities by local date, weekly sums) of an export's rides."""
    rides, rows, _ = _with_metrics(spark, path, home_zone, cache_dir, config)
    cols = [
        "row_id", F.col("local").alias("date"), F.col("Activity Name").alias("description"), F.col("Activity Gear").alias("bicycle"), "trainer", F.coalesce("Commute", F.lit(False)).alias("commute"),
        (F.col("Distance") / units.KM_PER_MILE).alias("distance"), (F.col("Elevation Gain") / units.M_PER_FOOT).alias("elevation"), F.make_dt_interval(secs=F.col("Elapsed Time")).alias("elapsed_time"),
        F.make_dt_interval(secs=F.col("Moving Time")).alias("moving_time"), "max_heart_rate", "estimated_ftp", F.col("Filename").alias("filename"),
    ]
    out = rides.select(*cols)
    if config.clustering:
        store = Store(spark, cache_dir) if cache_dir else None
        nodes = rides.select(F.col("row_id").alias("node"), F.col("Filename").alias("filename"), F.col("Activity Name").alias("name"))
        found = _clusters_cached(store, "activities", nodes, tracks.coords(rows, ["filename"]), config.clustering)
        extra = ["cluster_id", "cluster_name", *(["start_address", "end_address"] if "start_address" in found.columns else [])]
        out = out.join(found.select(F.col("node").alias("row_id"), *extra), "row_id", "left")
    week = rides.select(F.lit(1).alias("k"), X.week_ending(F.col("local").cast("date"), config.weekly_anchor.rpartition("-")[2]).alias("week"), (F.col("Distance") / units.KM_PER_MILE).alias("distance"), (F.col("Elevation Gain") / units.M_PER_FOOT).alias("elevation"), F.col("Elapsed Time").alias("elapsed_s"), F.col("Moving Time").alias("moving_s")).where("week is not null")
    sums = week.groupBy("k", "week").agg(*[F.sum(c).alias(c) for c in ("distance", "elevation", "elapsed_s", "moving_s")])
    weekly = timeseries.calendar(week, ["k"], "week", "7 days").join(sums, ["k", "week"], "left").drop("k").fillna(0)
    weekly = weekly.select("week", "distance", "elevation", F.make_dt_interval(secs=F.col("elapsed_s")).alias("elapsed_time"), F.make_dt_interval(secs=F.col("moving_s")).alias("moving_time"))
    return out.orderBy("date", "row_id"), weekly.orderBy("week")


def load_power_curves(spark: SparkSession, path: str, home_zone: HomeZone, cache_dir: str | None = None, config: ActivitiesConfig = ActivitiesConfig()) -> DataFrame:
    """(row_id, local_date, window_s, watts) of the rides with power; the long form of the curves."""
    rides, rows, _ = _with_metrics(spark, path, home_zone, cache_dir, config)
    curves = power_curves_of(rows, config)
    return rides.select("row_id", F.col("local").alias("local_date"), F.col("Filename").alias("filename")).join(curves, "filename").select("row_id", "local_date", "window_s", "watts").orderBy("local_date", "row_id", "window_s")


def wide_power_curves(curves: DataFrame, config: ActivitiesConfig = ActivitiesConfig()) -> DataFrame:
    """(row_id, local_date, 1s, 2s, ...) from the long form: a column for each window, null where a ride is shorter."""
    windows = units.power_windows(config.power_curve_max_s, config.power_curve_density)
    wide = curves.groupBy("row_id", "local_date").pivot("window_s", windows).agg(F.first("watts"))
    return wide.select("row_id", "local_date", *[F.col(str(w)).alias(f"{w}s") for w in windows]).orderBy("local_date", "row_id")


# Commutes.


def split_commutes(rows: DataFrame, config: CommuteConfig = CommuteConfig()) -> DataFrame:
    """Records with ``segment``: long inactive stretches go, then pauses split; null where a file is one ride."""
    t = rows.withColumn("t", X.seconds("ts"))
    has = F.count("distance").over(Window.partitionBy("filename")) > 0
    flagged = activity.inactive(t.withColumn("__has", has), ["filename"], "t", "seq", "distance", config.inactive_speed / 3600, config.delta.total_seconds())
    return activity.segments(flagged.where("not (__has and inactive)").drop("__has", "inactive"), ["filename"], "t", "seq", config.delta.total_seconds())


def commute_metrics(segmented: DataFrame, config: CommuteConfig = CommuteConfig()) -> DataFrame:
    """(filename, segment, date, direction, distance, elapsed_s, moving_s); without a position the date stays UTC."""
    keyed = segmented.withColumn("seg", F.coalesce("segment", F.lit(-1)))
    m = activity.segment_metrics(keyed, ["filename", "seg"], "t", "seq", "distance", config.stopped_speed / 3600, config.min_stop_duration.total_seconds())
    start = keyed.groupBy("filename", "seg").agg(F.min("ts").alias("ts"))
    first = _zoned(activity.first_position(keyed, ["filename", "seg"], "t", "seq"), ["filename", "seg"], config.zone_file)
    out = m.join(start, ["filename", "seg"]).join(first, ["filename", "seg"], "left")
    local = F.when(F.col("timezone").isNull(), F.col("ts")).otherwise(X.local_time(F.col("ts"), F.col("timezone")))
    out = out.withColumn("date", local)
    return out.select("filename", F.when(F.col("seg") >= 0, F.col("seg")).alias("segment"), "date", X.direction(F.col("date"), config.morning_cutoff_hour).alias("direction"), "distance", "elapsed_s", "moving_s")


def _splits_cached(spark: SparkSession, cache_dir: str | None, rows: DataFrame, config: CommuteConfig) -> tuple[DataFrame, DataFrame]:
    """(records with ``segment``, metrics of all commutes); with a cache only files that it lacks are measured, and their segments are cached."""
    rows = rows.drop("segment")
    if not cache_dir:
        segmented = stored(split_commutes(rows, config), "segments")
        return segmented, stored(commute_metrics(segmented, config), "commute-metrics")
    store, key = Store(spark, cache_dir), _config_key(config)
    have = store.read("commutes") if store.fingerprint("commutes") == key else None
    cold = rows if have is None else rows.join(have.select("filename").distinct(), "filename", "left_anti")
    if have is None or cold.limit(1).count():
        segmented = stored(split_commutes(cold, config), "segments")
        new = commute_metrics(segmented, config)
        have = store.write("commutes", new if have is None else have.unionByName(new), key)
        parts = segmented.where("segment is not null")
        if parts.limit(1).count():
            store.put_parts("records", parts.select("filename", "segment", *tracks.COLUMNS), parts.select("filename", "segment").distinct())
    # Evaluated only where the clusters are not cached.
    return split_commutes(rows, config), have


def load_commute_activities(spark: SparkSession, path: str, home_zone: HomeZone, cache_dir: str | None = None, config: CommuteConfig = CommuteConfig()) -> tuple[DataFrame, DataFrame | None]:
    """(commutes by local start, spans between moves of home or work)."""
    summary = tables.activities(spark, path).where(F.coalesce("Commute", F.lit(False)))
    filed = relational.keep_first(summary.where("Filename is not null"), ["Filename"], ["row_id"])
    rows = load_activity_records(spark, filed.select(F.col("Filename").alias("filename")), None, path, cache_dir)
    segmented, metrics = _splits_cached(spark, cache_dir, rows, config)
    about = filed.select(F.col("Filename").alias("filename"), "row_id", F.col("Activity Name").alias("description"))
    of_files = metrics.join(about, "filename").select("row_id", "description", "direction", "date", (F.col("distance") / units.KM_PER_MILE).alias("distance"), "elapsed_s", "moving_s", "filename", "segment")
    bare = summary.where("Filename is null").withColumn("at", X.local_time(F.col("date"), _home(home_zone, F.col("date"))))
    bare = bare.select("row_id", F.col("Activity Name").alias("description"), X.direction(F.col("at"), config.morning_cutoff_hour).alias("direction"), F.col("at").alias("date"), (F.col("Distance") / units.KM_PER_MILE).alias("distance"), F.col("Elapsed Time").alias("elapsed_s"), F.col("Moving Time").alias("moving_s"), F.lit(None).cast("string").alias("filename"), F.lit(None).cast("int").alias("segment"))
    out = of_files.unionByName(bare)
    spans = None
    if config.clustering:
        store = Store(spark, cache_dir) if cache_dir else None
        node = F.struct("row_id", F.coalesce("segment", F.lit(-1)).alias("seg"))
        nodes = out.select(node.alias("node"), "filename", "segment", F.col("description").alias("name"))
        coords = tracks.coords(segmented.withColumn("seg", F.coalesce("segment", F.lit(-1))), ["filename", "seg"]).withColumn("segment", F.when(F.col("seg") >= 0, F.col("seg"))).drop("seg")
        found = _clusters_cached(store, "commutes", nodes, coords, config.clustering).withColumn("row_id", F.col("node.row_id")).withColumn("seg", F.col("node.seg")).drop("node")
        for c in ("start_address", "end_address"):
            if c not in found.columns:
                found = found.withColumn(c, F.lit(None).cast("string"))
        whole = stored(out.withColumn("seg", F.coalesce("segment", F.lit(-1))).join(found, ["row_id", "seg"], "left").drop("seg"), "commutes")
        spans = models.commute_spans(whole.withColumn("k", F.lit(1)), ["k"], config.span_penalty, config.span_min_size).drop("k").orderBy("start_date")
        drop = ["start_lat", "start_lon", "end_lat", "end_lon", *([] if config.clustering.geocoding else ["start_address", "end_address"])]
        out = whole.drop(*drop)
    dt = lambda c: F.make_dt_interval(secs=F.col(c).cast("decimal(18,6)"))
    out = out.withColumn("elapsed_time", dt("elapsed_s")).withColumn("moving_time", dt("moving_s")).drop("elapsed_s", "moving_s")
    return out.orderBy("date", "row_id", "segment"), spans


# Weight and calories.


def diary_tables(measures: DataFrame, food: DataFrame, exercise: DataFrame, eer: Callable[[Column, Column], Column], tuning: MndTuning = MndTuning()) -> tuple[DataFrame, DataFrame]:
    """(weight, calories) from (day, lb), (day, kcal) and (day, kcal)."""
    k, h, w = ["k"], _days(tuning.calorie_halflife), _days(tuning.weight_halflife)
    one = lambda df: df.withColumn("k", F.lit(1))
    since = lambda c="day": F.datediff(c, F.lit("1970-01-01").cast("date"))
    weight = timeseries.resample(one(measures), k, "day", "lb").withColumn("t", since())
    weight = timeseries.ewm(weight, k, "t", "lb", "smoothed", w, units.ewm_min_periods(w, 0.5))
    low = units.ewm_min_periods(h, 0.67)
    span = units.ewm_min_periods(h, 0.95)  # as many days as the calories' weights reach back
    weight = timeseries.rolling_slope(weight, k, "day", "lb", "rate", tuning.rate_window_days, max(2, tuning.rate_window_days // 2), 7.0)
    trailing = timeseries.rolling_slope(weight.drop("rate"), k, "day", "lb", "rate", span, max(2, span // 2), 7.0, center=False).select("k", "day", (F.col("rate") * units.KCAL_DAY_PER_LB_WEEK).alias("net_observed"))
    eaten = timeseries.resample(one(food), k, "day", "kcal", "sum").withColumnRenamed("kcal", "food").withColumn("t", since())
    burnt = one(exercise).groupBy("k", "day").agg(F.sum("kcal").alias("exercise"))
    c = eaten.join(burnt, ["k", "day"], "left").fillna({"exercise": 0.0})
    c = timeseries.asof(c, weight.select("k", "day", "smoothed"), k, "day", ["smoothed"])
    c = c.withColumn("baseline", eer(F.col("smoothed"), F.col("day"))).drop("smoothed").join(trailing, ["k", "day"], "left")
    c = timeseries.ewm(c, k, "t", "food", "usual", h, low)
    c = timeseries.impute(c, "food", "usual", "eaten").withColumn("net", F.col("eaten") - F.col("baseline") - F.col("exercise"))
    c = timeseries.ewm(c, k, "t", "net", "net_recorded", h, low)
    c = timeseries.ewm(c, k, "t", "eaten", "mean_eaten", h, low)
    c = timeseries.ewm(c, k, "t", "exercise", "mean_burnt", h, low)
    c = c.withColumn("accuracy", F.try_divide(F.col("mean_eaten"), F.col("baseline") + F.col("mean_burnt") + F.col("net_observed")))
    return weight.select("day", F.col("lb").alias("actual"), "smoothed", "rate").orderBy("day"), c.select(F.col("day").alias("date"), "food", "exercise", "baseline", "net_recorded", "net_observed", "accuracy").orderBy("date")


def load_mnd_data(spark: SparkSession, path: str, eer: Callable[[Column, Column], Column], cache_dir: str | None = None, tuning: MndTuning = MndTuning()) -> tuple[DataFrame, DataFrame]:
    """(weight, calories) from a folder of diary workbooks; ValueError for weights in a unit other than lbs."""
    store = Store(spark, cache_dir) if cache_dir else None
    key = None
    if store:
        files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.xlsx?$"))
        found_key = relational.fingerprint(files, [], ["path", "modificationTime"]).first()
        key = found_key.fingerprint if found_key else ""
    found: dict[str, DataFrame] = {}
    if store and store.fingerprint("sheet_Food") == key:
        found = {n: s for n in ("Measurements", "Food", "Exercise") if (s := store.read(f"sheet_{n}")) is not None}
    else:
        found = tables.sheets(spark, path)
        if store:
            found = {n: store.write(f"sheet_{n}", s, key) for n, s in found.items()}
    weights = found["Measurements"].where(F.col("Measurement") == "Body Weight")
    others = weights.select(F.lower("Unit").alias("u")).distinct().where("u <> 'lbs'").limit(5).collect()
    if others:
        raise ValueError(f"weights must be in lbs, not {', '.join(sorted(r.u for r in others))}")
    day = lambda c: tables.sheet_time(c).cast("date").alias("day")
    measures = weights.select(day("Date"), F.col("Value").try_cast("double").alias("lb"))
    food = found["Food"].select(day("Date & Time"), F.col("`Calories, cals`").try_cast("double").alias("kcal"))
    exercise = found["Exercise"].select(day("Date & Time"), F.col("Calories").try_cast("double").alias("kcal")) if "Exercise" in found else spark.createDataFrame([], "day date, kcal double")
    return diary_tables(measures, food, exercise, eer, tuning)


# Models, addresses, caches.


def piecewise_fit_fixed(df: DataFrame, keys: list[str], at: str, value: str, n_segments: int, unit: str = "D", min_segment: float = 0.0) -> DataFrame:
    return models.piecewise(df, keys, at, value, unit, n_segments=n_segments, min_length=min_segment)


def piecewise_fit_with_breaks(df: DataFrame, keys: list[str], at: str, value: str, breaks: list[float], unit: str = "D") -> DataFrame:
    return models.piecewise(df, keys, at, value, unit, breaks=breaks)


def piecewise_fit_auto(df: DataFrame, keys: list[str], at: str, value: str, unit: str = "D", max_segments: int = 6, min_segment: float = 0.0) -> DataFrame:
    return models.piecewise(df, keys, at, value, unit, max_segments=max_segments, min_length=min_segment)


def piecewise_fit_cached(df: DataFrame, keys: list[str], at: str, value: str, cache_dir: str | None = None, unit: str = "D", max_segments: int = 6, min_segment: float = 0.0, max_cached: int = 30) -> DataFrame:
    """As ``piecewise_fit_auto``; the ``max_cached`` results used last are kept.  Without a folder nothing is."""
    if cache_dir is None:
        return piecewise_fit_auto(df, keys, at, value, unit, max_segments, min_segment)
    spark, store = df.sparkSession, Store(df.sparkSession, f"{cache_dir}/fits")
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (*keys, at, value)])
    data = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), row)).alias("x")).first()
    key = "fit_" + hashlib.md5(repr((data.n, data.s, data.x, unit, max_segments, min_segment)).encode()).hexdigest()[:16]
    make = lambda: piecewise_fit_auto(df, keys, at, value, unit, max_segments, min_segment)
    out = store.read(key)
    out = store.write(key, make(), repr(time.time())) if out is None else out
    store.touch(key, repr(time.time()))
    _prune(store, max_cached)
    return out


def _prune(store: Store, keep: int) -> None:
    used = {t: float(e["fingerprint"]) for t, e in store.manifest().items()}
    old = sorted(used, key=used.get)[: max(0, len(used) - keep)]
    if old:
        store.drop(*old)


def geocode_positions(positions: DataFrame, cache_dir: str | None, config: GeocodingConfig = GeocodingConfig()) -> DataFrame:
    return geocode.reverse(positions, Store(positions.sparkSession, cache_dir) if cache_dir else None, config)


def seed_geocode_cache(addresses: DataFrame, cache_dir: str | None, config: GeocodingConfig = GeocodingConfig()) -> None:
    if cache_dir:
        geocode.seed(addresses, Store(addresses.sparkSession, cache_dir), config)


# Caches.  What is forgotten stays on disk until ``vacuum_cache``, for frames that were read before.


def _invalidate(spark: SparkSession, cache_dir: str | None, table: str, files: list[str] | None) -> None:
    if not cache_dir:
        return
    store = Store(spark, cache_dir)
    if files is None:
        store.drop(table)
    elif files:
        store.delete(table, spark.createDataFrame([(f,) for f in files], "filename string"), ["filename"])
    store.forget_fingerprints(f"clusters_{table}")


def invalidate_activities_cache(spark: SparkSession, files: list[str] | None, cache_dir: str | None) -> None:
    """Forgets the metrics of files, or of all; no files is no change of metrics."""
    _invalidate(spark, cache_dir, "activities", files)


def invalidate_commutes_cache(spark: SparkSession, files: list[str] | None, cache_dir: str | None) -> None:
    """As for activities; the segments of the files go, too."""
    _invalidate(spark, cache_dir, "commutes", files)
    if cache_dir:
        store = Store(spark, cache_dir)
        known = store.read("records_keys")
        if known is not None:
            gone = known.where("segment is not null")
            gone = gone if files is None else gone.where(F.col("filename").isin(list(files)))
            if gone.limit(1).count():
                store.delete("records_keys", gone.select("filename", "segment"), ["filename", "segment"])


def invalidate_records_cache(spark: SparkSession, files: Iterable[str] | None, segments: Iterable[float | None] | None, cache_dir: str | None) -> None:
    """Forgets the records of files, or of their segments, or of all."""
    if not cache_dir:
        return
    store = Store(spark, cache_dir)
    if files is None:
        store.drop("records_keys")
    else:
        store.delete("records_keys", _asked(spark, files, segments), ["filename", "segment"])


def invalidate_geocode_cache(spark: SparkSession, cache_dir: str | None, provider: str | None = None) -> None:
    if cache_dir:
        geocode.invalidate(Store(spark, cache_dir), provider)


def invalidate_mnd_cache(spark: SparkSession, cache_dir: str | None) -> None:
    if cache_dir:
        Store(spark, cache_dir).drop("sheet_Measurements", "sheet_Food", "sheet_Exercise")


def invalidate_piecewise_fit_cache(spark: SparkSession, cache_dir: str | None = None, max_cached: int = 0) -> None:
    """Forgets all cached fits but the ``max_cached`` used last."""
    if cache_dir:
        _prune(Store(spark, f"{cache_dir}/fits"), max_cached)


def vacuum_cache(spark: SparkSession, cache_dir: str) -> None:
    """Removes from disk what the caches no longer name; frames that read it stop working."""
    Store(spark, cache_dir).vacuum()
    Store(spark, f"{cache_dir}/fits").vacuum()


__all__ = [
    "ActivitiesConfig", "CommuteConfig", "GeocodingConfig", "GeocodingProvider", "MndTuning", "RouteClusterConfig", "cluster_routes", "eer_female", "eer_male", "geocode_positions",
    "invalidate_activities_cache", "invalidate_commutes_cache", "invalidate_geocode_cache", "invalidate_mnd_cache", "invalidate_piecewise_fit_cache", "invalidate_records_cache",
    "load_activity_coords", "load_activity_records", "load_commute_activities", "load_mnd_data", "load_power_curves", "load_strava_activities",
    "piecewise_fit_auto", "piecewise_fit_cached", "piecewise_fit_fixed", "piecewise_fit_with_breaks", "seed_geocode_cache", "vacuum_cache", "wide_power_curves",
]
