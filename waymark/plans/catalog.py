"""The catalogue of registered queries: each operator over the given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import expressions as X
from waymark.functions import units
from waymark.operators import activity, graph, models, relational, routes, timeseries
from waymark.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(c, n: int = 4):
    return F.round(c, n)


def iso(c: str):
    """A date as ISO text, which all engines print alike."""
    return F.col(c).cast("string").alias(c)


# The views that the queries share, in Spark and in SQL.


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price of each day; summed in cents, so that the order of rows leaves no trace."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return _read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg((cents / F.count("o_totalprice") / 100).alias("x"))


DAILY = "daily as (select o_orderdate::date as d, sum(round(o_totalprice * 100)::bigint)::double / count(o_totalprice) / 100 as x from orders group by 1)"
CAL = DAILY + ", cal as (select unnest(generate_series((select min(d) from daily), (select max(d) from daily), interval 1 day))::date as d)"
GRID = CAL + ", grid as (select d, x, (d - date '1992-01-01')::double as t from cal left join daily using (d))"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``daily`` on its whole calendar as series 1, t in days."""
    g = timeseries.resample(daily(spark, sf_dir).withColumn("k", F.lit(1)), ["k"], "d", "x")
    return g.withColumn("t", F.datediff("d", F.lit("1992-01-01").cast("date")))


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the records of activities, one for each user."""
    e = _read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("event_type") != "error"
    return e.select(
        F.col("user_id").alias("activity_id"), "ts", F.col("event_id").alias("seq"), X.seconds("ts").alias("t"), F.col("value").alias("power"), "event_type",
        F.sum(F.when(F.col("event_type").isin("click", "view"), F.col("value") / 100).otherwise(0.0)).over(w).alias("distance"),
        F.when(ok, 37.0 + (F.col("user_id") % 12) * 0.004 + (F.col("event_id") % 7) * 0.0002).alias("latitude"),
        F.when(ok, -122.0 + (F.col("user_id") % 5) * 0.004 + (F.col("event_id") % 11) * 0.0002).alias("longitude"),
    )


REC = """rec as (select user_id as activity_id, ts, event_id as seq, epoch_us(ts) / 1e6 as t, value as power, event_type,
  sum(case when event_type in ('click', 'view') then value / 100 else 0.0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as distance,
  case when event_type <> 'error' then 37.0::double + (user_id % 12) * 0.004::double + (event_id % 7) * 0.0002::double end as latitude,
  case when event_type <> 'error' then -122.0::double + (user_id % 5) * 0.004::double + (event_id % 11) * 0.0002::double end as longitude from events)"""


def rec1s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records a second apart; errors leave gaps."""
    s = F.row_number().over(Window.partitionBy("activity_id").orderBy("t", "seq"))
    return rec(spark, sf_dir).withColumn("s", s.cast("long")).where("event_type <> 'error'")


REC1S = REC + ", rec1s as (select * from (select *, row_number() over (partition by activity_id order by t, seq) as s from rec) where event_type <> 'error')"
HZ = REC1S + """, ends as (select activity_id, min(s) as a, max(s) as b from rec1s where power is not null group by 1),
secs as (select activity_id, unnest(generate_series(a, b)) as s from ends),
hz as (select activity_id, s, coalesce(avg(power), 0.0) as p from secs left join rec1s using (activity_id, s) group by 1, 2)"""
KEY, THRESHOLD, PAUSE = ["activity_id"], 1e-9, 36000.0
BELOW = REC + f""", v as (select *, distance - lag(distance) over w as dv, t - lag(t) over w as dt from rec window w as (partition by activity_id order by t, seq)),
below as (select *, case when dv is null or dt is null then true when dt = 0 then dv <= 0 else dv / dt < {THRESHOLD} end as below from v)"""
RUNS = BELOW + f""", n as (select *, case when below = lag(below) over (partition by activity_id order by t, seq) then 0 else 1 end as new from below),
r as (select *, sum(new) over (partition by activity_id order by t, seq rows unbounded preceding) as run from n),
runs as (select *, below and max(t) over (partition by activity_id, run) - min(t) over (partition by activity_id, run) >= {PAUSE} as inactive from r)"""
GAP = 21600.0
CUTS = REC + f""", c as (select *, case when t - lag(t) over (partition by activity_id order by t, seq) > {GAP} then 1 else 0 end as cut from rec),
sess as (select *, sum(cut) over (partition by activity_id order by t, seq rows unbounded preceding)::int as session from c)"""


# Filters, projections, scalar functions.


@query("select o_orderkey, o_totalprice * 0.3048 as price_m, o_totalprice / 1.609344 as price_mi from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def filter_types(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return o.select("o_orderkey", (F.col("o_totalprice") * units.M_PER_FOOT).alias("price_m"), (F.col("o_totalprice") / units.KM_PER_MILE).alias("price_mi"))


@query("select o_orderkey, o_orderstatus = 'F' as filled from orders where coalesce(case when o_orderpriority = '5-LOW' then null else o_orderstatus <> 'O' end, false)")
def filter_null_safe(spark, sf_dir):
    flag = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus") != "O")
    return _read(spark, sf_dir, "orders").where(F.coalesce(flag, F.lit(False))).select("o_orderkey", (F.col("o_orderstatus") == "F").alias("filled"))


@query("select event_id, date_trunc('second', ts) as ts from events")
def parse_ts(spark, sf_dir):
    text = F.date_format("ts", "MMM d, yyyy, h:mm:ss a")
    return _read(spark, sf_dir, "events").select("event_id", X.parse_activity_date(text).alias("ts"))


ZONE = "case user_id % 4 when 0 then 'America/Los_Angeles' when 1 then 'America/New_York' when 2 then 'Europe/Berlin' else 'UTC' end"


@query(f"with l as (select event_id, timezone({ZONE}, timezone('UTC', ts)) as local_ts from events) select event_id, local_ts, case when hour(local_ts) < 12 then 'Morning' else 'Afternoon' end as direction from l")
def local_time_direction(spark, sf_dir):
    local = X.local_time(F.col("ts"), F.expr(ZONE))
    return _read(spark, sf_dir, "events").select("event_id", local.alias("local_ts")).withColumn("direction", X.direction(F.col("local_ts")))


_TRAINER = "(event_type = 'view' or (event_type = 'error' and props is not null))"


@query(f"select event_id, {_TRAINER} as trainer, case when {_TRAINER} or user_id % 7 = 0 then 'Europe/Paris' else 'UTC' end as timezone_used from events")
def trainer_and_masked_zone(spark, sf_dir):
    trainer = (F.col("event_type") == "view") | ((F.col("event_type") == "error") & F.col("props").isNotNull())
    zone = F.when(F.col("user_id") % 7 != 0, F.lit("UTC"))
    return _read(spark, sf_dir, "events").select("event_id", trainer.alias("trainer"), F.when(trainer | zone.isNull(), F.lit("Europe/Paris")).otherwise(zone).alias("timezone_used"))


# Time series.


@query(f"with {GRID} select d::varchar as d, x from grid")
def resample_daily_mean(spark, sf_dir):
    return grid(spark, sf_dir).select(iso("d"), "x")


_SUM = "with e as (select user_id, ts::date as d, sum(case when event_type <> 'error' then value end) as x from events group by 1, 2), c as (select user_id, unnest(generate_series(min(d), max(d), interval 1 day))::date as d from e group by 1) select user_id, d::varchar as d, {} as x from c left join e using (user_id, d)"


def _user_days(spark, sf_dir, how):
    e = _read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("d"), F.when(F.col("event_type") != "error", F.col("value")).alias("x"))
    return timeseries.resample(e, ["user_id"], "d", "x", how).select("user_id", iso("d"), r4("x").alias("x"))


@query(_SUM.format("round(x, 4)"))
def resample_daily_sum_null(spark, sf_dir):
    return _user_days(spark, sf_dir, "sum")


@query(_SUM.format("round(coalesce(x, 0), 4)"))
def resample_daily_sum_zero(spark, sf_dir):
    return _user_days(spark, sf_dir, "sum_zero")


@query("with w as (select user_id, (date_trunc('week', ts)::date + 6)::date as week, sum(value) as x from events group by 1, 2), c as (select user_id, unnest(generate_series(min(week), max(week), interval 7 day))::date as week from w group by 1) select user_id, week::varchar as week, round(coalesce(x, 0), 4) as x from c left join w using (user_id, week)")
def weekly_sun_sum(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", X.week_ending(F.col("ts").cast("date")).alias("week"), F.col("value").alias("x"))
    return timeseries.resample(e, ["user_id"], "week", "x", "sum_zero", "7 days").select("user_id", iso("week"), r4("x").alias("x"))


EWM = GRID + """, e as (select l.d, l.t, l.x, (select count(x) from grid r where r.t <= l.t) as n,
  (select sum(r.x * pow(2, (r.t - l.t) / 3.0)) / sum(pow(2, (r.t - l.t) / 3.0)) from grid r where r.t between l.t - 181 and l.t and r.x is not null) as near from grid l),
  held as (select *, last_value(case when x is not null then near end ignore nulls) over (order by t rows unbounded preceding) as m from e),
ewm as (select d, t, x, case when n >= 4 then m end as smoothed from held)"""


def smoothed(spark, sf_dir):
    return timeseries.ewm(grid(spark, sf_dir), ["k"], "t", "x", "smoothed", 3.0, units.ewm_min_periods(3.0, 0.5))


@query(f"with {EWM} select d::varchar as d, round(smoothed, 4) as smoothed from ewm")
def ewm_halflife(spark, sf_dir):
    return smoothed(spark, sf_dir).select(iso("d"), r4("smoothed").alias("smoothed"))


@query(f"with {EWM} select d::varchar as d, coalesce(x, round(smoothed, 4)) as imputed from ewm")
def ewm_impute(spark, sf_dir):
    return timeseries.impute(smoothed(spark, sf_dir).withColumn("smoothed", r4("smoothed")), "x", "smoothed", "imputed").select(iso("d"), "imputed")


def _slope(first, last, per):
    return f"with {GRID}, p as (select d, x, row_number() over (order by d)::double as pos from grid), s as (select d, regr_slope(x, pos) over w as s, count(x) over w as n from p window w as (order by d rows between {first} preceding and {last} following)) select d::varchar as d, round(case when n >= 14 then s * {per} end, 3) as slope from s"


@query(_slope(14, 13, 7))
def rolling_slope_centered(spark, sf_dir):
    return timeseries.rolling_slope(grid(spark, sf_dir), ["k"], "d", "x", "slope", 28, 14, 7.0).select(iso("d"), r4("slope", 3).alias("slope"))


@query(_slope(27, 0, 1))
def rolling_slope_trailing(spark, sf_dir):
    return timeseries.rolling_slope(grid(spark, sf_dir), ["k"], "d", "x", "slope", 28, 14, 1.0, center=False).select(iso("d"), r4("slope", 3).alias("slope"))


@query(f"with {REC}, g as (select activity_id, t - lag(t) over (partition by activity_id order by t) as g from rec) select activity_id, round(median(g), 4) as step from g group by 1")
def grid_step(spark, sf_dir):
    return timeseries.grid_step(rec(spark, sf_dir), KEY, "t").select("activity_id", r4("step").alias("step"))


@query("with p as (select user_id, ts, case when event_id % 5 > 0 then value end as v, event_id from events where event_type = 'purchase'), l as (select user_id, event_id, ts from events where event_type = 'click') select l.user_id, l.event_id, p.v, p.event_id as from_id from l asof left join p on l.user_id = p.user_id and l.ts >= p.ts")
def asof_ffill(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("v"), F.col("event_id").alias("from_id"))
    return timeseries.asof(e.where("event_type = 'click'").select("user_id", "event_id", "ts"), right, ["user_id"], "ts", ["v", "from_id"]).select("user_id", "event_id", "v", "from_id")


_KG, _CM = units.KG_PER_LB, units.CM_PER_INCH


@query(f"with w as (select c_custkey, 120.0::double + c_custkey % 100 as lb, 60.0::double + c_custkey % 15 as height, (date '2024-01-01' - date '1980-03-01') / 365.25::double as years from customer) select c_custkey, round(753.07::double - 10.83::double * years + 14.10::double * lb * {_KG}::double + 6.50::double * height * {_CM}::double, 4) as male, round(584.90::double - 7.01::double * years + 11.71::double * lb * {_KG}::double + 5.72::double * height * {_CM}::double, 4) as female from w")
def eer(spark, sf_dir):
    lb, height = 120.0 + F.col("c_custkey") % 100, 60.0 + F.col("c_custkey") % 15
    born, day = F.lit("1980-03-01").cast("date"), F.lit("2024-01-01").cast("date")
    return _read(spark, sf_dir, "customer").select("c_custkey", r4(X.eer_male(lb, height, born, day)).alias("male"), r4(X.eer_female(lb, height, born, day)).alias("female"))


_BALANCE = """, food as (select d, t, x / 100 as food from grid), ex as (select o_orderdate::date as d, sum(o_totalprice) / 1000 as exercise from orders where o_orderstatus = 'P' group by 1),
z as (select d, t, food, coalesce(exercise, 0) as exercise, smoothed from food left join ex using (d) join (select d, smoothed from ewm) using (d)),
b as (select *, 1200 + smoothed / 1000 as baseline from z), s as (select d, regr_slope(smoothed / 1000, pos) over w * 7 as rate, count(smoothed) over w as n from (select *, row_number() over (order by d)::double as pos from b) window w as (order by d rows between 27 preceding and current row)),
o as (select d, case when n >= 14 then rate end * 500 as net_observed from s)"""


@query(f"with {EWM}{_BALANCE} select d::varchar as d, food, round(exercise, 6) as exercise, round(baseline, 4) as baseline, round(food - baseline - exercise, 4) as net_recorded, round(net_observed, 3) as net_observed, round(food / nullif(baseline + exercise + net_observed, 0), 3) as accuracy from b join o using (d)")
def net_balance_accuracy(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means on a full calendar, smoothed; energy balance and the slope that it should explain."""
    s = smoothed(spark, sf_dir)
    ex = _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg((F.sum("o_totalprice") / 1000).alias("exercise"))
    z = s.join(ex, "d", "left").fillna({"exercise": 0.0}).withColumn("food", F.col("x") / 100).withColumn("baseline", 1200 + F.col("smoothed") / 1000).withColumn("weight", F.col("smoothed") / 1000)
    z = timeseries.rolling_slope(z, ["k"], "d", "weight", "rate", 28, 14, 7.0, center=False).withColumn("net_observed", F.col("rate") * units.KCAL_DAY_PER_LB_WEEK)
    acc = F.try_divide(F.col("food"), F.col("baseline") + F.col("exercise") + F.col("net_observed"))
    return z.select(iso("d"), "food", r4("exercise", 6).alias("exercise"), r4("baseline").alias("baseline"), r4(F.col("food") - F.col("baseline") - F.col("exercise")).alias("net_recorded"), r4("net_observed", 3).alias("net_observed"), r4(acc, 3).alias("accuracy"))


# Activity records.


@query(f"with {BELOW} select activity_id, seq, below from below")
def velocity_lag(spark, sf_dir):
    return activity.below_threshold(rec(spark, sf_dir), KEY, "t", "seq", "distance", THRESHOLD).select("activity_id", "seq", "below")


def _runs(spark, sf_dir):
    return activity.inactive(rec(spark, sf_dir), KEY, "t", "seq", "distance", THRESHOLD, PAUSE)


@query(f"with {RUNS} select activity_id, seq, inactive from runs")
def inactive_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("activity_id", "seq", "inactive")


@query(f"with {RUNS} select activity_id, round(sum(case when not inactive then coalesce(dt, 0) else 0 end), 3) as moving_s from runs group by 1")
def moving_time(spark, sf_dir):
    return activity.moving_time(_runs(spark, sf_dir), KEY, "t", "seq").select("activity_id", r4("moving_s", 3).alias("moving_s"))


@query(f"with {CUTS} select activity_id, seq, session from sess")
def gap_sessions(spark, sf_dir):
    return activity.sessions(rec(spark, sf_dir), KEY, "t", "seq", GAP).select("activity_id", "seq", "session")


@query(f"with {CUTS} select activity_id, seq, (case when max(session) over (partition by activity_id) > 0 then session + 1 end)::int as segment from sess")
def segment_numbering(spark, sf_dir):
    return activity.segments(rec(spark, sf_dir), KEY, "t", "seq", GAP).select("activity_id", "seq", "segment")


@query(f"with {CUTS} select activity_id, min(ts) as start_ts, count(*) as n from sess group by activity_id, session")
def session_window_builtin(spark, sf_dir):
    w = F.session_window("ts", f"{int(GAP)} seconds")
    return rec(spark, sf_dir).groupBy("activity_id", w.alias("w")).agg(F.min("ts").alias("start_ts"), F.count(F.lit(1)).alias("n")).select("activity_id", "start_ts", "n")


_SEG = CUTS + f""", rec2 as (select * replace (case when activity_id % 7 <> 3 then distance end as distance) from sess), v as (select *, distance - lag(distance) over w as dv, t - lag(t) over w as dt from rec2 window w as (partition by activity_id, session order by t, seq)),
bl as (select *, case when dv is null or dt is null then true when dt = 0 then dv <= 0 else dv / dt < {THRESHOLD} end as below from v),
nn as (select *, case when below = lag(below) over (partition by activity_id, session order by t, seq) then 0 else 1 end as new from bl),
rr as (select *, sum(new) over (partition by activity_id, session order by t, seq rows unbounded preceding) as run from nn),
ff as (select *, below and max(t) over (partition by activity_id, session, run) - min(t) over (partition by activity_id, session, run) >= 7200 as inactive from rr)"""


@query(f"with {_SEG} select activity_id, session, round(max(t) - min(t), 3) as elapsed_s, round(max(distance) - min(distance), 4) as distance, round(case when count(distance) > 0 then sum(case when not inactive then coalesce(dt, 0) else 0 end) end, 3) as moving_s from ff group by 1, 2")
def segment_metrics(spark, sf_dir):
    s = activity.sessions(rec(spark, sf_dir), KEY, "t", "seq", GAP).withColumn("distance", F.when(F.col("activity_id") % 7 != 3, F.col("distance")))
    m = activity.segment_metrics(s, ["activity_id", "session"], "t", "seq", "distance", THRESHOLD, 7200.0)
    return m.select("activity_id", "session", r4("elapsed_s", 3).alias("elapsed_s"), r4("distance").alias("distance"), r4("moving_s", 3).alias("moving_s"))


@query(f"with {REC}, k as (select *, row_number() over (partition by activity_id order by t, seq) as k from rec), m as (select activity_id, min(k) as a, max(k) as b from k where latitude is not null group by 1) select activity_id, seq, latitude, longitude from k join m using (activity_id) where k between a and b")
def trim_valid(spark, sf_dir):
    return activity.trim_valid(rec(spark, sf_dir), KEY, "t", "seq").select("activity_id", "seq", "latitude", "longitude")


FIRST = REC + ", firstpos as (select activity_id, arg_min(latitude, (t, seq)) filter (where latitude is not null) as lat, arg_min(longitude, (t, seq)) filter (where latitude is not null) as lon, arg_max(latitude, (t, seq)) filter (where latitude is not null) as end_lat, arg_max(longitude, (t, seq)) filter (where latitude is not null) as end_lon from rec group by 1)"


@query(f"with {FIRST} select activity_id, lat, lon from firstpos")
def first_valid_position(spark, sf_dir):
    return activity.first_position(rec(spark, sf_dir), KEY, "t", "seq")


@query(f"with {HZ} select activity_id, s, round(sum(p) over (partition by activity_id order by s rows unbounded preceding), 4) as prefix from hz")
def prefix_sum(spark, sf_dir):
    h = activity.one_hertz(rec1s(spark, sf_dir), KEY, "s", "power")
    return activity.prefix_sums(h, KEY, "s", "p").select("activity_id", "s", r4("prefix").alias("prefix"))


WINDOWS = [1, 2, 5, 10, 20, 60]
CURVE = HZ + f""", pre as (select activity_id, s, sum(p) over (partition by activity_id order by s rows unbounded preceding) as c, row_number() over (partition by activity_id order by s) as k from hz),
w as (select unnest({WINDOWS}) as window_s), curve as (select r.activity_id, window_s, max((r.c - coalesce(l.c, 0)) / window_s) as watts from pre r cross join w left join pre l on l.activity_id = r.activity_id and l.k = r.k - window_s where r.k >= window_s group by 1, 2)"""


def _curves(spark, sf_dir):
    return activity.power_curve(rec1s(spark, sf_dir), KEY, "s", "power", WINDOWS)


@query(f"with {CURVE} select activity_id, window_s, round(watts, 4) as watts from curve")
def power_curve_long(spark, sf_dir):
    return _curves(spark, sf_dir).select("activity_id", "window_s", r4("watts").alias("watts"))


@query(f"with {CURVE} select activity_id, {', '.join(f'round(max(watts) filter (where window_s = {w}), 4) as w{w}' for w in WINDOWS)} from curve group by 1")
def power_curve_pivot(spark, sf_dir):
    p = _curves(spark, sf_dir).groupBy("activity_id").pivot("window_s", WINDOWS).agg(F.first("watts"))
    return p.select("activity_id", *[r4(F.col(f"`{w}`")).alias(f"w{w}") for w in WINDOWS])


@query(f"with {CURVE}, b as (select activity_id, arg_max(watts, window_s) filter (where window_s <= 30) as y0, max(window_s) filter (where window_s <= 30) as x0, arg_min(watts, window_s) filter (where window_s >= 30) as y1, min(window_s) filter (where window_s >= 30) as x1 from curve group by 1) select activity_id, round(0.95 * case when y1 is null then y0 else y0 + (y1 - y0) * (30.0 - x0) / (x1 - x0) end, 8) as ftp from b")
def ftp_interp(spark, sf_dir):
    return activity.estimated_ftp(_curves(spark, sf_dir), KEY, 30.0).select("activity_id", r4("ftp", 8).alias("ftp"))


# Geography and clusters.

HAV = "2 * {r} * asin(least(1.0, sqrt(pow(sin((radians({b}_lat) - radians({a}_lat)) / 2), 2) + cos(radians({a}_lat)) * cos(radians({b}_lat)) * pow(sin((radians({b}_lon) - radians({a}_lon)) / 2), 2))))"
EPS = 150.0
LINKS = FIRST + f", near as (select a.activity_id as a, b.activity_id as b from (select activity_id, lat as a_lat, lon as a_lon from firstpos where lat is not null) a, (select activity_id, lat as b_lat, lon as b_lon from firstpos where lat is not null) b where {HAV.format(r=6378137.0, a='a', b='b')} <= {EPS})"


def _starts(spark, sf_dir):
    return activity.first_position(rec(spark, sf_dir), KEY, "t", "seq").where("lat is not null").withColumnRenamed("activity_id", "node")


@query(f"with {LINKS} select a, b from near")
def haversine_pairs(spark, sf_dir):
    return graph.neighbours(_starts(spark, sf_dir), "node", "lat", "lon", EPS)


_COMP = ", reach(node, comp) as (select a, a from near union select near.b, comp from reach join near on near.a = reach.node)"


@query(f"with recursive {LINKS}{_COMP} select node, min(comp) as comp from reach group by 1")
def eps_components(spark, sf_dir):
    s = stored(_starts(spark, sf_dir), "starts")
    return graph.components(s.select("node"), graph.chain_links(s, "node", "lat", "lon", EPS))


_PART = FIRST + "".join(f", near_{w} as (select a.activity_id as a, b.activity_id as b from (select activity_id, {c}lat as a_lat, {c}lon as a_lon from firstpos where lat is not null) a, (select activity_id, {c}lat as b_lat, {c}lon as b_lon from firstpos where lat is not null) b where {HAV.format(r=6378137.0, a='a', b='b')} <= {EPS}), reach_{w}(node, comp) as (select a, a from near_{w} union select near_{w}.b, comp from reach_{w} join near_{w} on near_{w}.a = reach_{w}.node), label_{w} as (select node, min(comp) as {w}_label from reach_{w} group by 1)" for w, c in (("start", ""), ("end", "end_")))


@query(f"with recursive {_PART}, p as (select * from label_start join label_end using (node)) select start_label, end_label, count(*) as n from p group by 1, 2 having count(*) >= 1")
def start_end_partitions(spark, sf_dir):
    r = rec(spark, sf_dir).where("latitude is not null")
    spot = F.struct("t", "seq", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    ends = r.groupBy(F.col("activity_id").alias("node")).agg(F.min(spot).alias("s"), F.max(spot).alias("e")).select("node", F.col("s.lat").alias("start_lat"), F.col("s.lon").alias("start_lon"), F.col("e.lat").alias("end_lat"), F.col("e.lon").alias("end_lon"))
    p = routes.start_end_partitions(stored(ends, "ends"), "node", EPS)
    return p.groupBy("start_label", "end_label").agg(F.count(F.lit(1)).alias("n")).where("n >= 1")


_DB = LINKS + """, deg as (select a, count(*) as n from near group by 1), core as (select a as node from deg where n >= 3), inner_ as (select near.a, near.b from near join core x on x.node = a join core y on y.node = b),
reach(node, comp) as (select a, a from inner_ union select inner_.b, comp from reach join inner_ on inner_.a = reach.node), comp as (select node, min(comp) as comp from reach group by 1),
ids as (select comp, row_number() over (order by comp) - 1 as cluster from (select distinct comp from comp)), placed as (select node, cluster from comp join ids using (comp)),
border as (select a as node, min(cluster) as near from near join placed on placed.node = near.b group by 1)"""


@query(f"with recursive {_DB} select f.activity_id as node, coalesce(placed.cluster, border.near, -1)::int as cluster from firstpos f left join placed on placed.node = f.activity_id left join border on border.node = f.activity_id where f.lat is not null")
def dbscan_clusters(spark, sf_dir):
    s = stored(_starts(spark, sf_dir), "starts")
    return graph.dbscan(s.select("node"), graph.neighbours(s, "node", "lat", "lon", EPS), 3)


def _utm_sql(lat: str, lon: str) -> str:
    n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
    s = 0.9996 * units.EARTH_EQUATOR_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    east, north = ["eta"], ["xi"]
    for j, a in enumerate(al, 1):
        east.append(f"{a!r}::double * cos({2 * j} * xi) * sinh({2 * j} * eta)")
        north.append(f"{a!r}::double * sin({2 * j} * xi) * cosh({2 * j} * eta)")
    return f"""u as (select *, sinh(atanh(sin(radians({lat}))) - {e!r}::double * atanh({e!r}::double * sin(radians({lat})))) as tt, radians({lon} - (10 * 6 - 183)) as lam from rec where latitude is not null),
v as (select *, atan2(tt, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + tt * tt)) as eta from u),
xy as (select activity_id, t, seq, 500000 + {s!r}::double * ({' + '.join(east)}) as x, {s!r}::double * ({' + '.join(north)}) as y from v)"""


UTM = REC + ", " + _utm_sql("latitude", "longitude")


def _xy(spark, sf_dir):
    x, y = X.utm(F.col("latitude"), F.col("longitude"), F.lit(10))
    return rec(spark, sf_dir).where("latitude is not null").select("activity_id", "t", "seq", x.alias("x"), y.alias("y"))


@query(f"with {UTM} select activity_id, seq, round(x, 3) as x, round(y, 3) as y from xy")
def utm_project(spark, sf_dir):
    return _xy(spark, sf_dir).select("activity_id", "seq", r4("x", 3).alias("x"), r4("y", 3).alias("y"))


ARC = UTM + """, st as (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) as step from xy window w as (partition by activity_id order by t)),
arc as (select *, sum(step) over (partition by activity_id order by t rows unbounded preceding) as along from st)"""


@query(f"with {ARC} select activity_id, seq, round(along, 3) as along from arc")
def arc_length(spark, sf_dir):
    return routes.arc_length(_xy(spark, sf_dir), KEY, "t", "x", "y").select("activity_id", "seq", r4("along", 3).alias("along"))


@query(f"with {ARC} select activity_id, round(max(along), 3) as length_m, least(100, greatest(20, floor(max(along) / 1000)))::bigint as n from arc group by 1 having max(along) > 0")
def resample_route(spark, sf_dir):
    return routes.resample(_xy(spark, sf_dir), KEY, "t", "x", "y").select("activity_id", r4("length_m", 3).alias("length_m"), F.size("xs").cast("long").alias("n"))


#: Routes at even distances, and the discrete Frechet distance row by row of its table: a row is made from the one before, from left to right.
FRECHET = ARC + """, len as (select activity_id, max(along) as l, least(100, greatest(20, floor(max(along) / 1000)))::int as n, arg_max(x, t) as last_x, arg_max(y, t) as last_y from arc group by 1 having max(along) > 0),
o as (select activity_id, along, x, y, lead(along) over w as na, lead(x) over w as nx, lead(y) over w as ny from arc window w as (partition by activity_id order by t)),
g as (select activity_id, k, l * k / (n - 1) as pos, k = n - 1 as is_last, last_x, last_y from (select *, unnest(range(n)) as k from len)),
pt as (select g.activity_id, k, case when is_last then last_x else x + (nx - x) * (pos - along) / (na - along) end as x, case when is_last then last_y else y + (ny - y) * (pos - along) / (na - along) end as y from g left join o on o.activity_id = g.activity_id and not is_last and along <= pos and pos < na),
route as (select activity_id, activity_id % 5 as part, l, list(x order by k) as xs, list(y order by k) as ys from pt join len using (activity_id) group by all),
pair as (select p.activity_id as a, q.activity_id as b, p.l as la, q.l as lb, p.xs as px, p.ys as py, q.xs as qx, q.ys as qy from route p join route q on p.part = q.part and p.activity_id < q.activity_id where greatest(p.l, q.l) <= 1.2 * least(p.l, q.l)),
fr(a, b, i, r) as (select a, b, 0, [0.0::double] || list_transform(range(len(qx)), lambda j: 'inf'::double) from pair
  union all select pair.a, pair.b, i + 1, list_reduce(list_transform(range(1, len(qx) + 1), lambda j: [least(r[j], r[j + 1]), sqrt(pow(px[i + 1] - qx[j], 2) + pow(py[i + 1] - qy[j], 2))]), lambda acc, e: list_append(acc, greatest(e[2], least(e[1], acc[-1]))), ['inf'::double])
  from fr join pair on pair.a = fr.a and pair.b = fr.b where i < len(px))"""


@query(f"with recursive {FRECHET} select fr.a, fr.b, round(r[-1] / (50 + 0.018 * (la + lb) / 2), 4) as distance from fr join pair on pair.a = fr.a and pair.b = fr.b where i = len(px)")
def frechet_pairs(spark, sf_dir):
    r = routes.resample(_xy(spark, sf_dir), KEY, "t", "x", "y").withColumn("part", F.col("activity_id") % 5)
    return routes.frechet_pairs(r, "part", "activity_id").select("a", "b", r4("distance").alias("distance"))


@query("with c as (select user_id % 9 as part, event_type as label, value as v from events), m as (select part, mode(label order by label) as name, median(v) as centre, count(*) as n from c group by 1 having count(*) >= 2) select part, name, round(centre, 4) as centre, (row_number() over (order by n desc, part) - 1)::int as rank from m")
def cluster_rank_name(spark, sf_dir):
    c = _read(spark, sf_dir, "events").groupBy((F.col("user_id") % 9).alias("part")).agg(F.expr("mode(event_type, true)").alias("name"), F.median("value").alias("centre"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return graph.numbered(c, [F.desc("n"), F.col("part")], "rank").select("part", "name", r4("centre").alias("centre"), F.col("rank").cast("int").alias("rank"))


@query()
def route_clusters(spark, sf_dir):
    r = rec(spark, sf_dir)
    names = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.expr("mode(event_type, true)").alias("name"), F.max((F.col("event_type") != "error").cast("int")).alias("g"))
    names = names.select("node", "name", F.lit(True).alias("has_file"), (F.col("g") == 1).alias("has_gps"))
    return routes.cluster(r.select(F.col("activity_id").alias("node"), F.struct("t", "seq").alias("at"), "latitude", "longitude").withColumn("at", F.col("at.t")), names)


@query(f"with {FIRST}, pts as (select activity_id as node, lat, lon from firstpos where lat is not null), places as (select round(lat, 4) as p_lat, round(lon, 4) as p_lon, case when activity_id % 5 > 0 then activity_id end as address from firstpos where lat is not null and activity_id % 3 = 0), j as (select node, address, not (round(lat, 4) = p_lat and round(lon, 4) = p_lon) as far, {HAV.format(r=6371009.0, a='q', b='p')} as d, p_lat, p_lon from (select *, lat as q_lat, lon as q_lon from pts), places), b as (select node, address, row_number() over (partition by node order by far, d, p_lat, p_lon, address nulls first) as k from j where d <= 200 or not far) select node, b.address, b.node is not null as found from pts left join (select * from b where k = 1) b using (node)")
def radius_lookup(spark, sf_dir):
    s = _starts(spark, sf_dir)
    places = s.where("node % 3 = 0").select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.when(F.col("node") % 5 > 0, F.col("node")).alias("address"))
    return relational.nearest_within(s, "node", places, 200.0, "address")


# Keyed tables.


def _cached(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    return o.where("o_orderkey % 3 < 2").select("o_orderkey", "o_custkey", "o_totalprice"), o.where("o_orderkey % 3 = 2 or o_orderkey % 4 = 0").select("o_orderkey", "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))


_C = "old as (select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey % 3 < 2), new as (select o_orderkey, o_custkey, o_totalprice * 2 as o_totalprice from orders where o_orderkey % 3 = 2 or o_orderkey % 4 = 0)"


@query(f"with {_C} select o_orderkey, o_orderkey in (select o_orderkey from old) as hit from new")
def hit_miss_split(spark, sf_dir):
    old, new = _cached(spark, sf_dir)
    hit, miss = relational.split_hits(new, old, ["o_orderkey"])
    return hit.select("o_orderkey", F.lit(True).alias("hit")).unionByName(miss.select("o_orderkey", F.lit(False).alias("hit")))


@query(f"with {_C} select * from old where o_orderkey not in (select o_orderkey from new) union all select * from new")
def upsert(spark, sf_dir):
    return relational.upsert(*_cached(spark, sf_dir), ["o_orderkey"])


@query(f"with {_C} select * from old where o_orderkey not in (select o_orderkey from new)")
def delete_keys(spark, sf_dir):
    return relational.delete(*_cached(spark, sf_dir), ["o_orderkey"])


@query(f"with {_C} select o.o_orderkey, o.o_custkey, coalesce(n.o_totalprice, o.o_totalprice) as o_totalprice from old o left join new n using (o_orderkey)")
def update_keys(spark, sf_dir):
    return relational.update(*_cached(spark, sf_dir), ["o_orderkey"], ["o_totalprice"])


@query("select c_custkey from (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as k from customer) where k > 30")
def lru_prune(spark, sf_dir):
    return relational.least_recent(_read(spark, sf_dir, "customer"), "c_acctbal", 30, "c_custkey").select("c_custkey")


@query("select s_suppkey as id, s_name as name, s_acctbal as balance, null::varchar as segment from supplier union all select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def sheet_union(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True).select("id", "name", "balance", "segment")


_KEYS = "with k as (select distinct o_orderstatus, md5(coalesce(o_orderpriority, '') || '|' || o_orderdate::date::varchar) as k from orders)"


@query(f"{_KEYS} select o_orderstatus, md5(count(*) || ':' || sum(('0x' || substr(k, 1, 15))::bigint)::varchar || ':' || sum(('0x' || substr(k, 17, 15))::bigint)::varchar || ':v1') as fingerprint from k group by 1")
def fingerprint_md5(spark, sf_dir):
    return relational.fingerprint(_read(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderpriority", F.col("o_orderdate").cast("date")], "v1")


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) where k = 1")
def distinct_keep_first(spark, sf_dir):
    return relational.keep_first(_read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


# Models.


def _spans_sql(source: str, features: list[str], penalty: float) -> str:
    """Spans of least squared deviation plus penalty by the whole table of best ends, of a CTE with activity_id, pos and the features."""
    n = range(len(features))
    scaled = ", ".join(f"({f} - avg({f}) over w) / case when stddev_pop({f}) over w > 0 then stddev_pop({f}) over w else 1 end as z{k}" for k, f in zip(n, features))
    gone = " + ".join(f"pow(s{k}[t + 2] - s{k}[c + 1], 2)" for k in n)
    return f"""f as (select *, row_number() over (partition by activity_id order by pos) as k from {source} where {' and '.join(f'{f} is not null' for f in features)}),
z as (select activity_id, k, {scaled} from f window w as (partition by activity_id)),
ps as (select activity_id, k, {', '.join(f'sum(z{k}) over o as s{k}' for k in n)}, sum({' + '.join(f'z{k} * z{k}' for k in n)}) over o as q from z window o as (partition by activity_id order by k rows unbounded preceding)),
sums as (select activity_id, count(*)::int as n, {', '.join(f'[0.0::double] || list(s{k} order by k) as s{k}' for k in n)}, [0.0::double] || list(q order by k) as q from ps group by 1),
dp(activity_id, t, best, back) as (select activity_id, 1, [{-penalty}::double, 'inf'::double], [0, 0] from sums where n >= 4
  union all select activity_id, t + 1, list_append(best, list_min(h) + {penalty}), list_append(back, list_position(list_transform(h, lambda x: x <= list_min(h) + {models.TIE}), true)::int - 1)
  from (select dp.*, list_transform(range(t), lambda c: best[c + 1] + q[t + 2] - q[c + 1] - ({gone}) / (t + 1 - c)) as h from dp join sums using (activity_id) where t < n)),
done as (select activity_id, n, back from dp join sums using (activity_id) where t = n),
cuts(activity_id, e, b) as (select activity_id, n, back[n + 1] from done union all select cuts.activity_id, b, back[b + 1] from cuts join done using (activity_id) where b > 0),
spans as (select c.activity_id, row_number() over (partition by c.activity_id order by e)::int as span, x.pos as span_start, y.pos as span_end
  from (select * from cuts union all select activity_id, n, 0 from sums where n < 4) c join f x on x.activity_id = c.activity_id and x.k = b + 1 join f y on y.activity_id = c.activity_id and y.k = e)"""


_PELT = REC + ", src as (select activity_id, t as pos, latitude, longitude from rec), " + _spans_sql("src", ["latitude", "longitude"], 10.0)


@query(f"with recursive {_PELT} select activity_id, span, round(span_start, 3) as span_start, round(span_end, 3) as span_end from spans")
def changepoint_pelt(spark, sf_dir):
    s = models.change_spans(rec(spark, sf_dir), KEY, "t", ["latitude", "longitude"], 10.0)
    return s.select("activity_id", "span", r4("start", 3).alias("span_start"), r4("end", 3).alias("span_end"))


_COMMUTES = REC + """, src as (select activity_id, ts as pos, case when hour(ts) < 12 then latitude else latitude + 0.01::double end as home_lat, case when hour(ts) < 12 then latitude + 0.01::double else latitude end as work_lat, longitude,
  case when hour(ts) < 12 then round(latitude, 3)::varchar else round(longitude, 3)::varchar end as home, case when hour(ts) < 12 then round(longitude, 3)::varchar else round(latitude, 3)::varchar end as work from rec where latitude is not null), """
_COMMUTES += _spans_sql("src", ["home_lat", "longitude", "work_lat", "longitude"], 10.0)


@query(f"with recursive {_COMMUTES} select s.activity_id, span_start::date::varchar as start_date, span_end::date::varchar as end_date, count(*) as n_commutes, mode(home order by home) as home_address, mode(work order by work) as work_address from spans s join src on src.activity_id = s.activity_id and src.pos between span_start and span_end group by s.activity_id, span, span_start, span_end")
def commute_spans(spark, sf_dir):
    r = rec(spark, sf_dir).where("latitude is not null")
    c = r.select(
        "activity_id", F.col("ts").alias("date"), X.direction(F.col("ts")).alias("direction"), F.col("latitude").alias("start_lat"), F.col("longitude").alias("start_lon"),
        (F.col("latitude") + 0.01).alias("end_lat"), F.col("longitude").alias("end_lon"), F.round("latitude", 3).cast("string").alias("start_address"), F.round("longitude", 3).cast("string").alias("end_address"),
    )
    return models.commute_spans(c, KEY, 10.0).select("activity_id", iso("start_date"), iso("end_date"), "n_commutes", "home_address", "work_address")


#: Days at which the lines through all activities meet, from the first to the last.
DAYS = (0, 10, 30)
_LINES = REC + f""", p as (select activity_id, t / 86400 - 19723 as x, distance as y from rec),
m as (select activity_id, count(*)::double as n, sum(x) as x, sum(x * x) as xx, sum(greatest(0, x - {DAYS[1]})) as h, sum(greatest(0, x - {DAYS[1]}) * x) as xh, sum(greatest(0, x - {DAYS[1]}) ** 2) as hh, sum(y) as y, sum(x * y) as xy, sum(greatest(0, x - {DAYS[1]}) * y) as hy,
  count(distinct case when x <= {DAYS[1]} then x end) as early, count(distinct case when x > {DAYS[1]} then x end) as late from p group by 1),
d as (select *, n * (xx * hh - xh * xh) - x * (x * hh - xh * h) + h * (x * xh - xx * h) as det from m where early > 1 and late > 1),
c as (select activity_id, (y * (xx * hh - xh * xh) - x * (xy * hh - xh * hy) + h * (xy * xh - xx * hy)) / det as a, (n * (xy * hh - xh * hy) - y * (x * hh - xh * h) + h * (x * hy - xy * h)) / det as b, (n * (xx * hy - xh * xy) - x * (x * hy - xy * h) + y * (x * xh - xx * h)) / det as c from d)"""


@query(f"with {_LINES} select activity_id, unnest([0, 1, 2]) as edge, unnest([round(a + b * {DAYS[0]}, 3), round(a + b * {DAYS[1]}, 3), round(a + b * {DAYS[2]} + c * {DAYS[2] - DAYS[1]}, 3)]) as value, unnest([round(b, 3), round(b + c, 3), null]) as rate from c")
def piecewise_given_breaks(spark, sf_dir):
    """Two joined lines, with the middle break given; of activities with two times on either side of it, which the fit needs."""
    start = 1704067200.0
    r, late = rec(spark, sf_dir), F.col("t") > start + DAYS[1] * 86400
    sides = r.groupBy("activity_id").agg(F.count_distinct(F.when(late, F.col("t"))).alias("late"), F.count_distinct(F.when(~late, F.col("t"))).alias("early"))
    r = r.join(sides.where("early > 1 and late > 1"), "activity_id", "left_semi")
    p = models.piecewise(r, KEY, "t", "distance", "D", breaks=[start + d * 86400 for d in DAYS])
    edge = F.row_number().over(Window.partitionBy("activity_id").orderBy("at")) - 1
    return p.select("activity_id", edge.alias("edge"), r4("value", 3).alias("value"), r4("rate", 3).alias("rate"))


@query()
def piecewise_bic(spark, sf_dir):
    return models.piecewise(rec(spark, sf_dir), KEY, "t", "distance", "D")
