"""Queries of the time-series operators over the star-schema tables, with DuckDB SQL of the same rows.

Floats are rounded to six digits on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import indicators as I
from ..functions import metrics as M
from ..operators import detectors as D
from ..operators import features as T
from ..operators import forecast as P
from ..operators import kernels as K
from ..operators import meta as A
from ..operators import residuals as E
from ..operators import search as G
from ..operators import simulate as Z
from ..operators import series as S
from ..sources import tables as R
from ..streaming import incremental as L
from .pipeline import Pipeline
from ..sources.tables import daily_events, daily_orders, hourly_events, monthly_lineitem, naive_forecasts, two_sample

ID, TS, VALUE = S.ID, S.TS, S.VALUE

#: DuckDB's form of the readers in sources.tables.
BASE = {
    "H": "SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS value FROM events GROUP BY ALL",
    "D": "SELECT event_type AS series_id, date_trunc('day', ts) AS ts, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL",
    "O": "SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS value FROM orders GROUP BY ALL",
    "M": "SELECT l_returnflag AS series_id, date_trunc('month', l_shipdate) AS ts, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL",
}
BASE["F"] = f"SELECT * FROM (SELECT series_id, ts, value AS y, f AS fcst, f * 0.8 AS fcst_lower, f * 1.2 AS fcst_upper FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS f FROM ({BASE['O']}))) WHERE fcst IS NOT NULL"
BASE["AB"] = """SELECT 'A/R' AS series_id, ts, sa / na AS value_a, (qa - sa * sa / na) / (na - 1) AS variance_a, na AS sample_count_a, sb / nb AS value_b, (qb - sb * sb / nb) / (nb - 1) AS variance_b, nb AS sample_count_b, 0.0 AS effect_size FROM (
  SELECT date_trunc('month', l_shipdate) AS ts, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb,
    CAST(sum(q) FILTER (l_returnflag = 'A') AS DOUBLE) AS sa, CAST(sum(q) FILTER (l_returnflag = 'R') AS DOUBLE) AS sb,
    CAST(sum(q * q) FILTER (l_returnflag = 'A') AS DOUBLE) AS qa, CAST(sum(q * q) FILTER (l_returnflag = 'R') AS DOUBLE) AS qb
  FROM (SELECT l_shipdate, l_returnflag, CAST(l_quantity AS DECIMAL(9,2)) AS q FROM lineitem WHERE l_returnflag IN ('A', 'R')) GROUP BY 1) WHERE na > 1 AND nb > 1"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Floats at six digits; -0.0 as 0.0."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); {H} and the like in sql stand for the base series."""

    def put(f):
        QUERIES[name] = lambda spark, sf: rounded(f(spark, sf))
        if sql:
            for k, v in BASE.items():
                sql_ = SQL.get(name, sql).replace("{" + k + "}", f"({v})")
                SQL[name] = sql_
        return f

    return put


W = "(PARTITION BY series_id ORDER BY ts)"


def anomalies(spark, sf: str) -> DataFrame:
    """Hourly means on a full grid, linearly filled, and points three deviations from the 24 before them."""
    full = S.interpolate(hourly_events(spark, sf), "1 hour")
    scored = full.select(ID, TS, VALUE, I.rolling_scores(F.col(VALUE), 24)["z_score"].alias("z_score"))
    return scored.where(F.abs("z_score") > 3)


FILLED = """(SELECT g.series_id, g.ts, CASE WHEN pt = nt OR nt IS NULL THEN pv ELSE pv + (nv - pv) * (epoch_us(g.ts) - epoch_us(pt)) / CAST(epoch_us(nt) - epoch_us(pt) AS DOUBLE) END AS value FROM (
  SELECT k.series_id, k.ts, last_value(CASE WHEN s.value IS NOT NULL THEN s.ts END IGNORE NULLS) OVER b AS pt, last_value(s.value IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN s.value IS NOT NULL THEN s.ts END IGNORE NULLS) OVER a AS nt, first_value(s.value IGNORE NULLS) OVER a AS nv
  FROM (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (SELECT series_id, min(ts) AS a, max(ts) AS b FROM {H} GROUP BY 1)) k LEFT JOIN {H} s ON s.series_id = k.series_id AND s.ts = k.ts
  WINDOW b AS (PARTITION BY k.series_id ORDER BY k.ts ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY k.series_id ORDER BY k.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) g)"""

query(
    "hourly_anomalies",
    f"""SELECT series_id, ts, round(value, 6) AS value, round(z, 6) AS z_score FROM (
  SELECT series_id, ts, value, CASE WHEN n >= 24 THEN CASE WHEN sd = 0 THEN 0 ELSE (value - m) / sd END END AS z FROM (
    SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM {FILLED} WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)))
WHERE abs(z) > 3""",
)(anomalies)

query("interpolate_linear", f"SELECT series_id, ts, round(value, 6) AS value FROM {FILLED}")(lambda s, d: S.interpolate(hourly_events(s, d), "1 hour"))
query("interpolate_ffill", "SELECT series_id, ts, round(value, 6) AS value FROM (SELECT k.series_id, k.ts, last_value(s.value IGNORE NULLS) OVER (PARTITION BY k.series_id ORDER BY k.ts ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (SELECT series_id, min(ts) AS a, max(ts) AS b FROM {H} GROUP BY 1)) k LEFT JOIN {H} s ON s.series_id = k.series_id AND s.ts = k.ts)")(
    lambda s, d: S.interpolate(hourly_events(s, d), "1 hour", "ffill")
)
query("interpolate_bfill", "SELECT series_id, ts, round(value, 6) AS value FROM (SELECT k.series_id, k.ts, first_value(s.value IGNORE NULLS) OVER (PARTITION BY k.series_id ORDER BY k.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (SELECT series_id, min(ts) AS a, max(ts) AS b FROM {H} GROUP BY 1)) k LEFT JOIN {H} s ON s.series_id = k.series_id AND s.ts = k.ts)")(
    lambda s, d: S.interpolate(hourly_events(s, d), "1 hour", "bfill")
)
query("series_from_frame", "SELECT o_orderpriority || '/' || c AS series_id, o_orderdate AS ts, v AS value FROM (SELECT o_orderpriority, o_orderdate, unnest(['o_totalprice', 'o_custkey']) AS c, unnest([o_totalprice, CAST(o_custkey AS DOUBLE)]) AS v FROM orders)")(
    lambda s, d: S.from_frame(s.read.parquet(f"{d}/orders.parquet"), "o_orderdate", ["o_totalprice", "o_custkey"], "o_orderpriority")
)
query("drop_duplicate_time", "SELECT series_id, ts, value FROM (SELECT o_orderpriority AS series_id, o_orderdate AS ts, round(o_totalprice, 6) AS value, row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey, o_totalprice) AS n FROM orders) WHERE n = 1")(
    lambda s, d: S.from_frame(s.read.parquet(f"{d}/orders.parquet"), "o_orderdate", ["o_totalprice"], "o_orderpriority", drop_duplicate_time=True, order="o_orderkey")
)
query("unix_time", "SELECT c_mktsegment AS series_id, make_timestamp(c_custkey * 1000000) AS ts, round(c_acctbal, 6) AS value FROM customer")(
    lambda s, d: S.from_frame(s.read.parquet(f"{d}/customer.parquet"), "c_custkey", ["c_acctbal"], "c_mktsegment", unix_unit="s")
)
query("slice_rows", f"SELECT series_id, ts, round(value, 6) AS value FROM (SELECT *, row_number() OVER {W} - 1 AS n, count(*) OVER (PARTITION BY series_id) AS k FROM {{D}}) WHERE n >= 3 AND n < k - 2")(lambda s, d: S.slice_rows(daily_events(s, d), 3, -2))
query("exclude_range", "SELECT series_id, ts, round(value, 6) AS value FROM {D} WHERE NOT ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")(lambda s, d: S.exclude(daily_events(s, d), "2024-01-05", "2024-01-10"))
query("extend_series", "SELECT series_id, ts, round(value, 6) AS value FROM (SELECT * FROM {D} UNION ALL SELECT * FROM {M})")(lambda s, d: S.extend(daily_events(s, d), monthly_lineitem(s, d)))


def _halves(s, d):
    h = daily_events(s, d)
    return h.where("ts < '2024-01-20'"), h.where("ts >= '2024-01-10'")


for op, sign in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    query(f"combine_{op}", f"SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.ts, b.ts) AS ts, round(a.value {sign} b.value, 6) AS value FROM (SELECT * FROM {{D}} WHERE ts < TIMESTAMP '2024-01-20') a FULL JOIN (SELECT * FROM {{D}} WHERE ts >= TIMESTAMP '2024-01-10') b ON a.series_id = b.series_id AND a.ts = b.ts")(
        lambda s, d, op=op: S.combine(*_halves(s, d), op)
    )
query("compare_series", "SELECT series_id, count(*) AS differing FROM {D} WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")(lambda s, d: S.same(_halves(s, d)[0], daily_events(s, d)))
query("series_summary", "SELECT series_id, count(*) AS n, count(*) - count(value) AS n_missing, round(min(value), 6) AS min, round(max(value), 6) AS max, min(ts) AS first_ts, max(ts) AS last_ts FROM {O} GROUP BY 1")(lambda s, d: S.summary(daily_orders(s, d)))
query("infer_frequency", f"SELECT series_id, round(d, 6) AS freq_seconds FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY c DESC, d) AS r FROM (SELECT series_id, d, count(*) AS c FROM (SELECT series_id, epoch(ts) - epoch(lag(ts) OVER {W}) AS d FROM {{O}}) WHERE d IS NOT NULL GROUP BY 1, 2)) WHERE r = 1")(
    lambda s, d: S.infer_frequency(daily_orders(s, d))
)
query("missing_data", f"SELECT series_id, count(*) >= 2 AND min(d) <> max(d) AS missing FROM (SELECT series_id, epoch(ts) - epoch(lag(ts) OVER {W}) AS d FROM {{O}}) WHERE d IS NOT NULL GROUP BY 1")(lambda s, d: S.is_missing(daily_orders(s, d)))
query("set_timezone", "SELECT series_id, timezone('America/New_York', ts) AT TIME ZONE 'UTC' AS ts, round(value, 6) AS value FROM {D}")(lambda s, d: S.set_timezone(daily_events(s, d), "America/New_York"))
query("convert_timezone", "SELECT series_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS ts, round(value, 6) AS value FROM {D}")(lambda s, d: S.convert_timezone(daily_events(s, d), "Asia/Tokyo"))
query("wide_series", "SELECT ts, round(max(value) FILTER (series_id = 'A'), 6) AS A, round(max(value) FILTER (series_id = 'N'), 6) AS N, round(max(value) FILTER (series_id = 'R'), 6) AS R FROM {M} GROUP BY 1")(lambda s, d: S.to_wide(monthly_lineitem(s, d), ["A", "N", "R"]))
query("aggregate_level", "SELECT series_id, max(ts) AS ts, round(sum(value), 6) AS value FROM (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) - 1) // 7 AS b FROM {D}) GROUP BY series_id, b HAVING count(*) = 7")(lambda s, d: S.aggregate_level(daily_events(s, d), 7))
query("pad_front", "SELECT series_id, ts, round(value, 6) AS value FROM (SELECT * FROM {D} UNION ALL SELECT series_id, a - k * INTERVAL 1 DAY, v FROM (SELECT series_id, min(ts) AS a, min_by(value, ts) AS v FROM {D} GROUP BY 1), range(1, 4) t(k))")(lambda s, d: S.pad_front(daily_events(s, d), "1 day", 3))
query("remove_outliers", "SELECT series_id, ts, round(CASE WHEN value <= 40 THEN value END, 6) AS value FROM {D}")(lambda s, d: S.remove_outliers(daily_events(s, d), daily_events(s, d).where("value > 40")))

# ---- calendar ---------------------------------------------------------------------------------

query(
    "date_features",
    """SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, CAST(isodow(ts) - 1 AS INT) AS dayofweek, CAST(dayofyear(ts) AS INT) AS dayofyear, CAST(quarter(ts) AS INT) AS quarter,
  CAST((month(ts) % 12) // 3 AS INT) AS season, CAST(week(ts) AS INT) AS weekofyear, CAST(ceil((isodow(date_trunc('month', ts)) - 1 + day(ts)) / 7.0) AS INT) AS weekofmonth, isodow(ts) >= 6 AS is_weekend,
  year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0) AS is_leap_year, month(ts) = 2 AND day(ts) = 29 AS is_leap_day, CAST(ts AS DATE) = last_day(ts) AS is_month_end, CAST(ts AS DATE) = last_day(ts) AND month(ts) % 4 = 3 AS is_quarter_end FROM events""",
)(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", *[c.alias(k) for k, c in C.date_features(F.col("ts")).items()]))
query(
    "time_of_day_features",
    """SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(minute(ts) AS INT) AS minute, CAST(second(ts) AS INT) AS second, CAST((epoch_us(ts) % 1000000) // 1000 AS INT) AS milliseconds, CAST(minute(ts) // 15 + 1 AS INT) AS quarterhour,
  CAST((isodow(ts) - 1) * 24 + hour(ts) AS INT) AS hourofweek, CAST(hour(ts) // 6 AS INT) AS daytime FROM events""",
)(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", *[c.alias(k) for k, c in C.time_features(F.col("ts")).items()]))
query(
    "calendar_features",
    """SELECT event_id, CAST(minute(ts) AS INT) AS minute, CAST(hour(ts) AS INT) AS hour, CAST(day(ts) AS INT) AS day, CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(dayofyear(ts) AS INT) AS dayofyear, isoyear(ts) || '-' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week,
  CAST(month(ts) AS INT) AS month, CAST(quarter(ts) AS INT) AS quarter, CAST(year(ts) AS INT) AS year, CAST(week(ts) AS INT) AS weekofyear, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minuteofday FROM events""",
)(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", *[c.alias(k) for k, c in C.calendar_features(F.col("ts")).items()]))
query("circle_encode", "SELECT event_id, round(cos(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS cos, round(sin(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS sin FROM events")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", *[c.alias(k) for k, c in C.circle_encode(F.hour("ts"), 24).items()]))
query("fourier_features", "SELECT series_id, ts, round(sin(epoch(ts) / 86400 * 2 * pi() / 7), 6) + 0.0 AS fourier_7_sin_1, round(cos(epoch(ts) / 86400 * 2 * pi() / 7), 6) + 0.0 AS fourier_7_cos_1, round(sin(epoch(ts) / 86400 * 4 * pi() / 7), 6) + 0.0 AS fourier_7_sin_2, round(cos(epoch(ts) / 86400 * 4 * pi() / 7), 6) + 0.0 AS fourier_7_cos_2 FROM {D}")(
    lambda s, d: daily_events(s, d).select(ID, TS, *[c.alias(k) for k, c in C.fourier_features(F.col(TS), [7], 2, 86400).items()])
)
query("one_hot", "SELECT event_id, CAST(event_type = 'click' AS INT) AS event_type_is_click, CAST(event_type = 'view' AS INT) AS event_type_is_view FROM events")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", *[c.alias(k) for k, c in C.one_hot(F.col("event_type"), "event_type", ["click", "view"]).items()]))
query("holidays", "SELECT series_id, ts, CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15') AS holiday FROM {D}")(lambda s, d: daily_events(s, d).select(ID, TS, C.is_holiday(F.col(TS), ["2024-01-01", "2024-01-15"]).alias("holiday")))

# ---- indicators -----------------------------------------------------------------------------------

_R5 = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
query(
    "indicators",
    f"""SELECT series_id, ts, round(CASE WHEN lag(value, 4) OVER {W} <> 0 THEN (value - lag(value, 4) OVER {W}) / lag(value, 4) OVER {W} END, 6) AS roc, round(value - lag(value, 5) OVER {W}, 6) AS mom, round(CASE WHEN count(*) {_R5} >= 5 THEN avg(value) {_R5} END, 6) AS ma,
  round(lag(value, 5) OVER {W}, 6) AS lag, round(CASE WHEN count(*) {_R5} >= 5 THEN 4 * stddev_samp(value) {_R5} / nullif(avg(value) {_R5}, 0) END, 6) AS bb_width_5,
  round(CASE WHEN count(*) {_R5} >= 5 THEN (value - avg(value) {_R5} + 2 * stddev_samp(value) {_R5}) / nullif(4 * stddev_samp(value) {_R5}, 0) END, 6) AS bb_place_5 FROM {{D}}""",
)(lambda s, d: daily_events(s, d).select(ID, TS, I.roc(F.col(VALUE), 5).alias("roc"), I.mom(F.col(VALUE), 5).alias("mom"), I.ma(F.col(VALUE), 5).alias("ma"), I.lag(F.col(VALUE), 5).alias("lag"), *[c.alias(k) for k, c in I.bbands(F.col(VALUE), 5).items()]))
query("lag_embedding", f"SELECT series_id, ts, round(lag(value, 1) OVER {W}, 6) AS lag_1, round(lag(value, 2) OVER {W}, 6) AS lag_2, round(lead(value, 1) OVER {W}, 6) AS lead_1 FROM {{D}}")(lambda s, d: daily_events(s, d).select(ID, TS, *[c.alias(k) for k, c in I.embed(F.col(VALUE), [1, 2], [1]).items()]))
_EWM = """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM {D}),
e AS (SELECT series_id, ts, i, value AS s5, CAST(1 AS DOUBLE) AS w5, value AS s12, CAST(1 AS DOUBLE) AS w12 FROM n WHERE i = 1
  UNION ALL SELECT n.series_id, n.ts, n.i, e.s5 * (1 - 2 / 6.0) + n.value, e.w5 * (1 - 2 / 6.0) + 1, e.s12 * (1 - 2 / 13.0) + n.value, e.w12 * (1 - 2 / 13.0) + 1 FROM e JOIN n ON n.series_id = e.series_id AND n.i = e.i + 1)
"""
query("ewm", _EWM + "SELECT series_id, ts, round(s5 / w5, 6) AS ema5, round(s12 / w12, 6) AS ema12 FROM e")(lambda s, d: I.ewm_frame(daily_events(s, d), {"ema5": 5, "ema12": 12}).drop(VALUE))
query("tsi")(lambda s, d: I.exploded(S.to_arrays(daily_events(s, d)), {"tsi": I.tsi_array(F.col("values"), 10, 5)}))
_P7 = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
_R7 = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
query(
    "rolling_scores",
    f"""SELECT series_id, ts, round(CASE WHEN n7 >= 7 THEN q3r - q1r END, 6) AS iqr, round(CASE WHEN n7 >= 7 THEN list_median(list_transform(lr, lambda x: abs(x - medr))) END, 6) AS mad, round(CASE WHEN np >= 7 THEN CASE WHEN sd = 0 THEN 0 ELSE (value - m) / sd END END, 6) AS z_score,
  round(CASE WHEN np >= 7 THEN coalesce((value - med) / nullif(list_median(list_transform(lp, lambda x: abs(x - med))), 0), 0) END, 6) AS modified_z_mad, round(CASE WHEN np >= 7 THEN coalesce((value - med) / nullif(q3 - q1, 0), 0) END, 6) AS modified_z_iqr,
  round(CASE WHEN np >= 7 THEN CASE WHEN value >= q3 + 1.5 * (q3 - q1) THEN 1.0 WHEN value < q1 - 1.5 * (q3 - q1) THEN -1.0 ELSE 0.0 END * coalesce(abs(value - med) / nullif(med, 0), 0) END, 6) + 0.0 AS iqr_median_deviation FROM (
  SELECT *, count(*) {_R7} AS n7, count(*) {_P7} AS np, quantile_cont(value, 0.75) {_R7} AS q3r, quantile_cont(value, 0.25) {_R7} AS q1r, quantile_cont(value, 0.5) {_R7} AS medr, list(value) {_R7} AS lr, list(value) {_P7} AS lp,
    avg(value) {_P7} AS m, stddev_pop(value) {_P7} AS sd, quantile_cont(value, 0.5) {_P7} AS med, quantile_cont(value, 0.75) {_P7} AS q3, quantile_cont(value, 0.25) {_P7} AS q1 FROM {{D}})""",
)(lambda s, d: daily_events(s, d).select(ID, TS, *[c.alias(k) for k, c in I.rolling_scores(F.col(VALUE), 7).items()]))

# ---- metrics ----------------------------------------------------------------------------------------

_PE = "CASE WHEN y = 0 THEN sign(y - fcst) ELSE (y - fcst) / y END"
_SM = "CASE WHEN abs(y) + abs(fcst) = 0 THEN 0 ELSE abs(y - fcst) / (abs(y) + abs(fcst)) END"
query(
    "forecast_metrics",
    f"""SELECT series_id, round(avg(y - fcst), 6) AS mean_error, round(avg(abs(y - fcst)), 6) AS mean_absolute_error, round(avg((y - fcst) * (y - fcst)), 6) AS mean_squared_error, round(sqrt(avg((y - fcst) * (y - fcst))), 6) AS root_mean_squared_error,
  round(sqrt(avg((ln(1 + y) - ln(1 + fcst)) ** 2)), 6) AS root_mean_squared_log_error, round(sqrt(avg(({_PE}) ** 2)), 6) AS root_mean_squared_percentage_error, round(avg({_PE}), 6) AS mean_percentage_error, round(avg(abs({_PE})), 6) AS mean_absolute_percentage_error,
  round(median(abs(y - fcst)), 6) AS median_absolute_error, round(median(abs({_PE})), 6) AS median_absolute_percentage_error, round(2 * avg({_SM}), 6) AS symmetric_mean_absolute_percentage_error, round(avg({_SM}), 6) AS scaled_symmetric_mean_absolute_percentage_error,
  round(-2 * avg(CASE WHEN abs(y) + abs(fcst) = 0 THEN 0 ELSE (y - fcst) / (abs(y) + abs(fcst)) END), 6) AS symmetric_bias, round(sum(y - fcst) / avg(abs(y - fcst)), 6) AS tracking_signal FROM {{F}} GROUP BY 1""",
)(lambda s, d: M.evaluate(naive_forecasts(s, d), list(M.METRICS)))
query(
    "interval_metrics",
    """SELECT series_id, round(avg(CASE WHEN y BETWEEN fcst_lower AND fcst_upper THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(fcst_upper - fcst_lower + CASE WHEN y < fcst_lower THEN 10 * (fcst_lower - y) ELSE 0 END + CASE WHEN y > fcst_upper THEN 10 * (y - fcst_upper) ELSE 0 END), 6) AS interval_score,
  round(avg(greatest((y - fcst) * 0.9, (y - fcst) * -0.1)), 6) AS pinball_loss, round(avg(CASE WHEN y > fcst THEN 1.0 ELSE 0.0 END), 6) AS exceed, round(avg(CASE WHEN abs(CASE WHEN y = 0 THEN sign(y - fcst) ELSE (y - fcst) / y END) > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS frequency_exceeds FROM {F} GROUP BY 1""",
)(
    lambda s, d: naive_forecasts(s, d).groupBy(ID).agg(
        M.coverage(F.col("y"), F.col("fcst_lower"), F.col("fcst_upper")).alias("coverage"), M.interval_score(F.col("y"), F.col("fcst_lower"), F.col("fcst_upper")).alias("interval_score"), M.pinball_loss(F.col("y"), F.col("fcst"), 0.9).alias("pinball_loss"),
        M.exceed(F.col("y"), F.col("fcst"), 0.9).alias("exceed"), M.frequency_exceeds_relative_threshold(F.col("y"), F.col("fcst"), 0.5).alias("frequency_exceeds"),
    )
)
query("weighted_metrics", "SELECT series_id, round(sum(abs(y - fcst) * y) / sum(y), 6) AS mae, round(sum((y - fcst) ** 2 * y) / sum(y), 6) AS mse FROM {F} GROUP BY 1")(lambda s, d: naive_forecasts(s, d).groupBy(ID).agg(M.mean_absolute_error(F.col("y"), F.col("fcst"), F.col("y")).alias("mae"), M.mean_squared_error(F.col("y"), F.col("fcst"), F.col("y")).alias("mse")))
query("scaled_error", f"SELECT series_id, round(avg(e) / avg(s), 6) AS mase FROM (SELECT series_id, abs(y - fcst) AS e, abs(y - lag(y) OVER {W}) AS s FROM {{F}}) GROUP BY 1")(lambda s, d: M.mean_absolute_scaled_error(naive_forecasts(s, d)))
query(
    "distribution_scores",
    """SELECT series_id, round(avg(abs(a - b)), 6) AS leps, round(avg((a - b) ** 2), 6) AS crps FROM (SELECT series_id, t, max(c) FILTER (is_y = 1) AS a, max(c) FILTER (is_y = 0) AS b FROM (
  SELECT *, sum(is_y) OVER (PARTITION BY series_id ORDER BY x RANGE UNBOUNDED PRECEDING) / CAST(sum(is_y) OVER (PARTITION BY series_id) AS DOUBLE) AS c FROM (SELECT series_id, y AS x, 1 AS is_y, ts AS t FROM {F} UNION ALL SELECT series_id, fcst, 0, ts FROM {F})) GROUP BY 1, 2) GROUP BY 1""",
)(lambda s, d: M.distribution_scores(naive_forecasts(s, d)))
query("point_errors", "SELECT series_id, ts, round(y - fcst, 6) + 0.0 AS error, round(abs(y - fcst), 6) AS absolute_error, round(CASE WHEN y = 0 THEN sign(y - fcst) ELSE (y - fcst) / y END, 6) + 0.0 AS percentage_error, round(abs(CASE WHEN y = 0 THEN sign(y - fcst) ELSE (y - fcst) / y END), 6) AS absolute_percentage_error, round((y - fcst) * y / sum(y) OVER (PARTITION BY series_id), 6) + 0.0 AS weighted_error FROM {F}")(
    lambda s, d: naive_forecasts(s, d).select(ID, TS, *[f(F.col("y"), F.col("fcst")).alias(f.__name__) for f in (M.error, M.absolute_error, M.percentage_error, M.absolute_percentage_error)], M.weighted(F.col("y") - F.col("fcst"), F.col("y"), Window.partitionBy(ID)).alias("weighted_error"))
)
query(
    "rolling_coverage",
    """SELECT series_id, ts, round(sum(CASE WHEN y BETWEEN fcst_lower AND fcst_upper THEN 1.0 ELSE 0.0 END) OVER w / 7, 6) AS coverage, round(sum(fcst_upper - fcst_lower + CASE WHEN y < fcst_lower THEN 10 * (fcst_lower - y) ELSE 0 END + CASE WHEN y > fcst_upper THEN 10 * (y - fcst_upper) ELSE 0 END) OVER w / 7, 6) AS interval_score
FROM {F} WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)(
    lambda s, d: naive_forecasts(s, d).select(
        ID, TS, M.rolling_mean_same(F.when((F.col("y") >= F.col("fcst_lower")) & (F.col("y") <= F.col("fcst_upper")), 1.0).otherwise(0.0), 7).alias("coverage"), M.rolling_mean_same(M.interval_error(F.col("y"), F.col("fcst_lower"), F.col("fcst_upper")), 7).alias("interval_score")
    )
)
query("residuals", "SELECT series_id, ts, round(y - fcst, 6) + 0.0 AS residual, round((y - fcst) / nullif(fcst_upper - fcst_lower, 0), 6) + 0.0 AS scaled FROM {F}")(lambda s, d: naive_forecasts(s, d).select(ID, TS, (F.col("y") - F.col("fcst")).alias("residual"), S.divide(F.col("y") - F.col("fcst"), F.col("fcst_upper") - F.col("fcst_lower")).alias("scaled")))

# ---- features ------------------------------------------------------------------------------------------

_N = f"(SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM {{D}})"
query("features_basic", f"SELECT series_id, count(*) AS length, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS var, round(regr_r2(value, i), 6) AS linearity, round(avg(CAST(value > m AS INT)), 6) AS binarize_mean FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m FROM {_N}) GROUP BY 1")(lambda s, d: T.basic(daily_events(s, d)))
query("features_tiles", f"SELECT series_id, round(var_pop(v), 6) AS lumpiness, round(var_pop(m), 6) AS stability FROM (SELECT series_id, t, var_pop(value) AS v, avg(value) AS m FROM (SELECT *, ntile(n // 20 + 1) OVER {W} AS t FROM {_N}) GROUP BY 1, 2) GROUP BY 1")(lambda s, d: T.tiles(daily_events(s, d)))
query(
    "features_flat_spots",
    f"SELECT series_id, max(c) AS flat_spots FROM (SELECT series_id, k, r, count(*) AS c FROM (SELECT *, sum(f) OVER (PARTITION BY series_id, k ORDER BY ts) AS r FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY series_id, k ORDER BY ts) THEN 0 ELSE 1 END AS f FROM (SELECT *, i // greatest(n // 10, 1) AS k FROM {_N}))) GROUP BY 1, 2, 3) GROUP BY 1",
)(lambda s, d: T.flat_spots(daily_events(s, d)))
query("features_crossing", f"SELECT series_id, count(*) FILTER ((value <= m AND nx > m) OR (value > m AND nx <= m)) AS crossing_points FROM (SELECT *, median(value) OVER (PARTITION BY series_id) AS m, lead(value) OVER {W} AS nx FROM {{D}}) GROUP BY 1")(lambda s, d: T.crossing_points(daily_events(s, d)))
query("features_gradient", f"SELECT series_id, round(stddev_pop(CASE WHEN a IS NULL THEN b - value WHEN b IS NULL THEN value - a ELSE (b - a) / 2 END), 6) AS std1st_der FROM (SELECT *, lag(value) OVER {W} AS a, lead(value) OVER {W} AS b FROM {{D}}) GROUP BY 1")(lambda s, d: T.gradient(daily_events(s, d)))
query(
    "features_hurst",
    f"SELECT series_id, round(regr_slope(ln(sd), ln(k)), 6) AS hurst FROM (SELECT series_id, k, n, stddev_pop(d) AS sd FROM (SELECT a.series_id, k, a.n, b.value - a.value AS d FROM range(2, 30) t(k), {_N} a JOIN {_N} b ON a.series_id = b.series_id AND b.i = a.i + k) GROUP BY 1, 2, 3) WHERE k < least(n - 1, 30) AND sd > 0 GROUP BY 1",
)(lambda s, d: T.hurst(daily_events(s, d)))
query(
    "features_histogram",
    f"SELECT series_id, round(lo + b * (hi - lo) / 10, 6) AS histogram_mode FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY c DESC, b) AS r FROM (SELECT series_id, lo, hi, least(floor((value - lo) / ((hi - lo) / 10)), 9) AS b, count(*) AS c FROM (SELECT *, min(value) OVER (PARTITION BY series_id) AS lo, max(value) OVER (PARTITION BY series_id) AS hi FROM {_N}) GROUP BY ALL)) WHERE r = 1",
)(lambda s, d: T.histogram_mode(daily_events(s, d)))
query(
    "features_level_shift",
    f"SELECT series_id, i - 20 AS level_shift_idx, round(d, 6) AS level_shift_size FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d DESC, i) AS r FROM (SELECT *, round(abs(m - lag(m) OVER {W}), 9) AS d FROM (SELECT *, CASE WHEN i >= 19 THEN avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING) END AS m FROM {_N})) WHERE d IS NOT NULL) WHERE r = 1",
)(lambda s, d: T.level_shift(daily_events(s, d)))
_A = lambda k, src: f"(SELECT series_id, sum(x * l) / sum(x * x) AS r FROM (SELECT series_id, x, lag(x, {k}) OVER (PARTITION BY series_id ORDER BY ts) AS l FROM (SELECT *, v - avg(v) OVER (PARTITION BY series_id) AS x FROM {src})) GROUP BY 1)"
_Y = "(SELECT series_id, ts, value AS v FROM {D})"
_D1 = f"(SELECT series_id, ts, v FROM (SELECT series_id, ts, value - lag(value) OVER {W} AS v FROM {{D}}) WHERE v IS NOT NULL)"
_D2 = f"(SELECT series_id, ts, v FROM (SELECT series_id, ts, v - lag(v) OVER {W} AS v FROM {_D1}) WHERE v IS NOT NULL)"
_SQ = lambda src: "(SELECT series_id, sum(r * r) AS q FROM (" + " UNION ALL ".join(f"SELECT * FROM {_A(k, src)}" for k in range(1, 6)) + ") GROUP BY 1)"
query(
    "features_acf",
    "SELECT a.series_id, round(a.r, 6) AS y_acf1, round(b.q, 6) AS y_acf5, round(c.r, 6) AS diff1y_acf1, round(d.q, 6) AS diff1y_acf5, round(e.r, 6) AS diff2y_acf1, round(f.q, 6) AS diff2y_acf5, round(g.r, 6) AS seas_acf1 FROM "
    + f"{_A(1, _Y)} a JOIN {_SQ(_Y)} b USING (series_id) JOIN {_A(1, _D1)} c USING (series_id) JOIN {_SQ(_D1)} d USING (series_id) JOIN {_A(1, _D2)} e USING (series_id) JOIN {_SQ(_D2)} f USING (series_id) JOIN {_A(7, _Y)} g USING (series_id)",
)(lambda s, d: T.acf_features(daily_events(s, d)))
query(
    "features_kpss",
    f"SELECT series_id, round((sum(c * c) / (count(*) * count(*))) / ((sum(r * r) + sum(rr)) / count(*)), 6) AS unitroot_kpss FROM (SELECT *, sum(r) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c, r * lag(r) OVER {W} AS rr FROM (SELECT *, value - regr_intercept(value, i) OVER (PARTITION BY series_id) - regr_slope(value, i) OVER (PARTITION BY series_id) * i AS r FROM {_N})) GROUP BY 1",
)(lambda s, d: T.kpss(daily_events(s, d)))
query(
    "features_time",
    "SELECT series_id, count(DISTINCT year(ts)) AS time_years, count(DISTINCT strftime(ts, '%Y-%m')) AS time_months, count(DISTINCT strftime(ts, '%G-%V')) AS time_weeks, count(DISTINCT strftime(ts, '%Y-%d')) AS time_days, count(DISTINCT hour(ts)) AS time_hours, count(DISTINCT minute(ts)) AS time_minutes, count(DISTINCT second(ts)) AS time_seconds, "
    + ", ".join(f"round(avg(CAST(isodow(ts) = {i + 1} AS INT)), 6) AS weekday_{i}" for i in range(7))
    + ", CAST(date_diff('day', min(ts), max(ts)) AS INT) AS span_days FROM {H} GROUP BY 1",
)(lambda s, d: T.time_features(hourly_events(s, d)))
query("features_nowcasting", f"SELECT series_id, round(avg(coalesce((value - l4) / nullif(l4, 0), 0)), 6) AS nowcast_roc, round(avg(coalesce(CASE WHEN n >= 5 THEN m END, 0)), 6) AS nowcast_ma, round(avg(coalesce(value - l5, 0)), 6) AS nowcast_mom, round(avg(coalesce(l5, 0)), 6) AS nowcast_lag FROM (SELECT *, lag(value, 4) OVER {W} AS l4, lag(value, 5) OVER {W} AS l5, avg(value) {_R5} AS m, count(*) {_R5} AS n FROM {{D}}) GROUP BY 1")(
    lambda s, d: T.nowcasting(daily_events(s, d))
)
query("features_all")(lambda s, d: T.features(daily_events(s, d), list(T.GROUPS)))
query("features_structure")(lambda s, d: D.structure_features(daily_orders(s, d)))

# ---- detection ------------------------------------------------------------------------------------------

query("static_threshold", "SELECT series_id, ts, round(value, 6) AS score, value NOT BETWEEN 30 AND 80 AS alert FROM {D}")(lambda s, d: D.static_threshold(daily_events(s, d), 30, 80))
query("rolling_detector", f"SELECT series_id, ts, round(value, 6) AS value, round(coalesce(CASE WHEN count(*) {_P7} >= 7 THEN CASE WHEN stddev_pop(value) {_P7} = 0 THEN 0 ELSE (value - avg(value) {_P7}) / stddev_pop(value) {_P7} END END, 0), 6) + 0.0 AS score FROM {{D}}")(lambda s, d: D.rolling_detector(daily_events(s, d), 7))
_TW, _CW = "RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW", "RANGE BETWEEN INTERVAL 9 DAY PRECEDING AND INTERVAL 3 DAY PRECEDING"
query(
    "stat_sig",
    f"""SELECT series_id, ts, round(m0, 6) AS predicted, round(m1 - m0, 6) + 0.0 AS magnitude, n0 + n1 - 2 AS df, round(coalesce((m1 - m0) / nullif(sqrt(((n0 - 1) * coalesce(q0, 0) + (n1 - 1) * coalesce(q1, 0)) / (n0 + n1 - 2)) * sqrt(1.0 / n0 + 1.0 / n1), 0), 0), 6) + 0.0 AS score FROM (
  SELECT series_id, ts, CASE WHEN n0 >= 2 THEN m0 END AS m0, CASE WHEN n0 >= 2 THEN m1 END AS m1, CASE WHEN n0 >= 2 THEN n0 END AS n0, n1, q0, q1 FROM (
    SELECT *, count(*) OVER c AS n0, avg(value) OVER c AS m0, var_samp(value) OVER c AS q0, count(*) OVER t AS n1, avg(value) OVER t AS m1, var_samp(value) OVER t AS q1 FROM {{D}} WINDOW c AS (PARTITION BY series_id ORDER BY ts {_CW}), t AS (PARTITION BY series_id ORDER BY ts {_TW})))""",
)(lambda s, d: D.stat_sig(daily_events(s, d), 7, 3, 86400))
query("cusum_first_pass", f"SELECT series_id, i AS cp_index, round(c, 6) + 0.0 AS cumsum FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY c, i) AS r FROM (SELECT *, round(sum(x) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS c FROM (SELECT *, value - avg(value) OVER (PARTITION BY series_id) AS x FROM {_N}))) WHERE r = 1")(lambda s, d: D.cusum_first_pass(daily_events(s, d)))
query(
    "ab_statistic",
    "SELECT series_id, ts, round((value_b - value_a) / sqrt(variance_a / sample_count_a + variance_b / sample_count_b), 6) AS absolute, round((ln(value_b) - ln(value_a)) / sqrt(variance_a / sample_count_a / value_a ** 2 + variance_b / sample_count_b / value_b ** 2), 6) AS relative FROM {AB}",
)(lambda s, d: D.ab_statistic(D.ab_statistic(two_sample(s, d)).withColumnRenamed("test_statistic", "absolute"), relative=True).select(ID, TS, "absolute", F.col("test_statistic").alias("relative")))
_RUNS = "SELECT series_id, min(ts) AS start, coalesce(max_by(nx, ts), max(ts)) AS \"end\", count(*) AS points FROM (SELECT *, sum(f) OVER {w} AS r FROM (SELECT *, lead(ts) OVER {w} AS nx, CASE WHEN hit = lag(hit) OVER {w} THEN 0 ELSE 1 END AS f FROM ({src}))) WHERE hit GROUP BY series_id, r"
query("ab_intervals", _RUNS.replace("{w}", W).replace("{src}", f"SELECT *, coalesce((value_b - value_a) / sqrt(variance_a / sample_count_a + variance_b / sample_count_b) >= {K.norm_ppf(1 - K.least_p(2, 30, 0.05))!r}, false) AS hit FROM {{AB}}") + " HAVING count(*) >= 2")(lambda s, d: D.ab_intervals(D.validate_ab(two_sample(s, d)), m=2))
query("score_runs", _RUNS.replace("{w}", W).replace("{src}", "SELECT *, value > 70 AS hit FROM {D}"))(lambda s, d: D.runs(daily_events(s, d).withColumn("hit", F.col(VALUE) > 70), "hit"))
query(
    "alert_intervals",
    f"""SELECT series_id, min(ts) AS start, coalesce(max_by(nx, ts), max(ts)) AS "end", count(*) AS points, round(coalesce(sum(o * sec), 0), 6) AS volume, round(coalesce(sum(o * sec) / nullif(sum(sec), 0), 0), 6) AS height, round(max(share), 6) AS magnitude FROM (
  SELECT *, sum(f) OVER {W} AS r FROM (SELECT *, lead(ts) OVER {W} AS nx, epoch(lead(ts) OVER {W}) - epoch(ts) AS sec, CASE WHEN hit = lag(hit) OVER {W} THEN 0 ELSE 1 END AS f FROM (
    SELECT *, CASE WHEN score > 2 THEN score - 2 WHEN score < -2 THEN -2 - score ELSE 0 END AS o, CASE WHEN score > 2 THEN score - 2 WHEN score < -2 THEN -2 - score ELSE 0 END / 2 AS share, (score > 2 OR score < -2) AND ts >= min(ts) OVER (PARTITION BY series_id) + INTERVAL 1 SECOND AS hit FROM (
      SELECT series_id, ts, coalesce(CASE WHEN count(*) {_P7} >= 7 THEN CASE WHEN stddev_pop(value) {_P7} = 0 THEN 0 ELSE (value - avg(value) {_P7}) / stddev_pop(value) {_P7} END END, 0) AS score FROM {{D}})))) WHERE hit GROUP BY series_id, r""",
)(lambda s, d: D.alerts(D.rolling_detector(daily_events(s, d), 7)))
_Z = K.norm_ppf(0.975)
_T = f"({_Z} + {(_Z**3 + _Z) / 4} / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / df**2 + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / df**3)"  # the 0.975 quantile of Student's t
_SIDES = """SELECT a.series_id, a.start, a."end", '{at}' AS edge, count(*) FILTER (s.ts < a."{at}") AS n0, count(*) FILTER (s.ts >= a."{at}") AS n1, avg(value) FILTER (s.ts < a."{at}") AS m0, avg(value) FILTER (s.ts >= a."{at}") AS m1,
  var_pop(value) FILTER (s.ts < a."{at}") AS v0, var_pop(value) FILTER (s.ts >= a."{at}") AS v1, regr_intercept(value, i) FILTER (s.ts < a."{at}") AS c0, regr_intercept(value, i) AS c, regr_slope(value, i) FILTER (s.ts < a."{at}") AS b0, regr_slope(value, i) FILTER (s.ts >= a."{at}") AS b1
  FROM a JOIN s ON s.series_id = a.series_id GROUP BY ALL"""
query(
    "alert_types",
    f"""WITH s AS (SELECT *, row_number() OVER {W} - 1 AS i FROM {{O}}),
z AS (SELECT series_id, ts, coalesce(CASE WHEN count(*) OVER z >= 30 THEN CASE WHEN stddev_pop(value) OVER z = 0 THEN 0 ELSE (value - avg(value) OVER z) / stddev_pop(value) OVER z END END, 0) AS score FROM s WINDOW z AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
a AS (SELECT series_id, min(ts) AS start, coalesce(max_by(nx, ts), max(ts)) AS "end" FROM (SELECT *, sum(f) OVER {W} AS r FROM (SELECT *, lead(ts) OVER {W} AS nx, CASE WHEN hit = lag(hit) OVER {W} THEN 0 ELSE 1 END AS f FROM (
  SELECT *, (score > 3 OR score < -3) AND ts >= min(ts) OVER (PARTITION BY series_id) + INTERVAL 1 SECOND AS hit FROM z))) WHERE hit GROUP BY series_id, r),
g AS ({_SIDES.replace("{at}", "start")} UNION ALL {_SIDES.replace("{at}", "end")}),
d AS (SELECT *, n0 > 1 AND n1 > 1 AS enough, n0 + n1 - 2 AS df FROM g)
SELECT series_id, start, "end", max(n0) FILTER (edge = 'end') - max(n0) FILTER (edge = 'start') < 5 AS outlier,
  bool_or(coalesce(enough AND abs(m0 - m1) >= {_T} * sqrt((n0 * v0 + n1 * v1) / df * (1.0 / n0 + 1.0 / n1)) AND NOT (c0 < 1.5 * c AND c0 > c / 1.5), false)) AS level_shift,
  coalesce(max(n0) FILTER (edge = 'start') > 1 AND max(n1) FILTER (edge = 'end') > 1 AND max(b0) FILTER (edge = 'start') * max(b1) FILTER (edge = 'end') < 0, false) AS trend_change,
  bool_or(coalesce(enough AND (sqrt(v0) >= 2 * sqrt(v1) OR sqrt(v0) <= sqrt(v1) / 2), false)) AS volatility_change
FROM d GROUP BY series_id, start, "end" """,
)(lambda s, d: D.classify_alerts(daily_orders(s, d), D.alerts(D.rolling_detector(daily_orders(s, d), 30), -3, 3)))
query("hourly_ratio", "SELECT series_id, day, hour, round(ratio, 6) AS ratio, round(coalesce((ratio - avg(ratio) OVER w) / nullif(stddev_pop(ratio) OVER w, 0), 0), 6) + 0.0 AS score FROM (SELECT *, v / sum(v) OVER (PARTITION BY series_id, day) AS ratio FROM (SELECT series_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INT) AS hour, sum(value) AS v FROM {H} GROUP BY ALL)) WINDOW w AS (PARTITION BY series_id, isodow(day), hour)")(
    lambda s, d: D.hourly_ratio(hourly_events(s, d))
)
query("bh_adjusted", "WITH p AS (SELECT c_custkey, c_nationkey, (abs(c_acctbal) % 1000) / 1000 AS p FROM customer), r AS (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY p) AS p_rank, count(*) OVER (PARTITION BY c_nationkey ORDER BY p RANGE UNBOUNDED PRECEDING) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM p) SELECT c_custkey, c_nationkey, round(p, 6) AS p, round(least(1.0, min(p * n / k) OVER (PARTITION BY c_nationkey ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adjusted, CAST(p_rank AS INT) AS p_rank FROM r")(
    lambda s, d: D.benjamini_hochberg(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", (F.abs("c_acctbal") % 1000 / 1000).alias("p")), "p", ["c_nationkey"])
)
query("robust_stat")(lambda s, d: D.robust_stat(daily_orders(s, d)))
query("cusum")(lambda s, d: D.cusum(daily_events(s, d)))
query("change_scores")(lambda s, d: D.change_scores(monthly_lineitem(s, d), D.cusum(monthly_lineitem(s, d)).where("detected")))
query("bocpd")(lambda s, d: D.bocpd(monthly_lineitem(s, d)))
query("outliers")(lambda s, d: D.outliers(daily_orders(s, d)))
query("mann_kendall")(lambda s, d: D.mann_kendall(monthly_lineitem(s, d)))
query("seasonality_fft")(lambda s, d: D.seasonality(daily_orders(s, d)))
query("seasonality_acf")(lambda s, d: D.seasonality(daily_orders(s, d), "acf"))
query("dtw_anomalies")(lambda s, d: D.dtw_anomalies(daily_events(s, d), 15, 5))
query("decompose_stl")(lambda s, d: D.decompose(daily_orders(s, d), 7))
query("decompose_classical")(lambda s, d: D.decompose(daily_orders(s, d), 7, "classical"))


def _wide_flags(s, d):
    return S.to_wide(monthly_lineitem(s, d), ["A", "N", "R"]).where("A is not null and N is not null and R is not null").withColumn(ID, F.lit("flags"))


def _wide_events(s, d):
    names = ["click", "error", "view"]
    return S.to_wide(daily_events(s, d), names).na.drop().withColumn(ID, F.lit("events")), names


query("multivariate_cusum")(lambda s, d: D.multivariate_cusum(_wide_events(s, d)[0], _wide_events(s, d)[1]))
query("multivariate_anomaly")(lambda s, d: D.multivariate_anomaly(*_wide_events(s, d), 20))
query(
    "distribution_distance",
    """WITH r AS (SELECT event_type AS series_id, date_trunc('day', ts) AS ts, [quantile_cont(value, 0.05), quantile_cont(value, 0.25), quantile_cont(value, 0.5), quantile_cont(value, 0.75), quantile_cont(value, 0.95)] AS b FROM events GROUP BY ALL),
o AS (SELECT *, first_value(ts) OVER w AS since, first_value(b) OVER w AS a FROM r WINDOW w AS (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)),
d AS (SELECT series_id, ts, since, CASE WHEN len(list_distinct(a)) >= len(list_distinct(b)) THEN a ELSE b END AS g, CASE WHEN len(list_distinct(a)) >= len(list_distinct(b)) THEN b ELSE a END AS h FROM o),
e AS (SELECT *, list_sort(list_distinct(g)) AS grid, list_sort(list_distinct(h)) AS steps FROM d),
x AS (SELECT series_id, ts, since, g, h, steps, unnest(grid) AS x, unnest(range(1, len(grid) + 1)) AS i FROM e),
j AS (SELECT *, len(list_filter(steps, lambda v: v <= x)) AS j, len(list_filter(h, lambda v: v <= x)) AS k, len(list_filter(g, lambda v: v = x)) / 5.0 AS p FROM x),
c AS (SELECT *, CASE WHEN j = len(steps) THEN 1.0 WHEN j = 0 THEN 0.0 ELSE k / 5.0 + (x - steps[j]) / (steps[j + 1] - steps[j]) / 5.0 END AS c FROM j),
q AS (SELECT *, c - coalesce(lag(c) OVER (PARTITION BY series_id, ts ORDER BY i), 0) AS q FROM c),
m AS (SELECT *, q / nullif(sum(q) OVER (PARTITION BY series_id, ts), 0) AS u FROM q)
SELECT series_id, ts, round(CASE WHEN epoch(ts) - epoch(since) > 0.9 * 7 * 86400 THEN CASE WHEN sum(q) > 0 THEN sqrt(greatest(sum(0.5 * (CASE WHEN p > 0 THEN p * log2(p / ((p + u) / 2)) ELSE 0 END + CASE WHEN u > 0 THEN u * log2(u / ((p + u) / 2)) ELSE 0 END)), 0)) END ELSE 0 END, 6) AS score
FROM m GROUP BY series_id, ts, since""",
)(
    lambda s, d: D.distribution_distance(s.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias(ID), F.date_trunc("day", "ts").alias(TS)).agg(*[F.percentile("value", F.lit(p / 100)).alias(f"p{p}") for p in (5, 25, 50, 75, 95)]), ["p5", "p25", "p50", "p75", "p95"], 7 * 86400)
)

# ---- forecasting -------------------------------------------------------------------------------------------

query(
    "heuristic_mean",
    "SELECT series_id, step, last + step * INTERVAL 1 DAY AS ts, round(f, 6) AS fcst, round(f, 6) AS fcst_lower, round(f, 6) AS fcst_upper FROM (SELECT series_id, CAST(7 - r % 7 AS INT) AS step, avg(value) AS f, max(l) AS last FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n, max(ts) OVER (PARTITION BY series_id) AS l FROM {D}) WHERE r < n // 7 * 7 GROUP BY 1, 2)",
)(lambda s, d: P.heuristic(daily_events(s, d), 7))
query("linear_forecast")(lambda s, d: P.linear(daily_events(s, d), 7))
query(
    "linear_trend",
    f"SELECT series_id, t.k AS step, round(a + b * (n - 1 + t.k), 6) AS fcst FROM (SELECT series_id, count(*) AS n, regr_intercept(value, i) AS a, regr_slope(value, i) AS b FROM {_N} GROUP BY 1), (SELECT CAST(unnest(range(1, 8)) AS INT) AS k) t",
)(lambda s, d: P.linear(daily_events(s, d), 7).select(ID, "step", "fcst"))
for _name, _params in {"quadratic": {}, "harmonic": {}, "piecewise": {}, "theta": {}, "holt_winters": {}, "arima": {}, "sarima": {}, "stlf": {}, "naive": {}, "autoregression": {}}.items():
    query(f"forecast_{_name}")(lambda s, d, n=_name, p=_params: P.forecast(daily_events(s, d), n, 7, **p))
query("forecast_var")(lambda s, d: P.vector_forecast(*_wide_events(s, d), 5, 1))
query("forecast_bayesian_var")(lambda s, d: P.vector_forecast(*_wide_events(s, d), 5, 2, (0.1, 0.5, 100.0, 1.0)))


def _models(s, d):
    one = [P.forecast(daily_events(s, d), m, 7).withColumn("model", F.lit(m)) for m in ("linear", "theta", "naive")]
    return reduce(DataFrame.unionByName, one)


query("ensemble_median")(lambda s, d: P.ensemble(_models(s, d)))


def _errors(s, d):
    f = P.folds(daily_events(s, d), 0.8, 0.2, 1)
    return reduce(DataFrame.unionByName, [P.backtest(f, m, ["mae"]).select(ID, F.lit(m).alias("model"), F.col("mae").alias("err")) for m in ("linear", "theta", "naive")])


query("ensemble_weighted")(lambda s, d: P.ensemble(_models(s, d), P.inverse_error_weights(_errors(s, d))))
query("split_fraction", f"SELECT series_id, ts, round(value, 6) AS value, CASE WHEN row_number() OVER {W} <= floor(count(*) OVER (PARTITION BY series_id) * 0.8) THEN 'train' ELSE 'test' END AS part FROM {{D}}")(lambda s, d: P.split(daily_events(s, d), 0.8))
query("split_timestamps", "SELECT series_id, ts, round(value, 6) AS value, CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS part FROM {D} WHERE ts <= TIMESTAMP '2024-01-20' OR ts >= TIMESTAMP '2024-01-22'")(lambda s, d: P.split_at(daily_events(s, d), "2024-01-20", "2024-01-22"))
for _n, _c in (("expanding", False), ("rolling", True)):
    query(
        f"folds_{_n}",
        f"SELECT series_id, ts, round(value, 6) AS value, fold, part FROM (SELECT *, CASE WHEN i > {'z - fl' if _c else '0'} AND i <= z THEN 'train' WHEN i > z AND i <= z + te THEN 'test' END AS part FROM (SELECT *, floor(fl + (n - te - fl) * fold / 2) AS z FROM (SELECT *, row_number() OVER {W} AS i, floor(count(*) OVER (PARTITION BY series_id) * 0.5) AS fl, floor(count(*) OVER (PARTITION BY series_id) * 0.2) AS te, count(*) OVER (PARTITION BY series_id) AS n FROM {{D}}), (SELECT CAST(unnest(range(0, 3)) AS INT) AS fold))) WHERE part IS NOT NULL",
    )(lambda s, d, c=_c: P.folds(daily_events(s, d), 0.5, 0.2, 3, c))
query("backtest")(lambda s, d: P.summarize(P.backtest(P.folds(daily_events(s, d), 0.5, 0.2, 3), "theta", ["mae", "smape"]), ["mae", "smape"], True))
query("tune_grid")(lambda s, d: P.tune(daily_events(s, d), [("theta", {"period": 7}), ("naive", {}), ("linear", {}), *[("arima", p) for p in P.grid_of({"p": [0, 1], "d": [0, 1], "q": [0]})]]))
query("temporal_reconciliation")(lambda s, d: P.temporal_reconciliation(daily_events(s, d), [1, 2, 4], 8, "theta"))


# ---- streams, simulation, meta-learning ------------------------------------------------------------------------


def _stream(s, d):
    path = L.scratch(s, "events")
    s.read.parquet(f"{d}/events.parquet").select("event_type", "ts", "value").write.parquet(path)
    return L.read_stream(s, path)


def _daily_stream(s, d):
    """Daily counts, written once and read back as a stream."""
    path = L.scratch(s, "daily")
    daily_events(s, d).write.parquet(path)
    return L.read_stream(s, path)


query("stream_tumbling", "SELECT event_type, date_trunc('hour', ts) AS ts, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY 1, 2")(
    lambda s, d: L.drain(L.tumbling(_stream(s, d), "1 hour", "2 hours", ["event_type"], n=F.count("*"), top=F.max("value")), "complete")
)
query("stream_rolling_z", SQL["rolling_detector"])(lambda s, d: L.drain(L.stateful(_daily_stream(s, d), *L.rolling_z(7))))
query("stream_cusum")(lambda s, d: L.drain(L.stateful(_daily_stream(s, d), *L.page_cusum(66, 5, 40))))
query("stream_two_sample")(lambda s, d: L.drain(L.stateful(_daily_stream(s, d), *L.two_sample(7, 3))))
query("simulate")(lambda s, d: Z.add_noise(Z.spikes(Z.level_shift(Z.add_seasonality(Z.add_trend(Z.base(s, 3, 120), 0.5), 5, 7 * 86400), 60, 90, 20.0), [30], 4), 1.0))
query("level_shift_simulated", f"SELECT series_id, ts, round(value + CASE WHEN row_number() OVER {W} - 1 BETWEEN 5 AND 9 THEN 20 ELSE 0 END, 6) AS value FROM {{D}}")(lambda s, d: Z.level_shift(daily_events(s, d), 5, 10, 20.0))
query("trend_shift_simulated", f"SELECT series_id, ts, round(value + greatest(row_number() OVER {W} - 11, 0) * 1.5, 6) AS value FROM {{D}}")(lambda s, d: Z.trend_shift(daily_events(s, d), 10, 1.5))
query("metadata")(lambda s, d: A.metadata(daily_events(s, d), [("theta", {"period": 7}), ("naive", {}), ("linear", {})], ("basic", "gradient")))


def _selected(s, d):
    meta = A.metadata(daily_orders(s, d).withColumn(ID, F.concat_ws("/", ID, F.year(TS))), [("theta", {"period": 7}), ("naive", {}), ("linear", {})], ("basic", "gradient")).cache()
    return A.select_models(A.fit_selector(meta), meta.drop("best_model", "params", "err"))


query("model_selection")(_selected)


def _pooled(s, d):
    fitted, frame = A.pooled_lag_model(daily_events(s, d))
    return A.pooled_forecast(fitted, frame)


query("pooled_forecast")(_pooled)

# ---- residual detectors and further features ---------------------------------------------------------------------

query("forecast_detector")(lambda s, d: E.forecast_scores(E.in_sample(daily_events(s, d)), "z"))
query("forecast_deviation", "SELECT series_id, ts, round(y, 6) AS value, round(fcst, 6) AS fcst, round(coalesce((y - fcst) / nullif(abs(fcst), 0), 0), 6) + 0.0 AS score, y NOT BETWEEN fcst_lower AND fcst_upper AS outside FROM {F}")(lambda s, d: E.forecast_scores(naive_forecasts(s, d).withColumnRenamed("y", VALUE)))
query("forecast_residuals", "SELECT series_id, ts, round((y - fcst) / (fcst_upper - fcst_lower), 6) + 0.0 AS residual FROM {F} WHERE fcst_upper <> fcst_lower")(lambda s, d: E.residuals(daily_orders(s, d), naive_forecasts(s, d).drop("y"), True))
query("false_alarm_places")(lambda s, d: E.false_alarm_probability(D.rolling_detector(daily_events(s, d), 7), D.rolling_detector(daily_events(s, d), 7)))
query("trend_scores")(lambda s, d: E.trend_scores(daily_events(s, d), 5))
query("bocpd_trend")(lambda s, d: E.bocpd_trend(monthly_lineitem(s, d)))
query("one_sample_proportion")(lambda s, d: E.one_sample_proportion(s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.date_trunc("month", "l_shipdate").alias(TS)).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("value"), F.count("*").alias("sample_count")).select(F.lit("R").alias(ID), TS, "value", "sample_count", F.lit(0.3).alias("effect_size"))))
query(
    "percentage_change",
    """SELECT l_returnflag AS series_id, n0, n1, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m1 / m0, 6) AS ratio, round(100 * (m1 / m0 - 1), 6) + 0.0 AS perc_change, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) + 0.0 AS score FROM (
  SELECT l_returnflag, count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS n0, count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS n1, avg(l_quantity) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS m0, avg(l_quantity) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS m1,
    var_samp(l_quantity) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS v0, var_samp(l_quantity) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS v1 FROM lineitem GROUP BY 1)""",
)(
    lambda s, d: E.percentage_change(
        s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias(ID)).agg(*[f(F.when(c, F.col("l_quantity"))).alias(f"{k}{i}") for i, c in enumerate((F.col("l_shipdate") < "1998-01-01", F.col("l_shipdate") >= "1998-01-01")) for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    ).select(ID, "n0", "n1", "m0", "m1", "ratio", "perc_change", "score")
)
query("empirical_interval")(lambda s, d: P.empirical_interval(P.forecast(daily_events(s, d), "theta", 5).select(ID, "step", "fcst"), E.empirical_errors(daily_events(s, d), "theta", 5)))
query("bootstrap_interval")(lambda s, d: E.bootstrap_interval(daily_events(s, d), "theta", 5))
query("features_detectors")(lambda s, d: E.detector_features(daily_events(s, d)))
query("features_seasonality")(lambda s, d: E.seasonality_features(daily_orders(s, d)))
query("nowcast_frame", f"SELECT series_id, ts, round(value, 6) AS value, round(lead(value) OVER {W}, 6) AS label, round(lag(value, 1) OVER {W}, 6) AS lag_1, round(lag(value, 2) OVER {W}, 6) AS lag_2, round(lag(value, 3) OVER {W}, 6) AS lag_3, round((value - lag(value, 1) OVER {W}) / nullif(lag(value, 1) OVER {W}, 0), 6) + 0.0 AS roc_2, round((value - lag(value, 2) OVER {W}) / nullif(lag(value, 2) OVER {W}, 0), 6) + 0.0 AS roc_3, round(CASE WHEN count(*) OVER r2 >= 2 THEN avg(value) OVER r2 END, 6) AS ma_2, round(CASE WHEN count(*) OVER r3 >= 3 THEN avg(value) OVER r3 END, 6) AS ma_3 FROM {{D}} WINDOW r2 AS (PARTITION BY series_id ORDER BY ts ROWS 1 PRECEDING), r3 AS (PARTITION BY series_id ORDER BY ts ROWS 2 PRECEDING)")(
    lambda s, d: E.nowcast_frame(daily_events(s, d))
)
query("nowcast")(lambda s, d: E.nowcast(daily_events(s, d)))
query("search_random")(lambda s, d: G.search(daily_events(s, d), ["harmonic", "piecewise"], "random", 3))
query("search_halving")(lambda s, d: G.halving(daily_events(s, d), ["theta", "autoregression"]))
query("pipeline_of_steps", f"SELECT series_id, ts, round(value, 6) AS value, round(coalesce(CASE WHEN count(*) {_P7} >= 7 THEN CASE WHEN stddev_pop(value) {_P7} = 0 THEN 0 ELSE (value - avg(value) {_P7}) / stddev_pop(value) {_P7} END END, 0), 6) + 0.0 AS score FROM (SELECT * FROM {{D}} WHERE NOT ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06')")(
    lambda s, d: Pipeline([("cut", lambda x: S.exclude(x, "2024-01-05", "2024-01-06")), ("score", lambda x: D.rolling_detector(x, 7))]).run(daily_events(s, d))
)

query("last_points", "SELECT series_id, ts, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS r FROM {D}) WHERE r <= 5")(lambda s, d: S.last_n(daily_events(s, d), 5))
query("fill_missing", "SELECT k.series_id, k.ts, round(v.value, 6) AS value FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM {H} GROUP BY series_id) k LEFT JOIN {H} v USING (series_id, ts)")(lambda s, d: S.fill_missing(hourly_events(s, d), "1 hour"))
query("normalize_z", "SELECT series_id, ts, round((value - avg(value) OVER p) / stddev_pop(value) OVER p, 6) + 0.0 AS value, round(avg(value) OVER p, 6) AS center, round(stddev_pop(value) OVER p, 6) AS scale FROM {D} WINDOW p AS (PARTITION BY series_id)")(lambda s, d: S.normalize(daily_events(s, d), how="sub_div"))
query("denormalize", "SELECT series_id, ts, round(value, 6) AS value FROM {D}")(lambda s, d: S.denormalize(S.normalize(daily_events(s, d), "median")))
query("first_missing", "SELECT min(v) AS first_missing FROM (SELECT c_custkey + 1 AS v FROM customer UNION ALL SELECT 0) WHERE v NOT IN (SELECT c_custkey FROM customer)")(lambda s, d: S.first_missing(s.read.parquet(f"{d}/customer.parquet"), "c_custkey"))
query("top_deviations", "SELECT series_id, ts, round(value, 6) AS score, value NOT BETWEEN 30 AND 80 AS alert FROM {D} WHERE ts = TIMESTAMP '2024-01-10' ORDER BY value DESC, series_id LIMIT 2")(lambda s, d: D.top_anomalies(D.static_threshold(daily_events(s, d), 30, 80), "2024-01-10", 2))
query("top_trends")(lambda s, d: D.top_trends(D.mann_kendall(monthly_lineitem(s, d)), "1998-01-01", 2))
query("anomaly_times")(lambda s, d: D.anomaly_times(D.multivariate_anomaly(*_wide_events(s, d), 20), 0.1))
query("arrays", "SELECT series_id, len(list(value)) AS n, round(list_sum(list(value)), 6) AS total FROM {D} GROUP BY 1")(lambda s, d: S.to_arrays(daily_events(s, d)).select(ID, F.size("values").cast("bigint").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")))


def _round_trip(s, d, fmt):
    path = L.scratch(s, f"series-{fmt}")
    R.write_series(daily_events(s, d), path, fmt)
    return R.read_series(s, path, fmt, time=TS, values=[VALUE], key=ID)


for _fmt in ("csv", "json", "parquet", "orc"):
    query(f"sink_and_source_{_fmt}", "SELECT series_id, ts, round(value, 6) AS value FROM {D}")(lambda s, d, f=_fmt: _round_trip(s, d, f))

query(
    "macd",
    """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM {D}),
e AS (SELECT series_id, ts, i, value AS f, CAST(1 AS DOUBLE) AS fw, value AS g, CAST(1 AS DOUBLE) AS gw FROM n WHERE i = 1
  UNION ALL SELECT n.series_id, n.ts, n.i, e.f * (1 - 2 / 13.0) + n.value, e.fw * (1 - 2 / 13.0) + 1, e.g * (1 - 2 / 22.0) + n.value, e.gw * (1 - 2 / 22.0) + 1 FROM e JOIN n ON n.series_id = e.series_id AND n.i = e.i + 1),
m AS (SELECT series_id, ts, i, f / fw - g / gw AS macd FROM e),
s AS (SELECT series_id, i, macd AS s, CAST(1 AS DOUBLE) AS w, 1 AS k FROM m WHERE i = 20
  UNION ALL SELECT m.series_id, m.i, s.s * 0.8 + m.macd, s.w * 0.8 + 1, s.k + 1 FROM s JOIN m ON m.series_id = s.series_id AND m.i = s.i + 1)
SELECT m.series_id, m.ts, round(CASE WHEN m.i >= 20 THEN macd END, 6) + 0.0 AS macd, round(CASE WHEN s.k >= 8 THEN s.s / s.w END, 6) + 0.0 AS macd_signal FROM m LEFT JOIN s ON s.series_id = m.series_id AND s.i = m.i""",
)(lambda s, d: I.exploded(S.to_arrays(daily_events(s, d)), I.macd_arrays(F.col("values"))))
query(
    "rsi",
    """WITH RECURSIVE n AS (SELECT *, row_number() OVER w AS i, coalesce(value - lag(value) OVER w, 0) AS d FROM {D} WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
e AS (SELECT series_id, ts, i, CAST(0 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS l FROM n WHERE i = 1
  UNION ALL SELECT n.series_id, n.ts, n.i, e.g * (1 - 1 / 14.0) + greatest(n.d, 0) / 14.0, e.l * (1 - 1 / 14.0) + greatest(-n.d, 0) / 14.0 FROM e JOIN n ON n.series_id = e.series_id AND n.i = e.i + 1)
SELECT series_id, ts, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM e""",
)(lambda s, d: I.exploded(S.to_arrays(daily_events(s, d)), {"rsi": I.rsi_array(F.col("values"), 14)}))
query(
    "trix",
    """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM {D}),
e AS (SELECT series_id, ts, i, value AS a, CAST(1 AS DOUBLE) AS w, value AS b, value AS c, value AS t FROM n WHERE i = 1
  UNION ALL SELECT n.series_id, n.ts, n.i, e.a * (2 / 3.0) + n.value, e.w * (2 / 3.0) + 1, e.b * (2 / 3.0) + (e.a * (2 / 3.0) + n.value) / (e.w * (2 / 3.0) + 1),
    e.c * (2 / 3.0) + (e.b * (2 / 3.0) + (e.a * (2 / 3.0) + n.value) / (e.w * (2 / 3.0) + 1)) / (e.w * (2 / 3.0) + 1), (e.c * (2 / 3.0) + (e.b * (2 / 3.0) + (e.a * (2 / 3.0) + n.value) / (e.w * (2 / 3.0) + 1)) / (e.w * (2 / 3.0) + 1)) / (e.w * (2 / 3.0) + 1) FROM e JOIN n ON n.series_id = e.series_id AND n.i = e.i + 1)
SELECT series_id, ts, round(coalesce((t - lag(t) OVER w) / nullif(lag(t) OVER w, 0), 0), 6) + 0.0 AS trix FROM e WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
)(lambda s, d: I.exploded(S.to_arrays(daily_events(s, d)), {"trix": I.trix_array(F.col("values"), 5)}))

for _op, _sign in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    query(f"scalar_{_op}", f"SELECT series_id, ts, round(value {_sign} 2.5, 6) AS value FROM {{D}}")(lambda s, d, o=_op: S.combine_scalar(daily_events(s, d), o, 2.5))
query("melted", "SELECT series_id, ts, unnest(['y', 'fcst']) AS variable, round(unnest([y, fcst]), 6) AS value FROM {F}")(lambda s, d: S.melt(naive_forecasts(s, d), ["y", "fcst"]))
query("remapped", "SELECT series_id, ts, CASE series_id WHEN 'click' THEN 'tap' WHEN 'error' THEN 'fault' ELSE series_id END AS name, CASE dayofweek(ts) WHEN 0 THEN 7 ELSE dayofweek(ts) END AS weekday FROM {D}")(
    lambda s, d: daily_events(s, d).select(ID, TS, C.remap(F.col(ID), {"click": "tap", "error": "fault"}).alias("name"), C.remap(F.weekday(TS) + 1, {}).cast("bigint").alias("weekday"))
)
query("weekend_masks", "SELECT series_id, ts, isodow(ts) > 5 AS weekend_mask, isodow(ts) <= 5 AS workday_mask FROM {D}")(lambda s, d: daily_events(s, d).select(ID, TS, *[c.alias(n) for n, c in C.weekend_masks(F.col(TS)).items()]))
query("powers", "SELECT series_id, ts, round(pow(value, 2), 6) AS power_2, round(pow(value, 3), 6) AS power_3 FROM {D}")(lambda s, d: daily_events(s, d).select(ID, TS, *[c.alias(n) for n, c in C.powers(F.col(VALUE), 3).items()]))
query(
    "overall_severity",
    f"""SELECT series_id, count(*) AS alerts, round(sum(volume), 6) AS volume, round(sum(seconds), 6) AS duration, round(coalesce(sum(volume) / nullif(sum(seconds), 0), 0), 6) AS height, round(max(magnitude), 6) AS magnitude FROM (
  SELECT series_id, r, coalesce(sum(o * sec), 0) AS volume, coalesce(sum(sec), 0) AS seconds, max(o / 2) AS magnitude FROM (
  SELECT *, sum(f) OVER {W} AS r FROM (SELECT *, epoch(lead(ts) OVER {W}) - epoch(ts) AS sec, CASE WHEN hit = lag(hit) OVER {W} THEN 0 ELSE 1 END AS f FROM (
    SELECT *, CASE WHEN score > 2 THEN score - 2 WHEN score < -2 THEN -2 - score ELSE 0 END AS o, (score > 2 OR score < -2) AND ts >= min(ts) OVER (PARTITION BY series_id) + INTERVAL 1 SECOND AS hit FROM (
      SELECT series_id, ts, coalesce(CASE WHEN count(*) {_P7} >= 7 THEN CASE WHEN stddev_pop(value) {_P7} = 0 THEN 0 ELSE (value - avg(value) {_P7}) / stddev_pop(value) {_P7} END END, 0) AS score FROM {{D}})))) WHERE hit GROUP BY series_id, r) GROUP BY series_id""",
)(lambda s, d: D.overall_severity(D.alerts(D.rolling_detector(daily_events(s, d), 7))))
for _kind, _sql in (("proportion", "p * (1 - p) / n"), ("count", "p / n"), ("arrival", "p * p / n")):
    query(f"variance_{_kind}", f"SELECT series_id, ts, round({_sql}, 6) AS variance FROM (SELECT event_type AS series_id, date_trunc('day', ts) AS ts, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM events GROUP BY ALL)")(
        lambda s, d, k=_kind: s.read.parquet(f"{d}/events.parquet")
        .groupBy(F.col("event_type").alias(ID), F.date_trunc("day", "ts").alias(TS))
        .agg(F.avg(F.when(F.col("value") > 100, 1.0).otherwise(0.0)).alias("p"), F.count("*").alias("n"))
        .select(ID, TS, D.VARIANCE[k](F.col("p"), F.lit(0.0), F.col("n")).alias("variance"))
    )
