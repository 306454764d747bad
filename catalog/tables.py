"""Queries: scans, filters, joins, buckets and counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import oracle as o
from catalog.registry import long, query, r6, text
from catalog.views import READING_ORDER, Views
from meterflow.constants import US_HOLIDAYS
from meterflow.functions import scalars
from meterflow.functions.calendar import calendar_features, holiday_flag, parse_timestamps
from meterflow.operators import joins, metrics, reports, resample, scaling, splits
from meterflow.operators.series import Series
from meterflow.plans.baseline import naive_forecast_report
from meterflow.session import shared_folder
from meterflow.sources.results import latest_predictions, upserted
from meterflow.sources.splits import explode_splits, split_documents
from meterflow.sources.upserts import KeyedTable

MEASURES = ("P", "Q", "V")
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(f"""WITH {o.LAGGED}, {o.BUILDINGS},
joined AS (
  SELECT primary_use, CAST((dayofweek(timestamp) + 6) % 7 AS BIGINT) AS weekday,
         meter_reading AS y, lag1 AS p
  FROM lagged LEFT JOIN buildings USING (building_id) WHERE pos > 1)
SELECT primary_use, weekday, COUNT(*) AS n, ROUND(SQRT(AVG((p - y) * (p - y))), 6) AS RMSE,
  ROUND(AVG(ABS(p - y)), 6) AS MAE, 
  ROUND(100 * AVG(CASE WHEN y <> 0 THEN ABS((p - y) / y) END), 4) AS MAPE,
  ROUND(1 - AVG((p - y) * (p - y)) / VAR_POP(y), 6) AS R2,
  ROUND(SQRT(AVG(POW(LN(1 + p) - LN(1 + y), 2))), 6) AS RMSLE
FROM joined GROUP BY 1, 2""")
def naive_forecast(v: Views):
    report = naive_forecast_report(v.readings(), v.buildings(), v.readings_layout())
    return report.select(
        "primary_use", long("weekday"), "n", r6("RMSE"), r6("MAE"),
        F.round("MAPE", 4).alias("MAPE"), r6("R2"), r6("RMSLE"),
    )


@query(f"""SELECT event_id, {STAMP.format('ts')} AS timestamp, value FROM events
WHERE event_type <> 'error'""")
def lenient_ts(v: Views):
    raw = v.table("events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "bad").otherwise(F.col("ts").cast("string"))
        .alias("timestamp"),
        "value",
    )
    return parse_timestamps(raw).select("event_id", text("timestamp"), "value")


@query(f"""SELECT id, {STAMP.format('timestamp')} AS timestamp, value FROM (
  SELECT event_id AS id, ts AS timestamp, value FROM events
  UNION ALL SELECT o_orderkey, o_orderdate, o_totalprice FROM orders)""")
def concat_sorted(v: Views):
    events = v.table("events").selectExpr("event_id AS id", "ts AS timestamp", "value")
    orders = v.table("orders").selectExpr(
        "o_totalprice AS value", "o_orderdate AS timestamp", "o_orderkey AS id"
    )
    both = events.unionByName(orders).orderBy("timestamp", "id")
    return both.select("id", text("timestamp"), "value")


@query("""SELECT c_custkey AS building_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'val'
  WHEN 'MACHINERY' THEN 'test' ELSE 'train' END AS split FROM customer""")
def split_from_json(v: Views):
    segment = F.col("c_mktsegment")
    ids = v.table("customer").select(
        F.col("c_custkey").alias("building_id"),
        F.when(segment == "BUILDING", "val").when(segment == "MACHINERY", "test")
        .otherwise("train").alias("split"),
    )
    return explode_splits(split_documents(ids))


@query("""SELECT c_name AS algorithm, c_acctbal AS RMSE, NULL::DOUBLE AS MAE,
  c_acctbal / 2 AS R2 FROM customer
UNION ALL SELECT s_name, s_acctbal, s_acctbal + 1, NULL FROM supplier""")
def metrics_union(v: Views):
    first = v.table("customer").selectExpr(
        "c_name AS algorithm", "c_acctbal AS RMSE", "c_acctbal / 2 AS R2")
    second = v.table("supplier").selectExpr(
        "s_name AS algorithm", "s_acctbal AS RMSE", "s_acctbal + 1 AS MAE")
    return first.unionByName(second, allowMissingColumns=True)


@query("""WITH latest AS (
  SELECT o_orderpriority AS p, MAX(date_trunc('month', o_orderdate)) AS run
  FROM orders GROUP BY 1)
SELECT o_orderpriority AS algorithm, o_orderkey AS row_id, o_totalprice AS y_true,
  GREATEST(o_totalprice - 250000, 0) AS y_pred
FROM orders JOIN latest ON o_orderpriority = p AND date_trunc('month', o_orderdate) = run""")
def predictions_latest(v: Views):
    wrapped = F.col("o_orderstatus") == "F"
    truth, guess = F.col("o_totalprice"), F.col("o_totalprice") - 250000
    artifacts = v.table("orders").select(
        F.col("o_orderpriority").alias("algorithm"),
        F.date_trunc("month", "o_orderdate").alias("run_ts"),
        F.col("o_orderkey").alias("row_id"),
        F.when(wrapped, F.struct(truth.alias("y_true"), guess.alias("y_pred"))).alias("payload"),
        F.when(~wrapped, truth).alias("y_true"),
        F.when(~wrapped, guess).alias("y_pred"),
    )
    return latest_predictions(artifacts).select("algorithm", "row_id", "y_true", "y_pred")


@query("""SELECT COALESCE(c_custkey, o_custkey) AS key, COALESCE(best, c_acctbal) AS value
FROM customer FULL JOIN (
  SELECT o_custkey, MAX(o_totalprice) AS best FROM orders
  WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey""")
def info_upsert(v: Views):
    old = v.table("customer").selectExpr("c_custkey AS key", "c_acctbal AS value")
    new = (
        v.table("orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("key"))
        .agg(F.max("o_totalprice").alias("value"))
    )
    return upserted(old, new, ["key"])


@query("""SELECT COALESCE(c_custkey, o_custkey) AS key, COALESCE(best, c_acctbal) AS value
FROM customer FULL JOIN (
  SELECT o_custkey, MAX(o_totalprice) AS best FROM orders
  WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey""")
def upsert_table(v: Views):
    """The same upsert into a table in the shared folder, read back."""
    table = KeyedTable(v.spark, f"{shared_folder(v.spark)}/keyed-{uuid.uuid4().hex}", ["key"])
    table.upsert(v.table("customer").selectExpr("c_custkey AS key", "c_acctbal AS value"))
    table.upsert(
        v.table("orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("key"))
        .agg(F.max("o_totalprice").alias("value")))
    return table.read()


@query("""WITH seen AS (SELECT DISTINCT o_orderdate AS d FROM orders WHERE o_orderstatus = 'F'),
placed AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS position FROM seen)
SELECT o_orderkey, position, (SELECT COUNT(*) FROM seen) AS size
FROM orders LEFT JOIN placed ON d = o_orderdate""")
def one_hot_positions(v: Views):
    """Places of a column of many values in a sparse vector, fitted on finished orders."""
    orders = v.table("orders")
    found, size = scaling.positioned(orders.where("o_orderstatus = 'F'"), orders, "o_orderdate")
    return found.select("o_orderkey", "position", F.lit(size).cast("long").alias("size"))


@query("SELECT event_id, user_id AS building_id, value FROM events WHERE event_type = 'view'")
def filter_meter(v: Views):
    rows = v.readings().where(F.col("meter") == "view")
    return rows.select("event_id", "building_id", F.col("meter_reading").alias("value"))


@query("""SELECT event_id, user_id AS building_id FROM events
WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_join_split(v: Views):
    ids = v.buildings().where("primary_use = 'BUILDING'")
    return joins.members_of(v.readings(), ids).select("event_id", "building_id")


@query(f"""WITH {o.HOUSEHOLD}
SELECT event_id, ROUND(P * 24150, 6) AS P, ROUND(Q * 24150, 6) AS Q, V * 460 AS V,
  ROUND(I * 52.5, 6) AS I FROM household""")
def rescale_units(v: Views):
    return scalars.rescale_units(v.household()).select(
        "event_id", r6("P"), r6("Q"), "V", r6("I"))


@query("""SELECT event_id, value FROM events
WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'""")
def day_slice(v: Views):
    return scalars.day_slice(v.household(), "2024-01-15").selectExpr("event_id", "P AS value")


@query("""SELECT CASE WHEN event_type = 'click' THEN value ELSE 0 END AS a,
  CASE WHEN event_type = 'view' THEN value ELSE 0 END AS b,
  CASE WHEN event_type NOT IN ('click', 'view') THEN value ELSE 0 END AS c, event_id
FROM events""")
def align_columns(v: Views):
    events = v.table("events")
    parts = [
        events.where("event_type = 'click'").selectExpr("event_id", "value AS a"),
        events.where("event_type = 'view'").selectExpr("value AS b", "event_id"),
        events.where("event_type NOT IN ('click', 'view')").selectExpr("event_id", "value AS c"),
    ]
    return scaling.align_columns(parts)


@query("""SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a'
  ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS RMSE FROM events""")
def coerce_numeric(v: Views):
    raw = v.table("events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
        .alias("RMSE"),
    )
    return scalars.numeric(raw, ["RMSE", "MAE"])


@query("""SELECT event_id,
  LEAST(GREATEST(value, 10), 60) AS clip,
  CASE WHEN value < 10 THEN 60 WHEN value > 60 THEN 10 ELSE value END AS swap,
  ROUND(CASE WHEN value < 10 THEN LEAST(60, 20 - value)
    WHEN value > 60 THEN GREATEST(10, 120 - value) ELSE value END, 6) AS mirror,
  ROUND(CASE WHEN value < 10 OR value > 60 THEN 10 + value % 50 ELSE value END, 6) AS wrap
FROM events""")
def bound_modes(v: Views):
    value = F.col("value")
    modes = {m: scalars.bounded(value, 10.0, 60.0, m) for m in ("clip", "swap", "mirror", "wrap")}
    return v.table("events").select(
        "event_id", "value", *[r6(column, m) for m, column in modes.items()]
    ).drop("value")


@query(f"""WITH {o.READINGS}, {o.BUILDINGS}
SELECT event_id, building_id, site_id, primary_use, square_feet
FROM readings LEFT JOIN buildings USING (building_id)""")
def join_buildings(v: Views):
    return joins.join_buildings(v.readings(), v.buildings()).select(
        "event_id", "building_id", "site_id", "primary_use", "square_feet")


@query(f"""WITH {o.READINGS}, {o.BUILDINGS}, {o.WEATHER}
SELECT event_id, readings.building_id, site_id, air_temperature, cloud_coverage,
  precip_depth_1_hr
FROM readings LEFT JOIN buildings USING (building_id)
LEFT JOIN (SELECT site_id AS s, timestamp AS h, air_temperature, cloud_coverage,
  precip_depth_1_hr FROM weather) w ON site_id = s AND date_trunc('hour', readings.timestamp) = h""")
def join_weather(v: Views):
    located = joins.join_buildings(v.readings(), v.buildings())
    return joins.join_weather(located, v.weather(), hourly=True).select(
        "event_id", "building_id", "site_id", "air_temperature", "cloud_coverage",
        "precip_depth_1_hr")


@query("""WITH l AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
SELECT event_id, o_orderkey FROM l JOIN r ON r.i = l.i + 5""")
def positional_join(v: Views):
    left = v.table("events").select("event_id", "ts")
    right = v.table("orders").select("o_orderkey", "o_orderdate")
    return joins.positional_join(
        left, Series((), ("ts", "event_id")).measure(left),
        right, Series((), ("o_orderdate", "o_orderkey")).measure(right),
        offset=5,
    ).select("event_id", "o_orderkey")


@query("""WITH pairs AS (
  SELECT vec_id AS left_id, LEAD(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS right_id
  FROM embeddings)
SELECT left_id, right_id, ROUND(list_distance(CAST(a.embedding AS DOUBLE[]),
  CAST(b.embedding AS DOUBLE[])), 6) AS distance
FROM pairs JOIN embeddings a ON a.vec_id = left_id JOIN embeddings b ON b.vec_id = right_id""")
def vector_distance_pairs(v: Views):
    vectors = v.table("embeddings")
    ids = vectors.select(F.col("vec_id").alias("left_id"), "label")
    layout = Series(["label"], ("left_id", "left_id")).measure(ids, few=True)
    pairs = layout.over(
        ids, lambda w, pos: {"right_id": F.lead("left_id").over(w)}, following=1
    ).where("right_id IS NOT NULL").drop("label")
    return joins.vector_distances(pairs, vectors, "vec_id", "embedding").select(
        "left_id", "right_id", r6("distance"))


@query("""SELECT algorithm, problem, CAST(run AS INTEGER) AS run
FROM (SELECT DISTINCT o_orderpriority AS algorithm FROM orders),
  (SELECT DISTINCT event_type AS problem FROM events), range(1, 4) t(run)""")
def param_grid(v: Views):
    axes = {
        "algorithm": scaling.categories(v.table("orders"), "o_orderpriority"),
        "problem": scaling.categories(v.table("events"), "event_type"),
        "run": [1, 2, 3],
    }
    return joins.param_grid(v.spark, axes)


def _bucket_sql(kind: str) -> str:
    return f"""SELECT {STAMP.format("time_bucket(INTERVAL '5 minutes', ts)")} AS timestamp,
  ROUND({kind}(value), 6) AS P, ROUND({kind}(value / 460), 6) AS Q,
  ROUND({kind}(CAST(event_id % 7 AS DOUBLE)), 6) AS V FROM events GROUP BY 1"""


def _bucketed(v: Views, job: resample.ResampleJob):
    out = resample.resample(v.household(), job, MEASURES)
    return out.select(text("timestamp"), *[r6(m) for m in MEASURES])


@query(_bucket_sql("AVG"))
def resample_mean(v: Views):
    return _bucketed(v, resample.ResampleJob("5T", "mean"))


@query(_bucket_sql("MAX"))
def resample_max(v: Views):
    return _bucketed(v, resample.ResampleJob("5T", "max"))


@query(" UNION ALL ".join(
    f"""SELECT '{name}' AS "interval", '{kind}' AS aggregation,
    {STAMP.format(f"time_bucket(INTERVAL '{width}', ts)")} AS timestamp,
    ROUND({function}(value), 6) AS P, ROUND({function}(value / 460), 6) AS Q,
    ROUND({function}(event_id % 7), 6) AS V FROM events GROUP BY 3"""
    for name, width in (("1T", "1 minute"), ("1h", "1 hour"), ("1D", "1 day"))
    for kind, function in (("mean", "AVG"), ("max", "MAX"))
))
def resample_multi(v: Views):
    jobs = resample.make_jobs(["1T", "1h", "1D"], include_max=True)
    out = resample.resample_all(v.household(), jobs, MEASURES)
    return out.select("interval", "aggregation", text("timestamp"), *[r6(m) for m in MEASURES])


@query("SELECT user_id AS building_id, COUNT(*) AS n FROM events GROUP BY 1")
def building_counts(v: Views):
    return splits.group_counts(v.readings())


@query("""SELECT COUNT(*) AS groups, MIN(n) AS min_n, MAX(n) AS max_n, ROUND(AVG(n), 6) AS mean_n
FROM (SELECT COUNT(*) AS n FROM events GROUP BY user_id)""")
def building_count_stats(v: Views):
    stats = splits.count_stats(splits.group_counts(v.readings()))
    return stats.select("groups", "min_n", "max_n", r6("mean_n"))


@query(f"""WITH {o.HOUSEHOLD}, m AS (SELECT P, Q, V, I FROM household)
SELECT a, b, ROUND(r, 6) AS r FROM (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CORR({a}, {b}) AS r FROM m"
    for i, a in enumerate("PQVI") for b in "PQVI"[i:]) + ")")
def corr_matrix(v: Views):
    return metrics.correlations(v.household(), list("PQVI")).select("a", "b", r6("r"))


@query("SELECT DISTINCT c_mktsegment AS primary_use FROM customer")
def distinct_uses(v: Views):
    return v.buildings().select("primary_use").distinct().orderBy("primary_use")


@query("""SELECT event_id, CAST(extract('minute' FROM ts) AS BIGINT) AS minute,
  CAST(extract('hour' FROM ts) AS BIGINT) AS hour,
  CAST(isodow(ts) - 1 AS BIGINT) AS weekday FROM events""")
def calendar_features_(v: Views):
    out = calendar_features(v.readings())
    return out.select("event_id", long("minute"), long("hour"), long("weekday"))


# The order dates lie 20 years before the listed holidays.
@query("""SELECT o_orderkey, CAST(strftime(o_orderdate + INTERVAL 240 MONTH, '%Y-%m-%d') IN (
""" + ", ".join(f"'{day}'" for day in US_HOLIDAYS)
    + ") AS BIGINT) AS is_holiday FROM orders")
def holiday_flag_(v: Views):
    shifted = v.table("orders").select(
        "o_orderkey", F.add_months("o_orderdate", 240).alias("timestamp"))
    return holiday_flag(shifted).select("o_orderkey", long("is_holiday"))


@query("""SELECT p_partkey, CASE WHEN position('Brand#17' IN p_brand) > 0 THEN 'seventeen'
  WHEN position('Brand#1' IN p_brand) > 0 THEN 'one'
  ELSE p_type END AS label FROM part""")
def label_from_name(v: Views):
    name = F.concat(F.lit("search_"), "p_type", F.lit("_"), "p_brand", F.lit(".csv"))
    labels = [("Brand#1", "one"), ("Brand#17", "seventeen")]
    return v.table("part").select(
        "p_partkey", reports.label_from_name(name, labels, F.col("p_type")).alias("label"))


@query("""SELECT c_custkey AS building_id, c_acctbal AS square_feet FROM customer
ORDER BY c_acctbal DESC, c_custkey LIMIT 100""")
def top_k_buildings(v: Views):
    return reports.largest(v.buildings(), "square_feet", "building_id", 100).select(
        "building_id", "square_feet")


@query(f"""WITH {o.BUILDINGS},
uses AS (SELECT primary_use, MIN(building_id) AS f FROM buildings GROUP BY 1),
picked AS (
  SELECT * FROM buildings
  QUALIFY row_number() OVER (PARTITION BY primary_use ORDER BY building_id)
    <= GREATEST(1, 50 // (SELECT COUNT(*) FROM uses)))
SELECT building_id, picked.primary_use FROM picked JOIN uses USING (primary_use)
ORDER BY f, building_id LIMIT 50""")
def diverse_buildings(v: Views):
    return reports.diverse(v.buildings(), "primary_use", "building_id", 50).select(
        "building_id", "primary_use")


@query(f"""WITH {o.BUILDINGS} SELECT building_id FROM buildings
ORDER BY md5('42:' || CAST(building_id AS VARCHAR)), building_id LIMIT 100""")
def sample_buildings(v: Views):
    return reports.seeded_sample(v.buildings(), "building_id", 100).select("building_id")


@query("""WITH indexed AS (
  SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos, COUNT(*) OVER () AS total
  FROM events)
SELECT event_id FROM indexed WHERE pos <= total // 100""")
def head_subset(v: Views):
    readings = v.readings()
    return splits.first_rows(
        readings, READING_ORDER, readings.count() // 100
    ).select("event_id")


@query("""SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events""")
def row_index(v: Views):
    return v.household_layout().positions(v.household(), "pos").select("event_id", "pos")


@query(f"""WITH {o.BUILDINGS} SELECT building_id,
  """ + ", ".join(
    f"CAST(primary_use = '{u}' AS DOUBLE) AS \"primary_use_{u}\""
    for u in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM buildings")
def one_hot(v: Views):
    buildings = v.buildings().select("building_id", "primary_use")
    return scaling.one_hot(buildings, "primary_use", scaling.categories(buildings, "primary_use"))
