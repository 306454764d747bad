"""Queries: windows, splits, scaling and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as o
from catalog.registry import long, query, r6, text
from catalog.views import READING_ORDER, Views
from meterflow.operators import joins, scaling, splits, windows
from meterflow.operators.series import Series
from meterflow.plans import household, preprocess
from meterflow.session import shared_folder
from meterflow.sources import splits as saved_splits

STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
LAST = ("event_id", "hour")


@query(f"""WITH {o.LAGGED}, stepped AS (
  SELECT *, LAG(event_id) OVER w AS last_event_id, LAG(hour(timestamp)) OVER w AS last_hour
  FROM lagged WINDOW w AS (PARTITION BY building_id ORDER BY timestamp, event_id))
SELECT event_id, lag1, lag2, lag3, last_event_id, CAST(last_hour AS BIGINT) AS last_hour
FROM stepped WHERE pos > 7""")
def lag_features(v: Views):
    frame = v.readings().withColumn("hour", F.hour("timestamp"))
    out = windows.lag_features(frame, v.readings_layout(), "meter_reading", 7, LAST)
    return out.select("event_id", "lag1", "lag2", "lag3", "last_event_id", long("last_hour"))


@query(f"""WITH {o.LAGGED} SELECT event_id, ROUND(roll_mean, 6) AS roll_mean,
  ROUND(roll_std, 6) AS roll_std FROM lagged WHERE pos > 7""")
def rolling_stats(v: Views):
    out = windows.lag_features(v.readings(), v.readings_layout(), "meter_reading", 7)
    return out.select("event_id", r6("roll_mean"), r6("roll_std"))


@query("""SELECT event_id, ROUND(AVG(value) OVER (
  ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS moving_average
FROM events""")
def moving_average(v: Views):
    out = windows.moving_average(
        v.household().select("event_id", "timestamp", "P"), v.household_layout(), "P", 10)
    return out.select("event_id", r6("moving_average"))


@query("""SELECT event_id, ROUND(MEDIAN(value) OVER (
  ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS moving_median
FROM events""")
def moving_median(v: Views):
    """Pandas code over the one long series of the household, in runs of 2,000 rows."""
    rows = v.household().select("event_id", "timestamp", "P")

    def medians(frame):
        return frame[["event_id"]].assign(moving_median=frame["P"].rolling(10, min_periods=1).median())

    layout = Series((), READING_ORDER, 2000).measure(rows)
    out = layout.apply(rows, medians, "event_id long, moving_median double", preceding=9)
    return out.select("event_id", r6("moving_median"))


def _steps(columns: tuple[str, ...], length: int, over: str = "w") -> str:
    """SQL: the windows' elements, oldest step first."""
    cells = [
        f"LAG({c}, {length - step}) OVER {over}" for step in range(length) for c in columns
    ]
    return ", ".join(f"{cell} AS x{i + 1}" for i, cell in enumerate(cells))


@query(f"""WITH {o.HOUSEHOLD}, w AS (
  SELECT event_id, pos, total, P AS y1, LEAD(P) OVER w AS y2, {_steps(("P",), 7)},
    LAG(timestamp, 7) OVER w AS started FROM indexed WINDOW w AS (ORDER BY pos))
SELECT * EXCLUDE (pos, total, started), {STAMP.format("started")} AS window_start
FROM w WHERE pos > 7 AND pos < total""")
def sliding_1d(v: Views):
    frame = v.household().select("event_id", "timestamp", "P")
    out = windows.sliding_windows(frame, v.household_layout(), ["P"], 7, "timestamp", horizon=2)
    return out.select(
        "event_id", text("window_start"),
        *windows.unfold(windows.flat(), 7, "x"), *windows.unfold(F.col("y"), 2, "y"),
    )


PQV = ("P", "Q", "V")


def _pqv_windows(v: Views):
    frame = v.household().select("event_id", "timestamp", *PQV)
    return windows.sliding_windows(frame, v.household_layout(), PQV, 3, "timestamp")


def _rounded(columns, n: int, prefix: str = "x"):
    return [r6(F.col(f"{prefix}{i + 1}"), f"{prefix}{i + 1}") for i in range(n)]


@query(f"""WITH {o.HOUSEHOLD}, w AS (
  SELECT event_id, pos, P AS y1, {_steps(PQV, 3)} FROM indexed WINDOW w AS (ORDER BY pos))
SELECT event_id, y1, {", ".join(f"ROUND(x{i}, 6) AS x{i}" for i in range(1, 10))}
FROM w WHERE pos > 3""")
def sliding_2d_flat(v: Views):
    out = _pqv_windows(v).select(
        "event_id", F.get("y", F.lit(0)).alias("y1"), *windows.unfold(windows.flat(), 9, "x"))
    return out.select("event_id", "y1", *_rounded(out, 9))


@query(f"""WITH {o.HOUSEHOLD}, w AS (
  SELECT event_id, pos, P, Q, V, timestamp, {_steps(PQV, 3)}
  FROM indexed WINDOW w AS (ORDER BY pos)),
s AS (
  SELECT event_id, P AS y, 1 AS step, x1 AS f1, x2 AS f2, x3 AS f3 FROM w WHERE pos > 3
  UNION ALL SELECT event_id, P, 2, x4, x5, x6 FROM w WHERE pos > 3
  UNION ALL SELECT event_id, P, 3, x7, x8, x9 FROM w WHERE pos > 3)
SELECT event_id, y, CAST(step AS BIGINT) AS step, f1, ROUND(f2, 6) AS f2, f3 FROM s""")
def sliding_seq(v: Views):
    steps = _pqv_windows(v).select("event_id", F.get("y", F.lit(0)).alias("y"), F.posexplode("x"))
    return steps.select(
        "event_id", "y", (F.col("pos") + 1).cast("long").alias("step"),
        F.get("col", F.lit(0)).alias("f1"), r6(F.get("col", F.lit(1)), "f2"),
        F.get("col", F.lit(2)).alias("f3"))


@query(f"""WITH {o.HOUSEHOLD}, w AS (
  SELECT event_id, pos, {_steps(("P", "Q"), 3)} FROM indexed WINDOW w AS (ORDER BY pos))
SELECT event_id, {", ".join(f"ROUND(x{i}, 6) AS x{i}" for i in range(1, 7))}
FROM w WHERE pos > 3""")
def window_feature_subset(v: Views):
    first = _pqv_windows(v).withColumn("x", windows.first_features(F.col("x"), 2))
    out = first.select("event_id", *windows.unfold(windows.flat(), 6, "x"))
    return out.select("event_id", *_rounded(out, 6))


@query(f"""WITH {o.READINGS}, w AS (
  SELECT event_id, building_id, meter_reading AS y, row_number() OVER w AS pos,
    {_steps(("meter_reading", "hour(timestamp)"), 5)}
  FROM readings WINDOW w AS (PARTITION BY building_id ORDER BY timestamp, event_id))
SELECT event_id, building_id, y, {", ".join(f"CAST(x{i} AS DOUBLE) AS x{i}" for i in range(1, 11))}
FROM w WHERE pos > 5""")
def group_windows(v: Views):
    frame = v.readings().withColumn("hour", F.hour("timestamp"))
    out = windows.sliding_windows(
        frame, v.readings_layout(), ["meter_reading", "hour"], 5, "timestamp")
    return out.select(
        "event_id", "building_id", F.get("y", F.lit(0)).alias("y"),
        *windows.unfold(windows.flat(), 10, "x"))


def _cut_sql(case: str) -> str:
    return f"WITH {o.HOUSEHOLD} SELECT event_id, {case} AS split FROM indexed"


def _cut(v: Views, option: int):
    return splits.cut_by_position(
        v.household(), READING_ORDER, option=option
    ).select("event_id", "split")


TRAIN = "FLOOR(CAST(0.8 AS DOUBLE) * total)"
VAL = "FLOOR(CAST(0.8 AS DOUBLE) * CAST(0.3 AS DOUBLE) * total)"
FIT = "FLOOR((CAST(0.8 AS DOUBLE) - CAST(0.8 AS DOUBLE) * CAST(0.3 AS DOUBLE)) * total)"
THREE_WAY = f"CASE WHEN pos <= {FIT} THEN 'train' WHEN pos <= {FIT} + {VAL} THEN 'val' ELSE 'test' END"


@query(_cut_sql(f"CASE WHEN pos <= {TRAIN} THEN 'train' ELSE 'test' END"))
def sequential_split(v: Views):
    return _cut(v, 2)


@query(_cut_sql(THREE_WAY))
def sequential_split_3(v: Views):
    return _cut(v, 3)


@query(_cut_sql(f"""CASE WHEN pos <= LEAST(720, {TRAIN}) THEN 'lookback'
  WHEN pos <= {TRAIN} THEN 'train' ELSE 'test' END"""))
def lookback_split(v: Views):
    return _cut(v, 1)


@query(f"WITH {o.SPLITS} SELECT building_id, split, CAST(n AS BIGINT) AS n FROM splits")
def disjoint_split(v: Views):
    return preprocess.assign_splits(v.readings())


@query(f"WITH {o.SPLITS} SELECT building_id, split FROM splits")
def persisted_split(v: Views):
    """The same split written to the shared folder, found there again by its fingerprint and read back."""
    counts, folder = splits.group_counts(v.readings()), f"{shared_folder(v.spark)}/splits"
    saved_splits.persisted_split(counts, folder)
    return saved_splits.persisted_split(counts, folder).select("building_id", "split")


@query(f"""WITH {o.SPLITS} SELECT event_id, split FROM readings JOIN splits USING (building_id)
WHERE split IN ('train', 'val')""")
def union_splits(v: Views):
    tagged = splits.tag_splits(v.readings(), preprocess.assign_splits(v.readings()))
    return splits.only_splits(tagged, "train", "val").select("event_id", "split")


# The columns below are fitted on clicks and applied to every reading.
LOCATED = f"""{o.READINGS}, {o.BUILDINGS}, {o.WEATHER},
located AS (
  SELECT event_id, meter, meter_reading, square_feet, air_temperature
  FROM readings LEFT JOIN buildings USING (building_id)
  LEFT JOIN (SELECT site_id AS s, timestamp AS h, air_temperature FROM weather)
    ON site_id = s AND date_trunc('hour', readings.timestamp) = h)"""


def _located(v: Views):
    located = joins.join_buildings(v.readings(), v.buildings())
    return joins.join_weather(located, v.weather(), hourly=True).select(
        "event_id", "meter", "meter_reading", "square_feet", "air_temperature")


@query(f"""WITH {LOCATED}, m AS (SELECT AVG(square_feet) AS a, AVG(air_temperature) AS b
  FROM located WHERE meter = 'click')
SELECT event_id, ROUND(COALESCE(square_feet, a, 0), 6) AS square_feet,
  ROUND(COALESCE(air_temperature, b, 0), 6) AS air_temperature FROM located, m""")
def impute_mean(v: Views):
    rows, columns = _located(v), ["square_feet", "air_temperature"]
    stats = scaling.ColumnStats.fit(rows.where("meter = 'click'"), columns)
    return stats.impute(rows).select("event_id", *[r6(c) for c in columns])


SCALES = """f AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events
  WHERE event_type = 'click')"""


@query(f"""WITH {SCALES} SELECT event_id, ROUND((value - lo) / (hi - lo), 6) AS meter_reading,
  CAST(0 AS DOUBLE) AS constant FROM events, f""")
def minmax_scale(v: Views):
    rows = v.readings().withColumn("constant", F.lit(5.0))
    columns = ["meter_reading", "constant"]
    stats = scaling.ColumnStats.fit(rows.where("meter = 'click'"), columns)
    return stats.scale(rows).select("event_id", r6("meter_reading"), "constant")


@query("SELECT event_id, ROUND(value, 6) AS meter_reading FROM events")
def inverse_scale(v: Views):
    rows = v.readings()
    stats = scaling.ColumnStats.fit(rows.where("meter = 'click'"), ["meter_reading"])
    scaled = stats.scale(rows)
    return scaled.select("event_id", r6(stats.restored("meter_reading"), "meter_reading"))


USES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
NUMERIC = (
    "site_id", "square_feet", "air_temperature", "cloud_coverage", "precip_depth_1_hr",
    "hour", "weekday", "is_holiday",
)
FEATURES = f"""{o.SPLITS}, {o.BUILDINGS}, {o.WEATHER},
prepared AS (
  SELECT event_id, split, meter_reading AS y, site_id, square_feet, air_temperature,
    cloud_coverage, precip_depth_1_hr, hour(readings.timestamp) AS hour,
    isodow(readings.timestamp) - 1 AS weekday, 0 AS is_holiday,
    {", ".join(f"COALESCE(CAST(primary_use = '{u}' AS DOUBLE), 0) AS primary_use_{u}" for u in USES)}
  FROM readings JOIN splits USING (building_id) LEFT JOIN buildings USING (building_id)
  LEFT JOIN (SELECT site_id AS s, timestamp AS h, air_temperature, cloud_coverage,
    precip_depth_1_hr FROM weather) ON site_id = s AND date_trunc('hour', readings.timestamp) = h)"""


def _prepared(v: Views):
    return preprocess.prepare(
        v.readings(), v.buildings(), v.weather(), preprocess.assign_splits(v.readings()),
        hourly_weather=True,
        uses=scaling.categories(v.buildings(), "primary_use"),
    )


@query(f"""WITH {FEATURES} SELECT event_id, split, y,
  {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)},
  {", ".join(f"primary_use_{u}" for u in USES)} FROM prepared""")
def prepared_features(v: Views):
    done = _prepared(v)
    return done.frame.select(
        "event_id", "split", "y",
        *[F.col(c).cast("double").alias(c) for c in done.numeric], *done.dummies)


@query(f"""WITH {FEATURES}, fit AS (SELECT {", ".join(
    f"COALESCE(AVG({c}), 0) AS m_{c}, COALESCE(MIN({c}), 0) AS l_{c}, "
    f"COALESCE(MAX({c}), 0) AS h_{c}" for c in (*NUMERIC, "y"))}
  FROM prepared WHERE split = 'train')
SELECT event_id, split, {", ".join(
    f"ROUND((COALESCE({c}, m_{c}) - l_{c}) / CASE WHEN h_{c} = l_{c} THEN 1 "
    f"ELSE h_{c} - l_{c} END, 6) AS {c}" for c in (*NUMERIC, "y"))},
  {", ".join(f"primary_use_{u}" for u in USES)} FROM prepared, fit""")
def preprocess_full(v: Views):
    done = preprocess.finish(_prepared(v))
    return done.frame.select(
        "event_id", "split", *[r6(c) for c in done.numeric], r6("y"), *done.dummies)


HOUSE = ("P", "Q", "V", "minute", "weekday", "hour")


@query(f"""WITH {o.HOUSEHOLD}, parts AS (
  SELECT *, {THREE_WAY} AS split, minute(timestamp) AS minute,
    isodow(timestamp) - 1 AS weekday, hour(timestamp) AS hour FROM indexed),
fit AS (SELECT {", ".join(f"MIN({c}) AS l_{c}, MAX({c}) AS h_{c}" for c in HOUSE)}
  FROM parts WHERE split = 'train'),
scaled AS (SELECT event_id, split, pos, {", ".join(
    f"({c} - l_{c}) / (h_{c} - l_{c}) AS {c}" for c in HOUSE)} FROM parts, fit),
w AS (SELECT event_id, split, P AS y, row_number() OVER w AS place, {_steps(HOUSE, 3)}
  FROM scaled WINDOW w AS (PARTITION BY split ORDER BY pos))
SELECT event_id, split, ROUND(y, 6) AS y,
  {", ".join(f"ROUND(x{i}, 6) AS x{i}" for i in range(1, 19))} FROM w WHERE place > 3""")
def household_dataset(v: Views):
    data = household.household_data(v.household(), option=3, length=3)
    out = data.windows.select(
        "event_id", "split", r6(F.get("y", F.lit(0)), "y"),
        *windows.unfold(windows.flat(), 18, "x"))
    return out.select("event_id", "split", "y", *_rounded(out, 18))
