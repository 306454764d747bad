"""The same queries as SQL. Views mirror ``catalog.views``."""

from __future__ import annotations

READINGS = """readings AS (
  SELECT event_id, user_id AS building_id, event_type AS meter, ts AS timestamp,
         value AS meter_reading
  FROM events)"""

BUILDINGS = """buildings AS (
  SELECT c_custkey AS building_id, CAST(c_nationkey AS BIGINT) AS site_id,
         c_mktsegment AS primary_use, c_acctbal AS square_feet
  FROM customer)"""

WEATHER = """weather AS (
  SELECT CAST(c_nationkey AS BIGINT) AS site_id, date_trunc('hour', ts) AS timestamp,
         ROUND(AVG(value), 6) AS air_temperature, MIN(value) AS cloud_coverage,
         MAX(value) AS precip_depth_1_hr
  FROM events JOIN customer ON user_id = c_custkey
  GROUP BY 1, 2)"""

HOUSEHOLD = """household AS (
  SELECT event_id, ts AS timestamp, value AS P, value / 460 AS Q,
         CAST(event_id % 7 AS DOUBLE) AS V, length(props) / 100 AS I
  FROM events),
indexed AS (
  SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS pos,
         COUNT(*) OVER () AS total
  FROM household)"""

LAGGED = READINGS + """,
lagged AS (
  SELECT *, LAG(meter_reading, 1) OVER w AS lag1, LAG(meter_reading, 2) OVER w AS lag2,
         LAG(meter_reading, 3) OVER w AS lag3,
         AVG(meter_reading) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roll_mean,
         STDDEV_POP(meter_reading) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roll_std,
         row_number() OVER w AS pos
  FROM readings
  WINDOW w AS (PARTITION BY building_id ORDER BY timestamp, event_id))"""

PREDICTIONS = LAGGED + """,
predictions AS (
  SELECT event_id AS row_id, 'lag1' AS model, meter_reading AS y_true,
         ROUND(lag1, 6) AS y_pred FROM lagged WHERE pos > 7
  UNION ALL
  SELECT event_id, 'roll3', meter_reading, ROUND((lag1 + lag2 + lag3) / 3, 6)
  FROM lagged WHERE pos > 7
  UNION ALL
  SELECT event_id, 'roll7', meter_reading, ROUND(roll_mean, 6) FROM lagged WHERE pos > 7)"""

TRIALS = """trials AS (
  SELECT o_orderpriority AS algorithm, o_orderkey AS trial_id, o_totalprice AS VAL_RMSE_orig,
         o_orderkey % 50 + 1 AS epochs_trained,
         (o_orderkey % 97) / 96 AS x0, (o_custkey % 89) / 88 AS x1,
         (o_orderkey % 83) / 82 AS x2, (o_custkey % 79) / 78 AS x3,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS eval_num
  FROM orders)"""

DECODED = """
  GREATEST(32, LEAST(512, CAST(TRUNC(32 + x0 * 480) AS INTEGER))) AS units,
  GREATEST(1, LEAST(4, CAST(TRUNC(1 + x1 * 3) AS INTEGER))) AS num_layers,
  GREATEST(3, LEAST(32, CAST(TRUNC(3 + x2 * 29) AS INTEGER))) AS seq,
  ROUND(0.005 + x3 * 0.015, 6) AS learning_rate"""

METRICS_RUNS = """metrics_runs AS (
  SELECT o_orderpriority AS Model,
         CASE WHEN NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
              THEN o_orderdate END AS timestamp,
         o_totalprice AS RMSE, o_totalprice / 2 AS MAE, o_orderkey
  FROM orders)"""

LATEST = METRICS_RUNS + """,
latest AS (
  SELECT * FROM metrics_runs
  QUALIFY row_number() OVER (PARTITION BY Model
    ORDER BY timestamp IS NULL DESC, timestamp DESC, o_orderkey DESC) = 1)"""

CURVE = TRIALS + """,
curve AS (
  SELECT algorithm, eval_num, MIN(VAL_RMSE_orig) OVER (
    PARTITION BY algorithm ORDER BY eval_num
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far
  FROM trials)"""

# Prefix sums of group sizes; each part is one run of the size-ordered list.
SPLITS = READINGS + """,
sized AS (
  SELECT building_id, COUNT(*) AS n FROM readings GROUP BY building_id),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY n DESC, building_id DESC) AS r,
         SUM(n) OVER (ORDER BY n DESC, building_id DESC) AS upto
  FROM sized),
goal AS (
  SELECT FLOOR(0.4 * COUNT(*)) AS train, FLOOR(0.2 * COUNT(*)) AS val,
         COUNT(*) - FLOOR(0.4 * COUNT(*)) - FLOOR(0.2 * COUNT(*)) AS test FROM readings),
end1 AS (SELECT MAX(r) AS r, MAX(upto) AS s FROM ranked, goal WHERE upto - n < train),
end2 AS (SELECT MAX(ranked.r) AS r, MAX(upto) AS s FROM ranked, goal, end1
         WHERE ranked.r > end1.r AND upto - n - end1.s < val),
end3 AS (SELECT MAX(ranked.r) AS r FROM ranked, goal, end2
         WHERE ranked.r > end2.r AND upto - n - end2.s < test),
splits AS (
  SELECT building_id, n, CASE WHEN ranked.r <= end1.r THEN 'train'
    WHEN ranked.r <= end2.r THEN 'val' WHEN ranked.r <= end3.r THEN 'test' END AS split
  FROM ranked, end1, end2, end3 WHERE ranked.r <= end3.r)"""
