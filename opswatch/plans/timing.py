"""Queries on event times: counters, alerts, episodes and detection times.

Times are compared as microseconds since the epoch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from opswatch.functions import micros
from opswatch.operators.alerts import (
    alert_recovery,
    alert_states,
    counter_increase,
    counter_on_grid,
    counter_rate,
    evaluate_on_grid,
    rule_states,
    target_down,
)
from opswatch.operators.episodes import anomaly_episodes, first_detection, last_valid
from opswatch.operators.evaluation import (
    average_detection,
    parse_experiment_log,
    time_to_detect,
)
from opswatch.plans.tables import SQL_EVENTS, events, table

HOUR = 3600.0


def _us(df, **names):
    """Replace time columns by microseconds."""
    kept = [c for c in df.columns if c not in names.values()]
    return df.select(*kept, *[micros(F.col(c)).alias(n) for n, c in names.items()])


def increase_per_type(spark, sf_dir):
    """Event values as a restarting counter per type, 6 hours back."""
    found = counter_increase(table(spark, sf_dir, "events"), ["event_type"], window=6 * HOUR)
    return _us(found.withColumn("increase", F.round("increase", 4)), ts_us="ts")


def rate_per_user(spark, sf_dir):
    found = counter_rate(table(spark, sf_dir, "events"), ["user_id"], window=24 * HOUR)
    return _us(found.withColumn("rate", F.round("rate", 8)), ts_us="ts")


#: A minute's worth of the published settings (30 s back, every 5 s, for 5 s) is five hours here.
GRID = {"window": 6 * HOUR, "step": HOUR}


def counter_samples(events_df):
    """Event values as restarting counters, one per type and group of users."""
    group = (F.col("user_id") % 20).alias("instance")
    return events_df.select("event_type", group, "ts", "value", "k")


def grid_increase(spark, sf_dir):
    """Growth of each counter at every hour that has a sample in the six before it."""
    found = counter_on_grid(counter_samples(events(spark, sf_dir)), ["event_type", "instance"], **GRID)
    return _us(found.withColumn("increase", F.round("increase", 4)), ts_us="ts")


def alert_rules(spark, sf_dir):
    """The three alert rules end to end, each over its own kind of sample."""
    rows = counter_samples(events(spark, sf_dir))
    kind = F.col("event_type")
    up = rows.where(kind == "view").withColumn("value", (F.col("k") >= 30).cast("double"))
    found = rule_states(
        rows.where(kind == "click"), rows.where((kind == "error") & (F.col("k") % 2 == 0)), up, ["instance"], for_=HOUR, **GRID
    )
    return _us(found, ts_us="ts", active_since_us="active_since")


def down_targets(spark, sf_dir):
    up = events(spark, sf_dir).withColumn("up", (F.col("k") >= 30).cast("double"))
    found = target_down(up, ["event_type"], value="up", step=HOUR)
    return _us(found, ts_us="ts")


def _states(spark, sf_dir):
    """Hourly last value per type; the alert is "above 20 for two hours"."""
    grid = evaluate_on_grid(table(spark, sf_dir, "events"), ["event_type"], step=HOUR)
    return alert_states(
        grid, F.col("value") > 20, ["event_type"], for_=2 * HOUR, step=HOUR
    )


def hourly_states(spark, sf_dir):
    return _us(_states(spark, sf_dir), ts_us="ts", active_since_us="active_since")


def recoveries(spark, sf_dir):
    found = alert_recovery(_states(spark, sf_dir), ["event_type"], cooldown=3 * HOUR, step=HOUR)
    return _us(
        found,
        firing_us="firing_at",
        last_firing_us="last_firing_at",
        recovered_us="recovered_at",
    )


def _errors(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type") == "error")


def error_episodes(spark, sf_dir):
    found = anomaly_episodes(
        _errors(spark, sf_dir), gap=1800, grace=86_400, probe_start="2024-01-10 00:00:00"
    )
    return _us(
        found, first_us="first_anomaly", last_us="last_anomaly", recovered_us="recovered_at"
    )


def episodes_per_user(spark, sf_dir):
    found = anomaly_episodes(_errors(spark, sf_dir), ["user_id"], gap=12 * HOUR, grace=5)
    return _us(
        found, first_us="first_anomaly", last_us="last_anomaly", recovered_us="recovered_at"
    )


def last_error(spark, sf_dir):
    rows = _errors(spark, sf_dir).select("event_id", "user_id", "value", "ts")
    return _us(last_valid(rows, "ts"), ts_us="ts")


def last_error_per_user(spark, sf_dir):
    rows = _errors(spark, sf_dir).select("event_id", "user_id", "value", "ts")
    return _us(last_valid(rows, "ts", ["user_id"]), ts_us="ts")


def detection_after_signup(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    signups = source.where(F.col("event_type") == "signup").select(
        "user_id", F.col("ts").alias("injected_at")
    )
    found = first_detection(_errors(spark, sf_dir), signups, ["user_id"])
    return _us(found, injected_us="injected_at", detected_us="detected_at")


def _experiment_lines(spark, sf_dir):
    """Events as lines of one experiment log per user."""
    kind, even = F.col("event_type"), F.col("k") % 2 == 0
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    system = F.when(even, "prometheus_monitor").otherwise("AI_MONITOR")
    short = F.when(even, "prometheus").otherwise("ai")
    line = (
        F.when(kind == "signup", F.concat(F.lit("  INJECT_START  "), iso))
        .when(kind == "error", F.concat_ws(" ", system, F.concat(short, F.lit("_Detected")), iso))
        .when(kind == "purchase", F.concat_ws(" ", system, F.concat(short, F.lit("_recovered")), iso))
        .when(kind == "view", F.lit("   "))
        .otherwise(F.lit("noise"))
    )
    return events(spark, sf_dir).select(
        F.col("user_id").alias("experiment"), F.col("event_id").alias("ord"), line.alias("value")
    )


def experiment_log(spark, sf_dir):
    return _us(parse_experiment_log(_experiment_lines(spark, sf_dir)), ts_us="ts")


def detection_times(spark, sf_dir):
    return time_to_detect(parse_experiment_log(_experiment_lines(spark, sf_dir)))


def detection_average(spark, sf_dir):
    return average_detection(detection_times(spark, sf_dir))


QUERIES = {
    "counter_increase": increase_per_type,
    "counter_rate": rate_per_user,
    "counter_on_grid": grid_increase,
    "alert_rules": alert_rules,
    "target_down": down_targets,
    "alert_states": hourly_states,
    "alert_recovery": recoveries,
    "anomaly_episodes": error_episodes,
    "anomaly_episodes_keyed": episodes_per_user,
    "last_valid": last_error,
    "last_valid_keyed": last_error_per_user,
    "first_detection": detection_after_signup,
    "experiment_log": experiment_log,
    "detection_times": detection_times,
    "detection_avg": detection_average,
}


def _growth_sql(key: str, hours: int, out: str, digits: int, scale: str) -> str:
    span = hours * 3600 * 1_000_000
    return f"""WITH u AS (
  SELECT {key}, epoch_us(ts) AS t, max(value) AS v FROM events GROUP BY 1, 2),
d AS (SELECT *, lag(v) OVER w AS p FROM u WINDOW w AS (PARTITION BY {key} ORDER BY t)),
c AS (SELECT *, sum(CASE WHEN p IS NULL THEN 0.0 WHEN v < p THEN v ELSE v - p END)
        OVER (PARTITION BY {key} ORDER BY t) AS cum FROM d),
f AS (SELECT *, first_value(cum) OVER (PARTITION BY {key} ORDER BY t
        RANGE BETWEEN {span - 1} PRECEDING AND CURRENT ROW) AS base FROM c)
SELECT {key}, t AS ts_us, v AS value, round((cum - base){scale}, {digits}) AS {out} FROM f"""


def _grid_sql(n: str, where: str) -> str:
    """``g<n>(event_type, instance, t, value, increase)`` on the hours, by joining every hour with the samples of its range."""
    return f"""u{n} AS (
  SELECT event_type, user_id % 20 AS instance, epoch_us(ts) AS t, max(value) AS v FROM e WHERE {where} GROUP BY 1, 2, 3),
l{n} AS (SELECT *, lag(v) OVER (PARTITION BY event_type, instance ORDER BY t) AS p FROM u{n}),
c{n} AS (SELECT *, CASE WHEN p IS NULL THEN 0.0 WHEN v < p THEN v ELSE v - p END AS delta FROM l{n}),
at{n} AS (
  SELECT DISTINCT event_type, instance, (CAST(ceil(t / 3600000000) AS BIGINT) + h) * 3600000000 AS due
  FROM u{n} CROSS JOIN (SELECT unnest(range(6)) AS h) WHERE (CAST(ceil(t / 3600000000) AS BIGINT) + h) * 3600000000 < t + 21600000000),
g{n} AS (
  SELECT event_type, instance, due AS t, arg_max(v, c.t) AS value, sum(delta) - arg_min(delta, c.t) AS increase
  FROM at{n} JOIN c{n} c USING (event_type, instance) WHERE c.t > due - 21600000000 AND c.t <= due GROUP BY 1, 2, 3)"""


_RULES = f"""{SQL_EVENTS},
{_grid_sql("1", "event_type = 'click'")},
{_grid_sql("2", "event_type = 'error' AND k % 2 = 0")},
cond AS (
  SELECT 'HighCPUUsage' AS alert, instance, t, increase > 0 AS c FROM g1
  UNION ALL SELECT 'HighErrorRate', instance, t, increase / 21600.0 > 0 FROM g2
  UNION ALL SELECT 'ServiceDown', user_id % 20, CAST(ceil(epoch_us(ts) / 3600000000) AS BIGINT) * 3600000000, arg_max(k < 30, ts)
  FROM e WHERE event_type = 'view' GROUP BY 1, 2, 3),
o AS (SELECT *, lag(c) OVER w AS pc, lag(t) OVER w AS pt FROM cond WINDOW w AS (PARTITION BY alert, instance ORDER BY t)),
i AS (SELECT *, max(CASE WHEN pc IS NULL OR pc <> c OR t - pt > 3600000000 THEN t END)
        OVER (PARTITION BY alert, instance ORDER BY t) AS since FROM o),
st AS (SELECT alert, instance, t, CASE WHEN NOT c THEN 'inactive' WHEN t - since >= 3600000000 THEN 'firing' ELSE 'pending' END AS state,
              CASE WHEN c THEN since END AS active_since_us FROM i)"""

_GRID = """g AS (
  SELECT event_type, CAST(ceil(epoch_us(ts) / 3600000000) AS BIGINT) * 3600000000 AS t,
         arg_max(value, ts) AS value
  FROM events GROUP BY 1, 2)"""

_STATES = f"""{_GRID},
o AS (SELECT *, value > 20 AS c,
        lag(value > 20) OVER w AS pc, lag(t) OVER w AS pt
      FROM g WINDOW w AS (PARTITION BY event_type ORDER BY t)),
i AS (SELECT *, max(CASE WHEN pc IS NULL OR pc <> c OR t - pt > 3600000000 THEN t END)
        OVER (PARTITION BY event_type ORDER BY t) AS since FROM o),
st AS (SELECT event_type, t, value, CASE WHEN NOT c THEN 'inactive'
          WHEN t - since >= 7200000000 THEN 'firing' ELSE 'pending' END AS state,
          CASE WHEN c THEN since END AS active_since_us FROM i)"""


def _episodes_sql(key: str | None, gap: int, grace: int, probe: str | None) -> str:
    part = f"PARTITION BY {key}" if key else ""
    head = f"{key}, " if key else ""
    begun = f"epoch_us(TIMESTAMP '{probe}')" if probe else "0"
    return f"""WITH a AS (
  SELECT {head}epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
l AS (SELECT *, lag(t) OVER ({part} ORDER BY t) AS p FROM a),
n AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > {gap}000000 THEN 1 ELSE 0 END)
        OVER ({part} ORDER BY t) AS ep FROM l)
SELECT {head}min(t) AS first_us, max(t) AS last_us, count(*) AS anomalies,
       greatest(max(t) + {gap}000000, greatest({begun}, min(t)) + {grace}000000) AS recovered_us
FROM n GROUP BY {head}ep"""


_LINES = f"""{SQL_EVENTS},
l AS (
  SELECT user_id AS experiment, event_id AS ord, ts,
    CASE event_type WHEN 'signup' THEN NULL
      ELSE CASE WHEN k % 2 = 0 THEN 'PROMETHEUS_MONITOR' ELSE 'AI_MONITOR' END END AS system,
    CASE event_type WHEN 'signup' THEN 'inject_start'
      ELSE CASE WHEN k % 2 = 0 THEN 'prometheus_' ELSE 'ai_' END
        || CASE event_type WHEN 'error' THEN 'detected' ELSE 'recovered' END END AS event
  FROM e WHERE event_type IN ('signup', 'error', 'purchase'))"""


def _diff(a: str, b: str) -> str:
    # Half away from zero on the exact microseconds.
    d = f"(epoch_us({b}) - epoch_us({a}))"
    return f"(sign({d}) * ((abs({d}) + 500) // 1000)) / 1000.0"


_TIMES = f"""{_LINES},
m AS (SELECT experiment, max_by(ts, ord) FILTER (WHERE event = 'inject_start') AS i,
        max_by(ts, ord) FILTER (WHERE event = 'prometheus_detected') AS pd,
        max_by(ts, ord) FILTER (WHERE event = 'prometheus_recovered') AS pr,
        max_by(ts, ord) FILTER (WHERE event = 'ai_detected') AS ad,
        max_by(ts, ord) FILTER (WHERE event = 'ai_recovered') AS ar
      FROM l GROUP BY experiment),
s AS (SELECT experiment, 'Traditional Monitoring' AS system, i, pd AS d, pr AS r FROM m
      UNION ALL
      SELECT experiment, 'Machine Learning-based Monitoring', i, ad, ar FROM m),
times AS (
  SELECT experiment, system,
    CASE WHEN d IS NOT NULL AND r IS NOT NULL THEN {_diff("i", "d")} END AS "MTTD",
    CASE WHEN d IS NOT NULL AND r IS NOT NULL THEN {_diff("d", "r")} END AS "MTTR",
    CASE WHEN d IS NOT NULL AND r IS NOT NULL THEN {_diff("i", "r")} END AS "MTTResolve"
  FROM s WHERE i IS NOT NULL)"""

ORACLES = {
    "counter_increase": _growth_sql("event_type", 6, "increase", 4, ""),
    "counter_rate": _growth_sql("user_id", 24, "rate", 8, " / 86400.0"),
    "counter_on_grid": f"""WITH {SQL_EVENTS},
{_grid_sql("1", "true")}
SELECT event_type, instance, t AS ts_us, value, round(increase, 4) AS increase FROM g1""",
    "alert_rules": f"WITH {_RULES} SELECT alert, instance, t AS ts_us, state, active_since_us FROM st",
    "target_down": f"""WITH {SQL_EVENTS}
SELECT event_type, CAST(ceil(epoch_us(ts) / 3600000000) AS BIGINT) * 3600000000 AS ts_us,
       CAST(arg_max(CASE WHEN k >= 30 THEN 1 ELSE 0 END, ts) AS DOUBLE) AS up,
       arg_max(k < 30, ts) AS down
FROM e GROUP BY 1, 2""",
    "alert_states": f"WITH {_STATES} SELECT event_type, t AS ts_us, value, state, active_since_us FROM st",
    "alert_recovery": f"""WITH {_STATES},
b AS (SELECT event_type, t, state = 'firing' AS f FROM st),
q AS (SELECT *, lag(f) OVER (PARTITION BY event_type ORDER BY t) AS pf FROM b),
r AS (SELECT *, sum(CASE WHEN pf IS NULL OR pf <> f THEN 1 ELSE 0 END)
        OVER (PARTITION BY event_type ORDER BY t) AS run FROM q),
runs AS (SELECT event_type, run, f, min(t) AS a, max(t) AS z, count(*) AS n
         FROM r GROUP BY event_type, run, f),
ep AS (SELECT *, count(*) FILTER (WHERE NOT f AND n >= 3) OVER (PARTITION BY event_type ORDER BY run
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM runs)
SELECT event_type, min(a) FILTER (WHERE f) AS firing_us, max(z) FILTER (WHERE f) AS last_firing_us,
       min(a) FILTER (WHERE NOT f AND n >= 3) + 2 * 3600000000 AS recovered_us
FROM ep GROUP BY event_type, e HAVING count(*) FILTER (WHERE f) > 0""",
    "anomaly_episodes": _episodes_sql(None, 1800, 86400, "2024-01-10 00:00:00"),
    "anomaly_episodes_keyed": _episodes_sql("user_id", 43200, 5, None),
    "last_valid": """SELECT event_id, user_id, value, epoch_us(ts) AS ts_us FROM events
WHERE event_type = 'error' ORDER BY ts DESC LIMIT 1""",
    "last_valid_keyed": """SELECT event_id, user_id, value, epoch_us(ts) AS ts_us FROM events
WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""",
    "first_detection": """SELECT s.user_id, epoch_us(s.ts) AS injected_us,
       epoch_us(min(x.ts)) AS detected_us
FROM events s LEFT JOIN events x
  ON x.user_id = s.user_id AND x.event_type = 'error' AND x.ts >= s.ts
WHERE s.event_type = 'signup' GROUP BY s.user_id, s.ts""",
    "experiment_log": f"""WITH {_LINES}
SELECT experiment, CAST(ord AS BIGINT) AS ord, system, event, epoch_us(ts) AS ts_us FROM l""",
    "detection_times": f'WITH {_TIMES} SELECT experiment, system, "MTTD", "MTTR", "MTTResolve" FROM times',
    "detection_avg": f"""WITH {_TIMES}
SELECT system, coalesce(round(avg("MTTD"), 3), 0.0) AS "MTTD",
       coalesce(round(avg("MTTR"), 3), 0.0) AS "MTTR",
       coalesce(round(avg("MTTResolve"), 3), 0.0) AS "MTTResolve"
FROM times GROUP BY system""",
}
