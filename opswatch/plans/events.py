"""Queries on events: envelopes, structured rows, semantic text, labels and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch import schemas
from opswatch.functions import anomaly_ratio, decide, rx, to_number
from opswatch.functions import tier as tier_of
from opswatch.operators.envelope import (
    parse_envelope,
    route_for_scoring,
    route_structured,
    semantic_rows,
    source_rows,
    union_sources,
)
from opswatch.operators.evaluation import binary_metrics, stage_counts
from opswatch.operators.features import fit_onehot, select_features
from opswatch.operators.labels import rule_labels
from opswatch.operators.normalize import classify_health, flatten_metrics, keep_metrics, tag_source
from opswatch.operators.quantiles import exact_percentile
from opswatch.plans.tables import (
    SQL_EVENTS,
    SQL_SOURCE,
    SQL_STRUCTURED,
    event_records,
    events,
    table,
)

_STRUCTURED = ", ".join(schemas.STRUCTURED_COLUMNS)
_KNOWN = "source_type <> 'mystery'"


def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_envelope(event_records(spark, sf_dir), keep=("event_id",))


def parse_envelopes(spark, sf_dir):
    return _envelope(spark, sf_dir).select("event_id", "source_type", "timestamp")


def structured_rows(spark, sf_dir):
    return route_structured(_envelope(spark, sf_dir), keep=("event_id",))


def structured_counts(spark, sf_dir):
    routed = route_structured(_envelope(spark, sf_dir))
    return routed.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("commit_email").alias("commits"),
        F.count("response_status").alias("accesses"),
        F.count("error_level").alias("web_errors"),
        F.count("value").alias("metrics"),
    )


def union_of_sources(spark, sf_dir):
    """Eight narrow frames united by name: the shape of the original, against one-pass routing."""
    envelope = _envelope(spark, sf_dir)
    united = union_sources(*[source_rows(envelope, s) for s in schemas.SOURCES])
    return united.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("log_message").alias("log_messages"),
        F.count("container_url").alias("container_urls"),
        F.count("username").alias("usernames"),
    )


def source_label_rates(spark, sf_dir):
    """Events and share of rule-labelled anomalies per source."""
    labelled = rule_labels(_envelope(spark, sf_dir)).where(
        F.col("source_type").isin(schemas.SOURCES)
    )
    return labelled.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("label").alias("anomalies"),
        F.round(F.avg("label"), 6).alias("anomaly_rate"),
    )


def labelled_events(spark, sf_dir):
    return rule_labels(_envelope(spark, sf_dir)).select("event_id", "label")


def bracketed_text(spark, sf_dir):
    """The web-error patterns on every whole document."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        rx(F.col("text"), r"\[(\w+)\]").alias("error_level"),
        rx(F.col("text"), r": (.*)").alias("error_detail"),
    )


def web_error_fields(spark, sf_dir):
    routed = route_structured(_envelope(spark, sf_dir), keep=("event_id",))
    return routed.where(F.col("source_type") == schemas.TEXT_SOURCE).select(
        "event_id", "error_level", "error_detail"
    )


_METRIC_NAMES = [*schemas.KEPT_METRICS, "node_cpu_seconds_total", "go_threads", "up"]


def _metric_samples(spark, sf_dir):
    k, value = F.col("k"), F.col("value")
    names = F.array(*[F.lit(n) for n in _METRIC_NAMES])
    return events(spark, sf_dir).select(
        "event_id",
        F.element_at(names, k % 12 + 1).alias("name"),
        F.lit("absolute").alias("kind"),
        F.struct(F.when(k % 3 == 0, value).alias("value")).alias("counter"),
        F.struct(F.when(k % 3 <= 1, value + 1).alias("value")).alias("gauge"),
        F.when(k % 4 == 0, F.create_map(F.lit("device"), F.concat(F.lit("eth"), k % 2)))
        .when(
            k % 4 == 1,
            F.create_map(F.lit("cpu"), (k % 8).cast("string"), F.lit("mode"), F.lit("idle")),
        )
        .alias("tags"),
    )


def metric_flatten(spark, sf_dir):
    return tag_source(
        flatten_metrics(keep_metrics(_metric_samples(spark, sf_dir))), "app_container_metrics"
    )


def health_classes(spark, sf_dir):
    k = F.col("k")
    probes = events(spark, sf_dir).select(
        "event_id",
        F.when(k % 5 == 0, "connection")
        .when(k % 5 == 1, "timeout")
        .when(k % 5 == 2, "other")
        .alias("error_kind"),
        F.when(k % 5 > 2, 150 + k * 4).alias("code"),
        F.col("event_type").alias("failure"),
    )
    return classify_health(probes, error="failure").select(
        "event_id", "status", "status_code", "value", "message"
    )


def semantic_texts(spark, sf_dir):
    return _semantic(spark, sf_dir, "native")


def semantic_texts_nested(spark, sf_dir):
    """Messages that hold nested values, booleans, fractions and repeated keys, as Python prints them."""
    k = F.col("k").cast("string")
    kinds = [
        F.concat(F.lit('{"ok": true, "n": {"k": '), k, F.lit(', "l": [1, "x"]}, "f": 1.50}')),
        F.concat(F.lit('{"id": '), k, F.lit(', "id": 1'), k, F.lit("}")),
        F.concat(F.lit('{"at_time": 1, "name": "plain", "n": '), k, F.lit("}")),
    ]
    inner = F.when(F.col("event_id") % 3 == 0, kinds[0]).when(F.col("event_id") % 3 == 1, kinds[1]).otherwise(kinds[2])
    record = F.to_json(F.struct(F.lit("s").alias("source_type"), inner.alias("message")))
    rows = events(spark, sf_dir).select("event_id", record.alias("json_str"))
    return semantic_rows(rows, mode="exact", keep=("event_id",)).select("event_id", "semantic_text")


def semantic_texts_exact(spark, sf_dir):
    return _semantic(spark, sf_dir, "exact")


def _semantic(spark, sf_dir, mode):
    rows = semantic_rows(event_records(spark, sf_dir), mode=mode, keep=("event_id",))
    return rows.drop("json_str")


def numeric_coerce(spark, sf_dir):
    k, value = F.col("k"), F.col("value")
    text = (
        F.when(k % 8 == 0, value.cast("string"))
        .when(k % 8 == 1, F.concat(F.lit("  "), value, F.lit(" ")))
        .when(k % 8 == 2, F.concat(k, F.lit("d")))
        .when(k % 8 == 3, F.concat(k, F.lit(".5f")))
        .when(k % 8 == 4, F.lit(""))
        .when(k % 8 == 5, F.col("event_type"))
        .when(k % 8 == 6, F.concat(k, F.lit("e2")))
    )
    return events(spark, sf_dir).select("event_id", to_number(text).alias("number"))


def scoring_features(spark, sf_dir):
    routed = route_for_scoring(_envelope(spark, sf_dir), keep=("event_id",))
    return routed.select(
        "event_id",
        "source_type",
        "response_status",
        "value",
        "request_time",
        "container_value",
        "commit_author",
        "commit_email",
        "action_conclusion",
        "event_name",
        "username",
        "log_level",
        "log_message",
        "error_detail",
    )


def feature_table(spark, sf_dir):
    routed = route_structured(_envelope(spark, sf_dir), keep=("event_id",))
    return select_features(routed, keep=("event_id",))


def onehot_vocab(spark, sf_dir):
    return fit_onehot(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


def structured_vocab(spark, sf_dir):
    """Vocabulary of the categorical features of all structured rows."""
    routed = select_features(route_structured(_envelope(spark, sf_dir)))
    columns = ["source_type", "log_level", "log_message", "commit_author", "device"]
    return fit_onehot(routed, columns)


def threshold_p975(spark, sf_dir):
    rows = exact_percentile(
        table(spark, sf_dir, "events"), "value", 0.975, ("event_type",), "threshold"
    )
    return rows.withColumn("threshold", F.round("threshold", 6))


def global_threshold(spark, sf_dir):
    rows = exact_percentile(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.975)
    return rows.select(F.round("percentile", 6).alias("threshold"))


def anomaly_tiers(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    limits = source.groupBy("event_type").agg(F.avg("value").alias("threshold"))
    ratio = anomaly_ratio(F.col("value"), F.col("threshold"))
    return source.join(limits, "event_type").select(
        "event_id",
        tier_of(ratio).alias("prediction"),
        decide(F.col("value"), F.col("threshold"), 2.0).alias("semantic_decision"),
        decide(F.col("value"), F.col("threshold")).alias("structured_decision"),
    )


def label_stage_counts(spark, sf_dir):
    stages = {
        "non_empty": F.length("text") > 0,
        "english": F.col("lang") == "en",
        "long_english": (F.col("lang") == "en") & (F.col("n_chars") > 1000),
    }
    return stage_counts(table(spark, sf_dir, "documents"), stages)


def event_rule_quality(spark, sf_dir):
    """Precision and recall of "value above 60" against the rule labels, per source."""
    records = event_records(spark, sf_dir, keep=("value",))
    labelled = rule_labels(parse_envelope(records, keep=("event_id", "value"))).where(
        F.col("source_type").isin(schemas.SOURCES)
    )
    said = labelled.withColumn("predicted", (F.col("value") > 60).cast("int"))
    found = binary_metrics(said, "label", "predicted", ["source_type"], "value")
    names = ("precision", "recall", "f1", "mean_mse")
    return found.select("source_type", *[F.round(n, 6).alias(n) for n in names])


QUERIES = {
    "parse_envelope": parse_envelopes,
    "route_structured": structured_rows,
    "route_structured_counts": structured_counts,
    "union_sources": union_of_sources,
    "source_label_rates": source_label_rates,
    "rule_labels": labelled_events,
    "regex_fields": bracketed_text,
    "web_error_fields": web_error_fields,
    "metric_flatten": metric_flatten,
    "health_classes": health_classes,
    "semantic_text": semantic_texts,
    "semantic_text_exact": semantic_texts_exact,
    "semantic_text_nested": semantic_texts_nested,
    "numeric_coerce": numeric_coerce,
    "route_for_scoring": scoring_features,
    "select_features": feature_table,
    "onehot_vocab": onehot_vocab,
    "structured_vocab": structured_vocab,
    "threshold_p975": threshold_p975,
    "threshold_global": global_threshold,
    "anomaly_tiers": anomaly_tiers,
    "stage_counts": label_stage_counts,
    "rule_quality": event_rule_quality,
}

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_NOT_JSON = "source_type = 'app_container_metrics' AND k = 98"

_SEMANTIC_SQL = f"""WITH {SQL_EVENTS},
s AS (SELECT *, {SQL_SOURCE} AS source_type FROM e)
SELECT event_id, CASE WHEN {_NOT_JSON} THEN NULL ELSE source_type END AS source_type,
       CASE WHEN {_NOT_JSON} THEN NULL ELSE {_ISO} END AS ingest_time,
  CASE
    WHEN {_NOT_JSON} THEN '[INVALID_JSON]'
    WHEN source_type = 'nginx_access' THEN
      'remote_addr=10.0.0.' || user_id || ' request_method=GET request_uri=/item/' || k
      || ' status=' || CASE WHEN k % 10 = 0 THEN '500' ELSE '200' END
      || ' body_bytes_sent=' || (user_id * 10) || ' http_user_agent=agent-' || (k % 3)
    WHEN source_type = 'fastapi_status' THEN
      'type=container_status name=fastapi_health status='
      || CASE WHEN k < 50 THEN 'running status_code=200' ELSE 'http_error status_code=503' END
      || ' url=http://fastapi-demo:8000 value=' || CASE WHEN k < 50 THEN '1.0' ELSE '0.5' END
      || ' message=Service answered ' || k
    WHEN source_type = 'app_container_log' THEN
      'level=' || CASE WHEN k < 50 THEN 'ERROR' ELSE 'WARNING' END
      || ' logger=main service_name=svc-' || (user_id % 20) || ' message=request ' || k
      || CASE WHEN k % 5 = 0 THEN ' unreachable' ELSE ' slow' END
    WHEN source_type = 'nginx_error' THEN
      {_ISO} || ' [' || CASE WHEN k < 50 THEN 'error' ELSE 'warn' END || '] 7#7: *' || k
      || ' failed'
    WHEN source_type = 'github_actions' THEN
      'type=github_action name=build event=push pipeline_file=flow-' || (k % 4)
      || ' build_branch=main status=completed'
      || CASE WHEN k % 3 = 0 THEN '' ELSE ' actor=user' || user_id END
      || ' conclusion=' || CASE WHEN k < 50 THEN 'success' ELSE 'failure' END
      || ' repository=shop/web'
    WHEN source_type = 'github_commits' THEN
      'type=github_commit author=user' || user_id || ' email=user' || user_id
      || '@example.org repository=shop/web'
    WHEN source_type = 'app_container_metrics' THEN
      'source_type=app_container_metrics name=node_load1 kind=absolute value='
      || CAST(value AS VARCHAR) || ' device=eth' || (k % 2)
    ELSE 'type=cloudtrail_event event_name=Call' || k || ' username=user' || user_id
      || ' event_source=logs.example.org'
  END AS semantic_text
FROM s"""

_LABEL = """CASE
    WHEN source_type = 'app_container_log' AND (k < 50 OR k % 5 = 0) THEN 1
    WHEN source_type = 'nginx_access' AND k % 10 = 0 THEN 1
    ELSE 0 END"""

_KEPT = ", ".join(f"'{n}'" for n in schemas.KEPT_METRICS)
_NAMES = ", ".join(f"'{n}'" for n in _METRIC_NAMES)

_FEATURES_SQL = ",\n".join(
    f"       CASE WHEN {c} IS NULL THEN 0.0 ELSE CAST({c} AS DOUBLE) END AS {c}"
    if c in schemas.NUMERIC_COLUMNS
    else f"       coalesce({c}, 'unknown') AS {c}"
    for c in schemas.NUMERIC_COLUMNS + schemas.CATEGORICAL_COLUMNS
)


def _vocab_sql(rows: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS \"column\", {c} AS value FROM {rows}" for c in columns
    )
    return (
        f'SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1'
        f" AS idx FROM ({parts})"
    )


ORACLES = {
    "parse_envelope": f"""WITH {SQL_EVENTS}, s AS (SELECT *, {SQL_SOURCE} AS source_type FROM e)
SELECT event_id, CASE WHEN {_NOT_JSON} THEN NULL ELSE source_type END AS source_type,
       CASE WHEN {_NOT_JSON} THEN NULL ELSE {_ISO} END AS timestamp
FROM s""",
    "route_structured": f"WITH {SQL_STRUCTURED} SELECT event_id, {_STRUCTURED} FROM r WHERE {_KNOWN}",
    "route_structured_counts": f"""WITH {SQL_STRUCTURED}
SELECT source_type, count(*) AS row_count, count(commit_email) AS commits,
       count(response_status) AS accesses, count(error_level) AS web_errors, count(value) AS metrics
FROM r WHERE {_KNOWN} GROUP BY source_type""",
    "union_sources": f"""WITH {SQL_STRUCTURED}
SELECT source_type, count(*) AS row_count, count(log_message) AS log_messages,
       count(container_url) AS container_urls, count(username) AS usernames
FROM r WHERE {_KNOWN} GROUP BY source_type""",
    "source_label_rates": f"""WITH {SQL_STRUCTURED}
SELECT source_type, count(*) AS row_count, CAST(sum({_LABEL}) AS BIGINT) AS anomalies,
       round(avg({_LABEL}), 6) AS anomaly_rate
FROM r WHERE {_KNOWN} GROUP BY source_type""",
    "rule_labels": f"""WITH {SQL_EVENTS}, s AS (SELECT *, {SQL_SOURCE} AS source_type FROM e)
SELECT event_id, {_LABEL} AS label FROM s""",
    "regex_fields": r"""SELECT doc_id, regexp_extract(text, '\[(\w+)\]', 1) AS error_level,
       regexp_extract(text, ': (.*)', 1) AS error_detail FROM documents""",
    "web_error_fields": f"""WITH {SQL_STRUCTURED}
SELECT event_id, error_level, error_detail FROM r WHERE source_type = 'nginx_error'""",
    "metric_flatten": f"""WITH {SQL_EVENTS},
m AS (SELECT *, list_extract([{_NAMES}], k % 12 + 1) AS name FROM e)
SELECT event_id, name, 'absolute' AS kind,
       CASE k % 3 WHEN 0 THEN value WHEN 1 THEN value + 1 END AS value,
       CASE WHEN k % 4 = 0 THEN 'eth' || (k % 2) END AS device,
       CASE WHEN k % 4 = 1 THEN CAST(k % 8 AS VARCHAR) END AS cpu,
       CASE WHEN k % 4 = 1 THEN 'idle' END AS mode,
       'app_container_metrics' AS source_type
FROM m WHERE name IN ({_KEPT})""",
    "health_classes": f"""WITH {SQL_EVENTS}, h AS (SELECT *, 150 + k * 4 AS code FROM e)
SELECT event_id,
  CASE WHEN k % 5 = 0 THEN 'connection_failed' WHEN k % 5 = 1 THEN 'timeout'
       WHEN k % 5 = 2 THEN 'critical_failure'
       WHEN code >= 200 AND code < 400 THEN 'running' ELSE 'http_error' END AS status,
  CASE WHEN k % 5 = 0 THEN 0 WHEN k % 5 = 1 THEN 408 WHEN k % 5 = 2 THEN 500 ELSE code END
    AS status_code,
  CAST(CASE WHEN k % 5 <= 2 THEN 0.0 WHEN code >= 200 AND code < 400 THEN 1.0 ELSE 0.5 END
    AS DOUBLE) AS value,
  CASE WHEN k % 5 = 0 THEN 'Service unreachable — connection failed'
       WHEN k % 5 = 1 THEN 'Service timed out — no response within 2 seconds'
       WHEN k % 5 = 2 THEN 'Unexpected exception occurred: ' || event_type
       WHEN code >= 200 AND code < 400
         THEN 'Service is healthy and responding with HTTP ' || code
       ELSE 'Service responded with error HTTP ' || code END AS message
FROM h""",
    "semantic_text": _SEMANTIC_SQL,
    "semantic_text_exact": _SEMANTIC_SQL,
    "semantic_text_nested": f"""WITH {SQL_EVENTS}
SELECT event_id, CASE event_id % 3
         WHEN 0 THEN 'ok=True n={{''k'': ' || k || ', ''l'': [1, ''x'']}} f=1.5'
         WHEN 1 THEN 'id=1' || k ELSE 'name=plain n=' || k END AS semantic_text
FROM e""",
    "numeric_coerce": f"""WITH {SQL_EVENTS}
SELECT event_id, CASE WHEN k % 8 <= 1 THEN value WHEN k % 8 = 6 THEN k * 100.0 ELSE 0.0 END
  ::DOUBLE AS number FROM e""",
    "route_for_scoring": f"""WITH {SQL_STRUCTURED},
bad AS (SELECT event_id, user_id, k, '' AS source_type FROM s WHERE {_NOT_JSON})
SELECT event_id, source_type,
  CASE WHEN response_status IS NULL THEN 0.0 ELSE CAST(response_status AS DOUBLE) END
    AS response_status,
  CASE WHEN container_value IS NULL THEN 0.0 ELSE CAST(container_value AS DOUBLE) END AS value,
  CASE WHEN request_time IS NULL THEN 0.0 ELSE CAST(request_time AS DOUBLE) END AS request_time,
  0.0::DOUBLE AS container_value, coalesce(commit_author, 'unknown') AS commit_author,
  'unknown' AS commit_email, coalesce(action_conclusion, 'unknown') AS action_conclusion,
  coalesce(event_name, 'unknown') AS event_name, coalesce(username, 'unknown') AS username,
  coalesce(log_level, 'unknown') AS log_level, coalesce(log_message, 'unknown') AS log_message,
  'unknown' AS error_detail
FROM r
UNION ALL
SELECT event_id, '', 0.0, 0.0, 0.0, 0.0, 'unknown', 'unknown', 'unknown', 'unknown', 'unknown',
  'unknown', 'unknown', 'unknown' FROM bad""",
    "select_features": f"""WITH {SQL_STRUCTURED}
SELECT event_id,
{_FEATURES_SQL}
FROM r WHERE {_KNOWN}""",
    "onehot_vocab": _vocab_sql("part", ["p_brand", "p_type"]),
    "structured_vocab": f"""WITH {SQL_STRUCTURED},
f AS (SELECT source_type, coalesce(log_level, 'unknown') AS log_level,
             coalesce(log_message, 'unknown') AS log_message,
             coalesce(commit_author, 'unknown') AS commit_author,
             coalesce(device, 'unknown') AS device FROM r WHERE {_KNOWN})
{_vocab_sql("f", ["source_type", "log_level", "log_message", "commit_author", "device"])}""",
    "threshold_p975": """SELECT event_type, round(quantile_cont(value, 0.975), 6) AS threshold
FROM events GROUP BY event_type""",
    "threshold_global": """SELECT round(quantile_cont(l_extendedprice, 0.975), 6) AS threshold
FROM lineitem""",
    "anomaly_tiers": """WITH t AS (SELECT event_type, avg(value) AS threshold FROM events GROUP BY 1)
SELECT event_id,
  CASE WHEN value / threshold > 2 THEN 'high_anomaly' WHEN value / threshold > 1
       THEN 'low_anomaly' ELSE 'normal' END AS prediction,
  CASE WHEN value > 2 * threshold THEN 1 ELSE 0 END AS semantic_decision,
  CASE WHEN value > threshold THEN 1 ELSE 0 END AS structured_decision
FROM events JOIN t USING (event_type)""",
    "stage_counts": """SELECT count(*) AS rows, count(*) FILTER (WHERE length(text) > 0) AS non_empty,
  count(*) FILTER (WHERE lang = 'en') AS english,
  count(*) FILTER (WHERE lang = 'en' AND n_chars > 1000) AS long_english
FROM documents""",
    "rule_quality": f"""WITH {SQL_STRUCTURED},
c AS (SELECT source_type, raw_value, {_LABEL} AS label,
             CASE WHEN raw_value > 60 THEN 1 ELSE 0 END AS said FROM r WHERE {_KNOWN}),
n AS (SELECT source_type, avg(raw_value) AS mean_mse,
             count(*) FILTER (WHERE label = 1 AND said = 1) AS tp,
             count(*) FILTER (WHERE label = 0 AND said = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND said = 0) AS fn FROM c GROUP BY 1)
SELECT source_type, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
       round(mean_mse, 6) AS mean_mse
FROM n""",
}
