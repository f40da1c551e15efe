"""The given tables, and the operational records that queries derive from them.

Every derived record is a function of its row, so the work of a query grows with its tables. The
``SQL_*`` texts state the same records on the raw columns for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``k`` taken out of ``props``."""
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def event_records(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``event_id, json_str``: all events as published records, with further columns carried along."""
    return envelopes(spread(events(spark, sf_dir)), keep)


SQL_EVENTS = """e AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events)"""


def _text(*parts) -> Column:
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(*columns)


def source_of() -> Column:
    """The source an event stands for; all eight occur, one is unknown."""
    kind, k = F.col("event_type"), F.col("k")
    return (
        F.when(kind == "click", F.when(k % 4 == 3, "fastapi_status").otherwise("nginx_access"))
        .when(kind == "error", F.when(k % 3 == 0, "nginx_error").otherwise("app_container_log"))
        .when(kind == "signup", F.when(k % 2 == 0, "github_actions").otherwise("github_commits"))
        .when(kind == "view", "app_container_metrics")
        .when(k == 97, "mystery")
        .otherwise("public_cloud")
    )


SQL_SOURCE = """CASE
    WHEN event_type = 'click' THEN
      CASE WHEN k % 4 = 3 THEN 'fastapi_status' ELSE 'nginx_access' END
    WHEN event_type = 'error' THEN
      CASE WHEN k % 3 = 0 THEN 'nginx_error' ELSE 'app_container_log' END
    WHEN event_type = 'signup' THEN
      CASE WHEN k % 2 = 0 THEN 'github_actions' ELSE 'github_commits' END
    WHEN event_type = 'view' THEN 'app_container_metrics'
    WHEN k = 97 THEN 'mystery'
    ELSE 'public_cloud' END"""


def envelopes(events_df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``event_id, json_str``: the JSON record a collector would publish for each event."""
    k, user, value = F.col("k"), F.col("user_id"), F.col("value")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    source = F.col("source_type")

    def record(**fields) -> Column:
        columns = [
            (F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in fields.items()
        ]
        return F.to_json(F.struct(*columns))

    message = (
        F.when(
            source == "nginx_access",
            record(
                time_local=iso,
                remote_addr=_text("10.0.0.", user),
                request_method="GET",
                request_uri=_text("/item/", k),
                status=F.when(k % 10 == 0, 500).otherwise(200),
                body_bytes_sent=user * 10,
                request_time=value,
                http_user_agent=_text("agent-", k % 3),
            ),
        )
        .when(
            source == "fastapi_status",
            record(
                type="container_status",
                name="fastapi_health",
                status=F.when(k < 50, "running").otherwise("http_error"),
                status_code=F.when(k < 50, 200).otherwise(503),
                url="http://fastapi-demo:8000",
                value=F.when(k < 50, 1.0).otherwise(0.5),
                timestamp=iso,
                message=_text("Service answered ", k),
            ),
        )
        .when(
            source == "app_container_log",
            record(
                time=iso,
                level=F.when(k < 50, "ERROR").otherwise("WARNING"),
                logger="main",
                service_name=_text("svc-", user % 20),
                message=_text("request ", k, F.when(k % 5 == 0, " unreachable").otherwise(" slow")),
            ),
        )
        .when(
            source == "nginx_error",
            _text(
                iso, " [", F.when(k < 50, "error").otherwise("warn"), "] 7#7: *", k, " failed"
            ),
        )
        .when(
            source == "github_actions",
            record(
                type="github_action",
                name="build",
                event="push",
                pipeline_file=_text("flow-", k % 4),
                build_branch="main",
                status="completed",
                actor=F.when(k % 3 == 0, F.lit(None)).otherwise(_text("user", user)),
                conclusion=F.when(k < 50, "success").otherwise("failure"),
                created_at=iso,
                repository="shop/web",
            ),
        )
        .when(
            source == "github_commits",
            record(
                type="github_commit",
                author=_text("user", user),
                email=_text("user", user, "@example.org"),
                date=iso,
                repository="shop/web",
            ),
        )
        .when(
            source != "app_container_metrics",
            record(
                type="cloudtrail_event",
                event_name=_text("Call", k),
                username=_text("user", user),
                event_source="logs.example.org",
            ),
        )
    )
    metric = record(
        source_type=source,
        timestamp=iso,
        name="node_load1",
        kind="absolute",
        value=value,
        device=_text("eth", k % 2),
    )
    enveloped = F.to_json(
        F.struct(source.alias("source_type"), iso.alias("timestamp"), message.alias("message"))
    )
    text = (
        F.when((source == "app_container_metrics") & (k == 98), "not json")
        .when(source == "app_container_metrics", metric)
        .otherwise(enveloped)
    )
    return events_df.withColumn("source_type", source_of()).select(
        "event_id", *keep, text.alias("json_str")
    )


# The structured columns of the same records, on the raw columns.
SQL_STRUCTURED = f"""{SQL_EVENTS},
s AS (SELECT *, {SQL_SOURCE} AS source_type FROM e),
r AS (
  SELECT event_id, ts, user_id, value AS raw_value, k, source_type,
    CASE source_type WHEN 'github_commits' THEN 'user' || user_id || '@example.org' END
      AS commit_email,
    CASE source_type WHEN 'github_commits' THEN 'user' || user_id END AS commit_author,
    CASE source_type WHEN 'github_commits' THEN 'shop/web' END AS commit_repository,
    CASE source_type WHEN 'github_actions' THEN 'push' END AS action_event,
    CASE source_type WHEN 'github_actions' THEN 'build' END AS action_name,
    CASE source_type WHEN 'github_actions' THEN 'flow-' || (k % 4) END AS action_pipeline_file,
    CASE source_type WHEN 'github_actions' THEN 'main' END AS action_build_branch,
    CASE source_type WHEN 'github_actions' THEN 'completed' END AS action_status,
    CASE source_type WHEN 'github_actions'
      THEN CASE WHEN k < 50 THEN 'success' ELSE 'failure' END END AS action_conclusion,
    CASE source_type WHEN 'github_actions' THEN 'shop/web' END AS action_repository,
    CASE source_type WHEN 'public_cloud' THEN 'Call' || k END AS event_name,
    CASE source_type WHEN 'public_cloud' THEN 'user' || user_id END AS username,
    CASE source_type WHEN 'app_container_metrics' THEN 'eth' || (k % 2) END AS device,
    CASE source_type WHEN 'app_container_metrics' THEN 'absolute' END AS kind,
    CASE source_type WHEN 'app_container_metrics' THEN 'node_load1' END AS name,
    CASE source_type WHEN 'app_container_metrics' THEN CAST(value AS VARCHAR) END AS value,
    CASE source_type WHEN 'app_container_log'
      THEN CASE WHEN k < 50 THEN 'ERROR' ELSE 'WARNING' END END AS log_level,
    CASE source_type WHEN 'app_container_log' THEN 'main' END AS logger_name,
    CASE source_type WHEN 'app_container_log'
      THEN 'request ' || k || CASE WHEN k % 5 = 0 THEN ' unreachable' ELSE ' slow' END END
      AS log_message,
    CASE source_type WHEN 'app_container_log' THEN 'svc-' || (user_id % 20) END AS service_name,
    CASE source_type WHEN 'fastapi_status' THEN 'fastapi_health' END AS container_name,
    CASE source_type WHEN 'fastapi_status'
      THEN CASE WHEN k < 50 THEN 'running' ELSE 'http_error' END END AS container_status,
    CASE source_type WHEN 'fastapi_status'
      THEN CASE WHEN k < 50 THEN '200' ELSE '503' END END AS container_status_code,
    CASE source_type WHEN 'fastapi_status' THEN 'http://fastapi-demo:8000' END AS container_url,
    CASE source_type WHEN 'fastapi_status'
      THEN CASE WHEN k < 50 THEN '1.0' ELSE '0.5' END END AS container_value,
    CASE source_type WHEN 'fastapi_status' THEN 'Service answered ' || k END AS container_message,
    CASE source_type WHEN 'nginx_access' THEN '10.0.0.' || user_id END AS client_ip,
    CASE source_type WHEN 'nginx_access' THEN 'GET' END AS request_method,
    CASE source_type WHEN 'nginx_access' THEN '/item/' || k END AS request_uri,
    CASE source_type WHEN 'nginx_access'
      THEN CASE WHEN k % 10 = 0 THEN '500' ELSE '200' END END AS response_status,
    CASE source_type WHEN 'nginx_access' THEN CAST(user_id * 10 AS VARCHAR) END AS body_bytes_sent,
    CASE source_type WHEN 'nginx_access' THEN CAST(value AS VARCHAR) END AS request_time,
    CASE source_type WHEN 'nginx_access' THEN 'agent-' || (k % 3) END AS user_agent,
    CASE source_type WHEN 'nginx_error'
      THEN CASE WHEN k < 50 THEN 'error' ELSE 'warn' END END AS error_level,
    CASE source_type WHEN 'nginx_error' THEN '*' || k || ' failed' END AS error_detail
  FROM s WHERE NOT (source_type = 'app_container_metrics' AND k = 98))"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as feedback: the text names a URL and a ``name=``, English pages are confirmed."""
    english = F.col("html").contains('lang="en"')
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("url="), "url", F.lit(" name=web_"), "page_id").alias("semantic_text"),
        F.when(english, "true").otherwise("false").alias("feedback_label"),
    )


def host_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts of ``http://`` pages as a service catalogue in text order."""
    host = F.regexp_extract("url", "^http://([^:/]+)", 1)
    hosts = table(spark, sf_dir, "pages").select(host.alias("service_name")).distinct()
    return hosts.where(F.col("service_name") != "").select(
        "service_name",
        F.substring_index("service_name", ".", -1).alias("domain"),
        F.lit("web").alias("system"),
        F.split("service_name", r"\.").alias("dependencies"),
        F.col("service_name").alias("ord"),
    )


SQL_PAGES = """hosts AS (
  SELECT DISTINCT regexp_extract(url, '^http://([^:/]+)', 1) AS h FROM pages
  WHERE regexp_extract(url, '^http://([^:/]+)', 1) <> ''),
p AS (
  SELECT page_id, 'url=' || url || ' name=web_' || page_id AS t,
         contains(html, 'lang="en"') AS confirmed,
         regexp_extract(url, 'http://([^:/]+)', 1) AS host
  FROM pages),
named AS (SELECT page_id, min(h) AS named FROM p JOIN hosts ON contains(t, h) GROUP BY page_id),
x AS (
  SELECT p.page_id, confirmed,
         CASE WHEN host <> '' THEN host WHEN named IS NOT NULL THEN named ELSE 'web' END AS service
  FROM p LEFT JOIN named USING (page_id))"""
