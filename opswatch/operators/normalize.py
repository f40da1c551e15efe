"""Raw collector records to flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch import schemas


def tag_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("source_type", F.lit(name))


def keep_metrics(df: DataFrame, names: Sequence[str] = tuple(schemas.KEPT_METRICS)) -> DataFrame:
    return df.where(F.col("name").isin(list(names)))


def flatten_metrics(df: DataFrame) -> DataFrame:
    """Counter (else gauge) as ``value``; the device tag, else the cpu and mode tags."""
    device = F.col("tags")["device"]
    nested = {"counter", "gauge", "tags"}
    plain = [c for c in df.columns if c not in nested | {"value", "device", "cpu", "mode"}]
    return df.select(
        *plain,
        F.coalesce("counter.value", "gauge.value").alias("value"),
        device.alias("device"),
        F.when(device.isNull(), F.col("tags")["cpu"]).alias("cpu"),
        F.when(device.isNull() & F.col("tags")["cpu"].isNotNull(), F.col("tags")["mode"]).alias(
            "mode"
        ),
    )


def flatten_commits(
    pages: DataFrame, repository: str | Column, body: str = "body", keep: Sequence[str] = ()
) -> DataFrame:
    """Commit records of stored API pages, one JSON array per row."""
    repository = F.lit(repository) if isinstance(repository, str) else repository
    author = F.col("item.commit.author")
    return (
        pages.withColumn("repository", repository)
        .select(*keep, "repository", F.explode(F.from_json(body, schemas.COMMIT_PAGE)).alias("item"))
        .select(
            *keep,
            F.lit("github_commit").alias("type"),
            author["name"].alias("author"),
            author["email"].alias("email"),
            author["date"].alias("date"),
            "repository",
        )
    )


def flatten_runs(
    pages: DataFrame, repository: str | Column, body: str = "body", keep: Sequence[str] = ()
) -> DataFrame:
    """Workflow-run records of stored API pages, one JSON object per row."""
    repository = F.lit(repository) if isinstance(repository, str) else repository
    runs = F.from_json(body, schemas.RUN_PAGE)["workflow_runs"]
    return (
        pages.withColumn("repository", repository)
        .select(*keep, "repository", F.explode(runs).alias("run"))
        .select(
            *keep,
            F.lit("github_action").alias("type"),
            F.col("run.name").alias("name"),
            F.col("run.event").alias("event"),
            F.col("run.path").alias("pipeline_file"),
            F.col("run.head_branch").alias("build_branch"),
            F.col("run.status").alias("status"),
            F.col("run.actor.login").alias("actor"),
            F.col("run.conclusion").alias("conclusion"),
            F.col("run.created_at").alias("created_at"),
            "repository",
        )
    )


def _health(status: str, code: Column, value: float, message: Column) -> Column:
    return F.struct(
        F.lit(status).alias("status"),
        code.cast("int").alias("status_code"),
        F.lit(value).alias("value"),
        message.alias("message"),
    )


def classify_health(
    df: DataFrame, code: str = "code", error_kind: str = "error_kind", error: str | None = None
) -> DataFrame:
    """Health state of probe outcomes: an HTTP code, or the kind of failure instead.

    ``error_kind`` is null for an answered probe, else ``connection``, ``timeout`` or anything
    else; ``error`` names the column with the failure's text.
    """
    http, kind = F.col(code), F.col(error_kind)
    detail = F.col(error) if error else F.lit("")
    with_code = lambda text: F.concat(F.lit(text), http.cast("int").cast("string"))
    # States, codes, values and messages of the five outcomes.
    outcome = (
        F.when(
            kind.isNull() & (http >= 200) & (http < 400),
            _health("running", http, 1.0, with_code("Service is healthy and responding with HTTP ")),
        )
        .when(
            kind.isNull() & http.isNotNull(),
            _health("http_error", http, 0.5, with_code("Service responded with error HTTP ")),
        )
        .when(
            kind == "connection",
            _health(
                "connection_failed",
                F.lit(0),
                0.0,
                F.lit("Service unreachable — connection failed"),
            ),
        )
        .when(
            kind == "timeout",
            _health(
                "timeout",
                F.lit(408),
                0.0,
                F.lit("Service timed out — no response within 2 seconds"),
            ),
        )
        .otherwise(
            _health(
                "critical_failure",
                F.lit(500),
                0.0,
                F.concat(
                    F.lit("Unexpected exception occurred: "), F.coalesce(detail, F.lit(""))
                ),
            )
        )
    )
    plain = [c for c in df.columns if c not in {"status", "status_code", "value", "message"}]
    return df.withColumn("health", outcome).select(*plain, "health.*")
