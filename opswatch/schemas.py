"""Schemas and the fixed names shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# The collected sources and the columns each one fills in the wide
# structured table, as (column, JSON field of the inner message).
SOURCE_FIELDS: dict[str, list[tuple[str, str]]] = {
    "github_commits": [
        ("commit_email", "email"),
        ("commit_author", "author"),
        ("commit_repository", "repository"),
    ],
    "github_actions": [
        ("action_event", "event"),
        ("action_name", "name"),
        ("action_pipeline_file", "pipeline_file"),
        ("action_build_branch", "build_branch"),
        ("action_status", "status"),
        ("action_conclusion", "conclusion"),
        ("action_repository", "repository"),
    ],
    "public_cloud": [
        ("event_name", "event_name"),
        ("username", "username"),
    ],
    "app_container_metrics": [
        ("device", "device"),
        ("kind", "kind"),
        ("name", "name"),
        ("value", "value"),
    ],
    "app_container_log": [
        ("log_level", "level"),
        ("logger_name", "logger"),
        ("log_message", "message"),
        ("service_name", "service_name"),
    ],
    "fastapi_status": [
        ("container_name", "name"),
        ("container_status", "status"),
        ("container_status_code", "status_code"),
        ("container_url", "url"),
        ("container_value", "value"),
        ("container_message", "message"),
    ],
    "nginx_access": [
        ("client_ip", "remote_addr"),
        ("request_method", "request_method"),
        ("request_uri", "request_uri"),
        ("response_status", "status"),
        ("body_bytes_sent", "body_bytes_sent"),
        ("request_time", "request_time"),
        ("user_agent", "http_user_agent"),
    ],
}

# The raw-text source, its columns and the patterns whose first group fills them.
TEXT_SOURCE = "nginx_error"
TEXT_FIELDS: list[tuple[str, str]] = [
    ("error_level", r"\[(\w+)\]"),
    ("error_detail", r": (.*)"),
]

# The source whose fields may sit beside the envelope fields instead of inside the message.
FLAT_SOURCE = "app_container_metrics"

SOURCES: list[str] = [*SOURCE_FIELDS, TEXT_SOURCE]

STRUCTURED_COLUMNS: list[str] = (
    ["source_type"]
    + [column for fields in SOURCE_FIELDS.values() for column, _ in fields]
    + [column for column, _ in TEXT_FIELDS]
)
STRUCTURED = _strings(*STRUCTURED_COLUMNS)

# The model features, in feature order.
FEATURE_COLUMNS: list[str] = [
    "source_type",
    "response_status",
    "log_message",
    "log_level",
    "commit_email",
    "commit_author",
    "commit_repository",
    "action_event",
    "action_name",
    "action_pipeline_file",
    "action_build_branch",
    "action_conclusion",
    "event_name",
    "username",
    "device",
    "kind",
    "name",
    "value",
    "logger_name",
    "service_name",
    "client_ip",
    "request_method",
    "request_uri",
    "request_time",
    "user_agent",
    "container_url",
    "container_value",
    "container_message",
    "error_detail",
]
NUMERIC_COLUMNS: list[str] = [
    "response_status",
    "value",
    "container_value",
    "request_time",
]
CATEGORICAL_COLUMNS: list[str] = [c for c in FEATURE_COLUMNS if c not in NUMERIC_COLUMNS]

# Host metrics that are kept.
KEPT_METRICS: list[str] = [
    "node_load1",
    "node_load5",
    "node_load15",
    "node_memory_MemAvailable_bytes",
    "node_filesystem_avail_bytes",
    "node_filesystem_size_bytes",
    "node_filesystem_free_bytes",
    "node_network_up",
    "node_network_info",
]

EMBEDDING_DIM = 384

SEMANTIC = T.StructType(
    [
        T.StructField("source_type", T.StringType()),
        T.StructField("ingest_time", T.StringType()),
        T.StructField("semantic_text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

LABELLED = T.StructType(
    [
        T.StructField("source_type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("json_str", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

ANOMALY = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("semantic_text", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("mse", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

FEEDBACK = T.StructType(
    ANOMALY.fields
    + [
        T.StructField("feedback_label", T.StringType()),
        T.StructField("root_cause", T.StringType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("service_name", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("config_path", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("deployment_env", T.StringType()),
        T.StructField("dependencies", T.ArrayType(T.StringType())),
        T.StructField("last_updated", T.StringType()),
    ]
)

METRIC_SAMPLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("counter", T.StructType([T.StructField("value", T.DoubleType())])),
        T.StructField("gauge", T.StructType([T.StructField("value", T.DoubleType())])),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)

COMMIT_PAGE = T.ArrayType(
    T.StructType(
        [
            T.StructField(
                "commit",
                T.StructType([T.StructField("author", _strings("name", "email", "date"))]),
            )
        ]
    )
)

RUN_PAGE = T.StructType(
    [
        T.StructField(
            "workflow_runs",
            T.ArrayType(
                T.StructType(
                    _strings("name", "event", "path", "head_branch", "status").fields
                    + [T.StructField("actor", _strings("login"))]
                    + _strings("conclusion", "created_at").fields
                )
            ),
        )
    ]
)
