"""Column functions: everything here is a plain Column expression unless it says otherwise."""

from opswatch.functions.jsonfn import is_json_object, json_entries, json_path, record_json
from opswatch.functions.numeric import (
    anomaly_ratio,
    decide,
    first_value_of,
    tier,
    to_number,
)
from opswatch.functions.semantic import INVALID_JSON, semantic_text, with_semantic_text
from opswatch.functions.text import (
    contains_ci,
    deps_text,
    kv_text,
    log_tokens,
    named_service,
    rx,
    url_host,
)
from opswatch.functions.timefn import from_micros, micros, parse_ts, seconds_between, stamp
from opswatch.functions.vectors import cosine, dot, norm, standardize

__all__ = [
    "INVALID_JSON",
    "anomaly_ratio",
    "contains_ci",
    "cosine",
    "decide",
    "deps_text",
    "dot",
    "first_value_of",
    "from_micros",
    "is_json_object",
    "json_entries",
    "json_path",
    "kv_text",
    "log_tokens",
    "micros",
    "named_service",
    "norm",
    "parse_ts",
    "record_json",
    "rx",
    "seconds_between",
    "semantic_text",
    "stamp",
    "standardize",
    "tier",
    "to_number",
    "url_host",
    "with_semantic_text",
]
