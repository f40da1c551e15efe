"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a text names its host and its service.
HOST_PATTERN = r"http://([^:/]+)"
NAME_PATTERN = r"name=([a-zA-Z0-9_\-]+)"


def rx(col: Column, pattern: str) -> Column:
    """First group of the first match, ``''`` without one."""
    return F.regexp_extract(col, pattern, 1)


def contains_ci(col: Column, keyword: str) -> Column:
    return F.lower(col).contains(keyword.lower())


def kv_text(entries: Column) -> Column:
    """``k=v`` pairs joined by spaces; a JSON null reads ``None``."""
    pairs = F.transform(
        entries,
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))),
    )
    return F.array_join(pairs, " ")


def url_host(col: Column) -> Column:
    """Host of the first ``http://`` address, null without one."""
    return F.nullif(rx(col, HOST_PATTERN), F.lit(""))


def named_service(col: Column) -> Column:
    """Value after ``name=`` up to its first underscore, null without one."""
    value = F.nullif(rx(col, NAME_PATTERN), F.lit(""))
    return F.nullif(F.substring_index(value, "_", 1), F.lit(""))


def log_tokens(col: Column) -> Column:
    """Whitespace separated tokens of a log line; none for a blank line."""
    return F.filter(F.split(col, r"\s+"), lambda t: t != "")


def deps_text(col: Column) -> Column:
    return F.coalesce(F.array_join(col, " "), F.lit(""))
