"""From JSON events to the wide structured table and the semantic rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch import schemas
from opswatch.functions import first_value_of, rx, to_number, with_semantic_text


def _may_repeat(text: str, names: Sequence[str]) -> str:
    """Whether one of the keys may occur twice: it is there twice between quotes, or keys may be spelt with escapes.

    SQL text, as are the other expressions here that are made per field: one call builds what would take hundreds.
    """
    twice = [f"locate('\"{n}\"', {text}, locate('\"{n}\"', {text}) + 1) > 0" for n in names]
    return " OR ".join([rf"contains({text}, r'\u')", *twice])


def parse_envelope(df: DataFrame, col: str = "json_str", keep: tuple[str, ...] = ()) -> DataFrame:
    """``source_type, timestamp, message`` of each event, with the event text kept beside them.

    Of a key that occurs twice the first value counts. The text is parsed once; only where a key may
    occur twice each field is looked up by its path.
    """
    fields = ("source_type", "timestamp", "message")
    texts = df.select(*keep, F.col(col).cast("string").alias("json_str"))
    parsed = texts.select("*", F.json_tuple("json_str", *fields).alias(*[f"__{n}" for n in fields]))
    parsed = parsed.withColumn("__repeated", F.expr(_may_repeat("json_str", fields)))
    first = [f"CASE WHEN __repeated THEN get_json_object(json_str, '$.{n}') ELSE __{n} END AS {n}" for n in fields]
    return parsed.select(*keep, "json_str", *map(F.expr, first))


_INNER = {source: [name for _, name in fields] for source, fields in schemas.SOURCE_FIELDS.items()}
_INNER_NAMES = sorted({name for names in _INNER.values() for name in names})
_FLAT_NAMES = _INNER[schemas.FLAT_SOURCE]


_OWNERS = {n: [source for source, names in _INNER.items() if n in names] for n in _INNER_NAMES}


def _with_fields(envelope: DataFrame, last: bool = False, only: str | None = None) -> DataFrame:
    """The fields of the message as ``m_…`` and those beside the envelope as ``f_…``.

    Of a repeated key the first value counts, or the ``last`` one. A text is parsed once for all fields, and only where
    its source has fields; where a key may be there twice, its first value is looked up by path. With ``only``
    there are just the fields of that source.
    """
    source = F.col("source_type")
    inner_of = {o: names for o, names in _INNER.items() if only in (None, o)}
    inner_names = sorted({n for names in inner_of.values() for n in names})
    flat_names = _FLAT_NAMES if schemas.FLAT_SOURCE in inner_of else []
    if not inner_names:
        return envelope
    if last:
        inner = F.when(source != schemas.TEXT_SOURCE, F.col("message"))
        flat = F.when(source == schemas.FLAT_SOURCE, F.col("json_str"))
        parsed = envelope.select(
            "*", F.json_tuple(inner, *_INNER_NAMES).alias(*[f"m_{n}" for n in _INNER_NAMES])
        )
        return parsed.select(
            "*", F.json_tuple(flat, *_FLAT_NAMES).alias(*[f"f_{n}" for n in _FLAT_NAMES])
        )

    own = F.when(source.isin([o for o, names in inner_of.items() if names]), F.col("message"))
    parsed = envelope.select("*", F.json_tuple(own, *inner_names).alias(*[f"__m_{n}" for n in inner_names]))
    owners = [f"WHEN source_type = '{o}' THEN {_may_repeat('message', names)}" for o, names in inner_of.items() if names]
    parsed = parsed.select("*", F.expr(f"CASE {' '.join(owners)} ELSE false END AS __repeated"))
    if flat_names:
        flat = F.when(source == schemas.FLAT_SOURCE, F.col("json_str"))
        parsed = parsed.select("*", F.json_tuple(flat, *flat_names).alias(*[f"__f_{n}" for n in flat_names]))
        beside = f"(source_type = '{schemas.FLAT_SOURCE}' AND ({_may_repeat('json_str', flat_names)})) AS __beside"
        parsed = parsed.select("*", F.expr(beside))

    def field(text: str, kind: str, name: str, owners: list[str], repeated: str) -> Column:
        path = f"CASE WHEN {repeated} THEN get_json_object({text}, '$.{name}') ELSE __{kind}_{name} END"
        names = ", ".join(f"'{o}'" for o in owners)
        return F.expr(f"CASE WHEN source_type IN ({names}) THEN {path} END AS {kind}_{name}")

    message = [field("message", "m", n, _OWNERS[n], "__repeated") for n in inner_names]
    flats = [field("json_str", "f", n, [schemas.FLAT_SOURCE], "__beside") for n in flat_names]
    return parsed.select(*envelope.columns, *message, *flats)


def _columns() -> dict[str, tuple[str, Column]]:
    """Structured column -> (source that fills it, expression over the parsed fields)."""
    columns = {}
    for source, fields in schemas.SOURCE_FIELDS.items():
        for column, name in fields:
            value = F.col(f"m_{name}")
            if source == schemas.FLAT_SOURCE:
                value = first_value_of(value, F.col(f"f_{name}"))
            columns[column] = (source, value)
    for column, pattern in schemas.TEXT_FIELDS:
        columns[column] = (schemas.TEXT_SOURCE, rx(F.col("message"), pattern))
    return columns


def route_structured(envelope: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 36-column structured table of an envelope table or stream, in one pass.

    Each column belongs to one source. Rows of unknown sources are dropped. ``keep`` carries
    further columns (such as the event time) along.
    """
    source = F.col("source_type")
    routed = [
        F.when(source == owner, expression).alias(column)
        for column, (owner, expression) in _columns().items()
    ]
    known = envelope.where(source.isin(schemas.SOURCES))
    return _with_fields(known).select(*keep, source, *routed)


def source_rows(envelope: DataFrame, source: str) -> DataFrame:
    """One source's rows with only its own columns."""
    own = [e.alias(c) for c, (owner, e) in _columns().items() if owner == source]
    rows = envelope.where(F.col("source_type") == source)
    return _with_fields(rows, only=source).select("source_type", *own)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of differently shaped tables or streams, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# The fields filled when scoring a labelled set in compatible mode; the other
# features keep their defaults (0.0 for numbers, "unknown" for categories).
_COMPAT_TEXT = {
    "github_commits": ["commit_author"],
    "github_actions": ["action_conclusion"],
    "public_cloud": ["event_name", "username"],
    "app_container_log": ["log_level", "log_message"],
}
_COMPAT_NUMBER = {
    "response_status": ("nginx_access", "status"),
    "request_time": ("nginx_access", "request_time"),
    "value": ("fastapi_status", "value"),
}


def route_for_scoring(
    envelope: DataFrame, compat: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The 29 features of each event with defaults applied.

    ``compat`` fills only the fields the original evaluation fills, with the heartbeat number in
    ``value``; otherwise the training extractor is used. No row is dropped in compatible mode.
    """
    if not compat:
        routed = route_structured(envelope, keep)
        return routed.select(*keep, *[_defaulted(c, F.col(c)) for c in schemas.FEATURE_COLUMNS])

    filled = {c: s for s, names in _COMPAT_TEXT.items() for c in names}
    expressions = _columns()
    source = F.col("source_type")
    features = []
    for name in schemas.FEATURE_COLUMNS:
        if name == "source_type":
            value = F.coalesce(source, F.lit(""))
        elif name in filled:
            value = F.when(source == filled[name], expressions[name][1])
        elif name in _COMPAT_NUMBER:
            owner, path = _COMPAT_NUMBER[name]
            number = F.col(f"m_{path}")
            # a JSON true is the number 1, the text "true" is none
            true = (number == "true") & F.col("message").rlike(rf'"{path}"\s*:\s*true')
            value = F.when(source == owner, F.when(true, "1").otherwise(number))
        else:
            value = F.lit(None).cast("string")
        features.append(_defaulted(name, value))
    return _with_fields(envelope, last=True).select(*keep, *features)


def _defaulted(name: str, value: Column) -> Column:
    if name in schemas.NUMERIC_COLUMNS:
        return to_number(value).alias(name)
    return F.coalesce(value, F.lit("unknown")).alias(name)


def semantic_rows(
    df: DataFrame, col: str = "json_str", mode: str = "native", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``source_type, ingest_time, semantic_text`` beside the event text."""
    texts = df.select(*keep, F.col(col).cast("string").alias("json_str"))
    names = ("source_type", "ingest_time")
    tagged = texts.select("*", F.json_tuple("json_str", "source_type", "timestamp").alias(*names))
    rows = with_semantic_text(tagged, "json_str", mode=mode)
    return rows.select(*keep, "json_str", *names, "semantic_text")
