"""Readers and sinks checked by writing rows of the tables to the shared folder and reading them back; root causes by their vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch import schemas, sources
from opswatch.functions import stamp
from opswatch.operators.autoencoder import load_model, save_model
from opswatch.operators.encode import encode
from opswatch.operators.envelope import semantic_rows
from opswatch.operators.rootcause import rca_scores
from opswatch.operators.scoring import score_vectors
from opswatch.plans.events import ORACLES as EVENT_SQL
from opswatch.plans.tables import SQL_PAGES, event_records, events, host_catalog, page_texts, table
from opswatch.plans.vectors import ORACLES as VECTOR_SQL
from opswatch.plans.vectors import _pair_vectors, _vectors, encode_sql, page_root_causes, written_network
from opswatch.session import ensure_checkpoint_dir

_ONCE = {"availableNow": True}


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/trip-{uuid.uuid4().hex}"


def _lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.text(path)


_FEEDBACK = "page_id long, semantic_text string, feedback_label string"


def _feedback_lines(spark, sf_dir, path):
    """Feedback as JSON lines; every fifth line is none."""
    pages = page_texts(spark, sf_dir)
    record = F.to_json(F.struct("page_id", "semantic_text", "feedback_label"))
    _lines(pages, F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("broken "), "semantic_text")).otherwise(record), path)
    return spark.createDataFrame([], _FEEDBACK).schema


def feedback_file(spark, sf_dir):
    path = _folder(spark)
    return sources.read_jsonl(spark, path, _feedback_lines(spark, sf_dir, path))


def feedback_file_stream(spark, sf_dir):
    folder = _folder(spark)
    schema = _feedback_lines(spark, sf_dir, f"{folder}/in")
    stream = sources.read_jsonl_stream(spark, f"{folder}/in", schema)
    sources.start_sink(stream, f"{folder}/out", f"{folder}/state", trigger=_ONCE).awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def catalog_file(spark, sf_dir):
    """The catalogue's services with their place in the file, as the reader's order gives it."""
    path = _folder(spark)
    services = host_catalog(spark, sf_dir).orderBy(F.desc("service_name")).coalesce(1)
    _lines(services, F.to_json(F.struct("service_name", "domain", "system", "dependencies")), path)
    found = sources.read_catalog(spark, path)
    # a catalogue is as long as there are services
    before = found.alias("a").join(found.alias("b"), F.col("b.ord") <= F.col("a.ord"))
    return before.groupBy("a.service_name", "a.domain").agg(F.count("*").alias("line"))


def semantic_file(spark, sf_dir):
    """Semantic rows with their vectors, written and read: rows and numbers per source."""
    path = _folder(spark)
    sources.write_semantic(encode(semantic_rows(event_records(spark, sf_dir))), path)
    found = sources.read_semantic(spark, path)
    return found.groupBy("source_type").agg(
        F.count("*").alias("row_count"), F.sum(F.size("embedding")).alias("numbers"),
        F.sum(F.length("semantic_text")).cast("long").alias("characters"),
    )


def report_file(spark, sf_dir):
    """A small report as CSV, read back with its header."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    sources.write_report(rows, path)
    return spark.read.option("header", True).schema("event_type string, n long, first_id long").csv(path)


def published_events(spark, sf_dir):
    """Events written as JSON values by a stream and followed by another."""
    folder = _folder(spark)
    rows = events(spark, sf_dir).select("event_id", "event_type", "user_id", "k")
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    sources.write_events_stream(stream, "text", f"{folder}/state", _ONCE, path=f"{folder}/topic").awaitTermination()
    followed = sources.read_events_stream(spark, "text", f"{folder}/topic")
    sources.start_sink(followed, f"{folder}/out", f"{folder}/state2", trigger=_ONCE).awaitTermination()
    parsed = F.from_json("json_str", rows.schema).alias("r")
    return spark.read.schema("json_str string").parquet(f"{folder}/out").select(parsed).select("r.*")


def saved_model(spark, sf_dir):
    """Scores by the newest published version of a model, read back; an older version lies beside it."""
    path = _folder(spark)
    save_model(written_network(threshold=9.9), spark, path)
    save_model(written_network(), spark, path)
    scored = score_vectors(_vectors(spark, sf_dir), load_model(spark, path))
    return scored.select("vec_id", "mse", "prediction", "threshold")


def stamped(spark, sf_dir):
    """Rows stamped with the time of scoring: the time is there, is the same for all, and is later than every event."""
    rows = stamp(table(spark, sf_dir, "events"))
    late = F.col("scored_at") > F.col("ts").cast("timestamp")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(late).alias("later"), F.count_distinct("scored_at").alias("times"))


def ranked_causes(spark, sf_dir):
    """Confidences of the three services nearest to each confirmed page; names are left out, as equal services may change places."""
    return page_root_causes(spark, sf_dir).select("page_id", "rank", F.round("confidence", 6).alias("confidence"))


def pair_similarity(spark, sf_dir):
    """Similarity of confirmed texts to their service's text, before any training."""
    scored = rca_scores(_pair_vectors(spark, sf_dir), "text_vector", "entity_vector", "before")
    return scored.select("page_id", "service", F.round("before", 6).alias("before"))


QUERIES = {
    "feedback_file": feedback_file,
    "feedback_file_stream": feedback_file_stream,
    "catalog_file": catalog_file,
    "semantic_file": semantic_file,
    "report_file": report_file,
    "published_events": published_events,
    "saved_model": saved_model,
    "stamped": stamped,
    "root_cause_confidence": ranked_causes,
    "pair_similarity": pair_similarity,
}

_FEEDBACK_SQL = """SELECT page_id, 'url=' || url || ' name=web_' || page_id AS semantic_text,
       CASE WHEN contains(html, 'lang="en"') THEN 'true' ELSE 'false' END AS feedback_label
FROM pages WHERE page_id % 5 <> 0"""

ORACLES = {
    "feedback_file": _FEEDBACK_SQL,
    "feedback_file_stream": _FEEDBACK_SQL,
    "catalog_file": f"""WITH {SQL_PAGES}
SELECT h AS service_name, regexp_extract(h, '([^.]*)$', 1) AS domain, row_number() OVER (ORDER BY h DESC) AS line FROM hosts""",
    "semantic_file": f"""WITH t AS ({EVENT_SQL["semantic_text"]})
SELECT source_type, count(*) AS row_count, count(*) * {schemas.EMBEDDING_DIM} AS numbers,
       CAST(sum(length(semantic_text)) AS BIGINT) AS characters FROM t GROUP BY source_type""",
    "report_file": "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type",
    "published_events": "SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "saved_model": VECTOR_SQL["network_scores"],
    "stamped": "SELECT event_type, count(*) AS n, count(*) AS later, 1::BIGINT AS times FROM events GROUP BY event_type",
    "root_cause_confidence": f"""WITH {SQL_PAGES},
texts AS (SELECT page_id AS id, t FROM p WHERE confirmed UNION ALL SELECT -row_number() OVER (ORDER BY h), h FROM hosts),
{encode_sql("id", "texts", "t")},
len AS (SELECT id, sqrt(sum(x * x)) AS len FROM vec GROUP BY id),
dots AS (SELECT a.id AS page_id, b.id AS host, sum(a.x * b.x) AS dot FROM vec a JOIN vec b USING (dim) WHERE a.id >= 0 AND b.id < 0 GROUP BY 1, 2),
every AS (
  SELECT q.id AS page_id, e.id AS host, e.t AS entity, coalesce(dot, 0.0) / (lq.len * le.len) AS c
  FROM texts q JOIN len lq ON lq.id = q.id CROSS JOIN texts e JOIN len le ON le.id = e.id
  LEFT JOIN dots ON dots.page_id = q.id AND dots.host = e.id WHERE q.id >= 0 AND e.id < 0)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY c DESC, entity) - 1 AS INTEGER) AS rank, round(c, 6) AS confidence
FROM every QUALIFY rank < 3""",
    "pair_similarity": f"""WITH {SQL_PAGES},
pairs AS (
  SELECT page_id, service, t, h || ' ' || regexp_extract(h, '([^.]*)$', 1) || ' web ' || replace(h, '.', ' ') AS entity
  FROM x JOIN p USING (page_id) JOIN hosts ON h = service WHERE x.confirmed),
texts AS (SELECT page_id * 2 AS id, t FROM pairs UNION ALL SELECT page_id * 2 + 1, entity FROM pairs),
{encode_sql("id", "texts", "t")},
len AS (SELECT id, sqrt(sum(x * x)) AS len FROM vec GROUP BY id),
dots AS (SELECT a.id // 2 AS page_id, sum(a.x * b.x) AS dot FROM vec a JOIN vec b ON b.id = a.id + 1 AND b.dim = a.dim WHERE a.id % 2 = 0 GROUP BY 1)
SELECT page_id, service, round(coalesce(dot, 0.0) / (a.len * b.len), 6) AS before
FROM pairs JOIN len a ON a.id = page_id * 2 JOIN len b ON b.id = page_id * 2 + 1 LEFT JOIN dots USING (page_id)""",
}
