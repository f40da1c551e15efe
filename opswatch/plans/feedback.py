"""Queries on documents, pages, conversations and catalogues: feedback and root causes."""

from __future__ import annotations

from pyspark.sql import functions as F

from opswatch.functions import url_host
from opswatch.operators.evaluation import binary_metrics, compare_models, rca_gain
from opswatch.operators.labels import (
    apply_feedback,
    confirmed,
    new_feedback,
    unmatched_labels,
    valid_anomalies,
)
from opswatch.operators.normalize import flatten_commits, flatten_runs
from opswatch.operators.rootcause import (
    entity_text,
    extract_service,
    known_root_cause,
    rca_pairs,
)
from opswatch.plans.tables import SQL_PAGES, host_catalog, page_texts, table


def keyword_anomalies(spark, sf_dir):
    lang = F.col("lang")
    scored = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("n_chars") > 4000, "high_anomaly")
        .when(F.col("n_chars") > 400, "low_anomaly")
        .otherwise("normal")
        .alias("prediction"),
        F.when(lang.isin("en", "de"), F.col("text")).otherwise("").alias("semantic_text"),
        F.when(lang == "fr", F.col("source")).otherwise("").alias("message"),
        "source",
    )
    found = valid_anomalies(scored, ["error", "the res", "SRC1"])
    return found.select("doc_id", "prediction")


def _anomalies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("n_chars").cast("string").alias("timestamp"),
        F.col("doc_id").alias("ord"),
        F.col("doc_id").alias("anomaly"),
        F.md5("text").alias("text_md5"),
    )


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        (F.col("doc_id") + 300).cast("string").alias("timestamp"),
        F.when(F.col("quality") == 1, "true").otherwise("false").alias("feedback_label"),
        F.when(F.col("toxic") == 1, "nginx").otherwise("").alias("root_cause"),
    )


def feedback_join(spark, sf_dir):
    return apply_feedback(_anomalies(spark, sf_dir), _labels(spark, sf_dir), order="ord")


def feedback_unmatched(spark, sf_dir):
    found = unmatched_labels(_anomalies(spark, sf_dir), _labels(spark, sf_dir))
    return found.select("doc_id", "timestamp", "feedback_label")


def confirmed_feedback(spark, sf_dir):
    english = confirmed(page_texts(spark, sf_dir), strict=False)
    return english.select("page_id", "semantic_text")


def new_lines(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("role", F.col("text").alias("value"))
    current = said.where(F.col("role") == "user").select("value")
    processed = said.where(F.col("role") != "user").select("value")
    return new_feedback(current, processed)


def service_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"))


def extracted_services(spark, sf_dir):
    rows = extract_service(page_texts(spark, sf_dir), host_catalog(spark, sf_dir))
    return rows.select("page_id", "service")


def extracted_services_joined(spark, sf_dir):
    """The form for long catalogues, on the same rows."""
    rows = extract_service(
        page_texts(spark, sf_dir), host_catalog(spark, sf_dir), max_inline=0
    )
    return rows.select("page_id", "service")


def training_pairs(spark, sf_dir):
    rows = rca_pairs(page_texts(spark, sf_dir), host_catalog(spark, sf_dir))
    return rows.select("page_id", "service", "entity_text")


def known_causes(spark, sf_dir):
    """Pages whose host, with or without TLS, is a catalogue service."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "://([^:/]+)", 1).alias("root_cause")
    )
    return known_root_cause(pages, host_catalog(spark, sf_dir))


def supplier_entities(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    catalog = (
        table(spark, sf_dir, "supplier")
        .join(nation, "s_nationkey")
        .join(region, "n_regionkey")
        .select(
            "s_suppkey",
            F.col("s_name").alias("service_name"),
            F.when(F.col("s_acctbal") > 0, F.col("n_name")).alias("domain"),
            F.col("r_name").alias("system"),
            F.when(F.col("s_acctbal") > 5000, F.array("n_name", "r_name"))
            .when(F.col("s_acctbal") > 1000, F.array().cast("array<string>"))
            .alias("dependencies"),
        )
    )
    return entity_text(catalog).select("s_suppkey", "entity_text")


def _judged(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(documents, "doc_id")


def label_quality(spark, sf_dir):
    found = binary_metrics(_judged(spark, sf_dir), "quality", "toxic", ["lang"])
    return found.select("lang", *[F.round(n, 6).alias(n) for n in ("precision", "recall", "f1")])


def model_comparison(spark, sf_dir):
    judged = _judged(spark, sf_dir)
    length = F.col("n_chars")
    scored = {
        "semantic": judged.select(
            F.col("quality").alias("label"),
            (length > 1000).cast("int").alias("predicted"),
            (length / 1000).alias("mse"),
        ),
        "structured": judged.select(
            F.col("quality").alias("label"),
            F.col("toxic").alias("predicted"),
            (length / 2000).alias("mse"),
        ),
    }
    found = compare_models(scored)
    names = ("precision", "recall", "f1", "mean_mse")
    return found.select("model", *[F.round(n, 6).alias(n) for n in names])


def price_gain(spark, sf_dir):
    """Relative gain of a score before and after, per flag."""
    after = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").withColumn("after", after)
    found = rca_gain(rows, "l_extendedprice", "after", ["l_returnflag"])
    return found.select("l_returnflag", F.round("avg_gain", 8).alias("avg_gain"), "samples")


_PAGE_TURNS = 4


def _pages_of(spark, sf_dir, item, body):
    """Conversation turns as stored API pages of up to four turns in their order."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", F.floor(F.col("turn") / F.lit(_PAGE_TURNS)).alias("page"), "turn", item.alias("item")
    )
    pages = turns.groupBy("conv_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("turn", "item")), _by_turn).alias("numbered")
    )
    pages = pages.withColumn("items", F.transform("numbered", lambda n: n["item"]))
    return pages.select("conv_id", body.alias("body"))


def _by_turn(a, b):
    return F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0)


def commit_pages(spark, sf_dir):
    author = F.struct(
        F.col("role").alias("name"),
        F.concat("role", F.lit("@example.org")).alias("email"),
        F.concat(F.lit("turn "), "turn").alias("date"),
    )
    item = F.struct(F.struct(author.alias("author")).alias("commit"), F.col("text").alias("note"))
    pages = _pages_of(spark, sf_dir, item, F.to_json("items"))
    return flatten_commits(pages, "shop/web", keep=("conv_id",))


def run_pages(spark, sf_dir):
    odd = F.col("turn") % 2 == 1
    item = F.struct(
        F.col("role").alias("name"),
        F.lit("push").alias("event"),
        F.concat(F.lit("flow-"), "turn").alias("path"),
        F.when(odd, "main").alias("head_branch"),
        F.lit("completed").alias("status"),
        F.when(odd, F.struct(F.col("role").alias("login"))).alias("actor"),
        F.length("text").cast("string").alias("conclusion"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
    )
    body = F.to_json(F.struct(F.col("items").alias("workflow_runs")))
    pages = _pages_of(spark, sf_dir, item, body)
    return flatten_runs(pages, "shop/web", keep=("conv_id",))


QUERIES = {
    "keyword_anomalies": keyword_anomalies,
    "feedback_join": feedback_join,
    "feedback_unmatched": feedback_unmatched,
    "confirmed_feedback": confirmed_feedback,
    "new_feedback": new_lines,
    "service_host": service_host,
    "extract_service": extracted_services,
    "extract_service_joined": extracted_services_joined,
    "rca_pairs": training_pairs,
    "known_root_cause": known_causes,
    "entity_text": supplier_entities,
    "binary_metrics": label_quality,
    "compare_models": model_comparison,
    "rca_gain": price_gain,
    "flatten_commits": commit_pages,
    "flatten_runs": run_pages,
}

_QUALITY = """round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1"""

_SERVICES = f"WITH {SQL_PAGES} SELECT page_id, service FROM x"

ORACLES = {
    "keyword_anomalies": """WITH d AS (
  SELECT doc_id, source, lower(text) AS t, lang,
         CASE WHEN n_chars > 4000 THEN 'high_anomaly' WHEN n_chars > 400 THEN 'low_anomaly' END
           AS prediction
  FROM documents)
SELECT doc_id, prediction FROM d
WHERE prediction IS NOT NULL AND CASE
  WHEN lang IN ('en', 'de') AND t <> '' THEN
    t LIKE '%error%' OR t LIKE '%the res%' OR t LIKE '%src1%'
  ELSE source LIKE '%src1%' END""",
    "feedback_join": """WITH f AS (
  SELECT CAST(n_chars AS VARCHAR) AS timestamp, min(doc_id) AS anomaly FROM documents GROUP BY 1)
SELECT timestamp, anomaly, md5(text) AS text_md5,
       CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS feedback_label,
       CASE WHEN toxic = 1 THEN 'nginx' END AS root_cause
FROM labels l JOIN f ON f.timestamp = CAST(l.doc_id + 300 AS VARCHAR)
JOIN documents d ON d.doc_id = f.anomaly""",
    "feedback_unmatched": """SELECT doc_id, CAST(doc_id + 300 AS VARCHAR) AS timestamp,
       CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS feedback_label
FROM labels WHERE doc_id + 300 NOT IN (SELECT n_chars FROM documents)""",
    "confirmed_feedback": f"""WITH {SQL_PAGES}
SELECT page_id, t AS semantic_text FROM p WHERE confirmed""",
    "new_feedback": """SELECT DISTINCT text AS value FROM conversations
WHERE role = 'user' AND trim(text) <> ''
  AND text NOT IN (SELECT text FROM conversations WHERE role <> 'user')""",
    "service_host": """SELECT page_id, nullif(regexp_extract(url, 'http://([^:/]+)', 1), '') AS host
FROM pages""",
    "extract_service": _SERVICES,
    "extract_service_joined": _SERVICES,
    "rca_pairs": f"""WITH {SQL_PAGES}
SELECT page_id, service, h || ' ' || regexp_extract(h, '([^.]*)$', 1) || ' web '
       || replace(h, '.', ' ') AS entity_text
FROM x JOIN hosts ON h = service WHERE confirmed""",
    "known_root_cause": f"""WITH {SQL_PAGES}
SELECT page_id, regexp_extract(url, '://([^:/]+)', 1) AS root_cause FROM pages
WHERE regexp_extract(url, '://([^:/]+)', 1) IN (SELECT h FROM hosts)""",
    "entity_text": """SELECT s_suppkey, s_name || ' ' || CASE WHEN s_acctbal > 0 THEN n_name ELSE '' END
       || ' ' || r_name || ' '
       || CASE WHEN s_acctbal > 5000 THEN n_name || ' ' || r_name ELSE '' END AS entity_text
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "binary_metrics": f"""WITH n AS (
  SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp,
         count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
         count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn
  FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, {_QUALITY} FROM n""",
    "compare_models": f"""WITH s AS (
  SELECT 'semantic' AS model, quality AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p,
         n_chars / 1000 AS mse FROM labels JOIN documents USING (doc_id)
  UNION ALL
  SELECT 'structured', quality, toxic, n_chars / 2000 FROM labels JOIN documents USING (doc_id)),
n AS (SELECT model, avg(mse) AS mean_mse, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp,
             count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND p = 0) AS fn FROM s GROUP BY model)
SELECT model, {_QUALITY}, round(mean_mse, 6) AS mean_mse FROM n""",
    "rca_gain": """SELECT l_returnflag, count(*) AS samples,
  round(avg((l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice)
    / l_extendedprice), 8) AS avg_gain
FROM lineitem GROUP BY l_returnflag""",
    "flatten_commits": """SELECT conv_id, 'github_commit' AS type, role AS author,
       role || '@example.org' AS email, 'turn ' || turn AS date, 'shop/web' AS repository
FROM conversations""",
    "flatten_runs": """SELECT conv_id, 'github_action' AS type, role AS name, 'push' AS event,
       'flow-' || turn AS pipeline_file, CASE WHEN turn % 2 = 1 THEN 'main' END AS build_branch,
       'completed' AS status, CASE WHEN turn % 2 = 1 THEN role END AS actor,
       CAST(length(text) AS VARCHAR) AS conclusion, '2024-01-01T00:00:00Z' AS created_at,
       'shop/web' AS repository
FROM conversations""",
}
