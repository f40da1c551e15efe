"""Queries on embeddings and texts: scaler, models, scores and candidates.

Training queries have no SQL counterpart; ``network_scores`` checks the network itself with weights
that SQL can write down.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from opswatch import schemas
from opswatch.functions import standardize
from opswatch.operators.autoencoder import (
    Autoencoder,
    fine_tune,
    fit_autoencoder,
    reconstruction_mse,
)
from opswatch.operators.encode import FACTOR, encode
from opswatch.operators.envelope import parse_envelope, route_structured, semantic_rows
from opswatch.operators.evaluation import rca_gain
from opswatch.operators.features import fit_scaler, valid_embeddings
from opswatch.operators.labels import rule_labels
from opswatch.operators.projection import SECOND_TRAINING, fit_projection
from opswatch.operators.rootcause import cosine_topk, rca_pairs, rca_scores
from opswatch.operators.scoring import (
    SemanticBundle,
    evaluate,
    fit_structured,
    score_events,
    score_vectors,
)
from opswatch.plans.tables import event_records, host_catalog, page_texts, table
from opswatch.session import cut_lineage, spread
from opswatch.streaming.rootcause import encode_services, root_cause

DIM = 64


def _vectors(spark, sf_dir):
    return valid_embeddings(table(spark, sf_dir, "embeddings"), DIM)


def scaler_stats(spark, sf_dir):
    fitted = fit_scaler(_vectors(spark, sf_dir))
    return fitted.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("dim", "s")).select(
        "dim", F.round("s.mean", 8).alias("mean"), F.round("s.scale", 8).alias("scale")
    )


def standardized(spark, sf_dir):
    # The scaler is one row of 2 x 64 numbers.
    rows = _vectors(spark, sf_dir).withColumn("one", F.lit(1))
    fitted = F.broadcast(fit_scaler(_vectors(spark, sf_dir)).withColumn("one", F.lit(1)))
    z = standardize(F.col("embedding"), F.col("mean"), F.col("scale"))
    return rows.join(fitted, "one").select("vec_id", F.posexplode(z).alias("dim", "z")).select(
        "vec_id", "dim", F.round("z", 6).alias("z")
    )


def _prototypes(spark, sf_dir):
    """The mean vector of each label, as an entity catalogue."""
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    means = _vectors(spark, sf_dir).groupBy("label").agg(Summarizer.mean(vector).alias("m"))
    return means.select(
        F.concat(F.lit("service-"), "label").alias("service_name"),
        F.col("label").alias("ord"),
        vector_to_array("m").alias("vector"),
    )


def nearest_prototypes(spark, sf_dir):
    found = cosine_topk(
        _vectors(spark, sf_dir), _prototypes(spark, sf_dir), query_id="vec_id"
    )
    return found.withColumn("confidence", F.round("confidence", 6))


def nearest_prototypes_blocked(spark, sf_dir):
    """The form for catalogues that are too large to broadcast, on the same rows."""
    found = cosine_topk(
        _vectors(spark, sf_dir),
        _prototypes(spark, sf_dir),
        query_id="vec_id",
        max_values=0,
        block=1000,
    )
    return found.withColumn("confidence", F.round("confidence", 6))


def prototype_cosines(spark, sf_dir):
    """Cosine of each vector with its own label's prototype."""
    own = _prototypes(spark, sf_dir).select(F.col("ord").alias("label"), "vector")
    rows = rca_scores(_vectors(spark, sf_dir).join(own, "label"), "embedding", "vector", "score")
    return rows.select("vec_id", F.round("score", 6).alias("score"))


_UNITS = 4


def written_network(dim: int = DIM, threshold: float = 0.06) -> Autoencoder:
    i, j = np.meshgrid(np.arange(dim), np.arange(_UNITS), indexing="ij")
    return Autoencoder(
        w1=((i * 7 + j * 3) % 11 - 5) / 50,
        b1=np.arange(_UNITS) / 100,
        w2=(((i * 5 + j * 2) % 13 - 6) / 40).T,
        b2=np.arange(dim) / 1000,
        mean=np.full(dim, 0.01),
        scale=np.full(dim, 0.5),
        threshold=threshold,
    )


def network_scores(spark, sf_dir):
    """Reconstruction error and tier of every vector through a network written as a formula."""
    scored = score_vectors(_vectors(spark, sf_dir), written_network())
    return scored.select("vec_id", "mse", "prediction", "threshold")


def _trained(spark, sf_dir):
    return fit_autoencoder(_vectors(spark, sf_dir), id_col="vec_id")[0]


def autoencoder_scores(spark, sf_dir):
    scored = score_vectors(_vectors(spark, sf_dir), _trained(spark, sf_dir))
    return scored.select("vec_id", "label", "mse", "threshold", "prediction")


def autoencoder_losses(spark, sf_dir):
    """Training and validation loss of ten full-batch steps."""
    _, history = fit_autoencoder(_vectors(spark, sf_dir), mode="fullbatch", id_col="vec_id")
    rows = [(i + 1, h["loss"], h["val_loss"]) for i, h in enumerate(history)]
    return spark.createDataFrame(rows, "step int, loss double, val_loss double")


def fine_tuned_scores(spark, sf_dir):
    """Scores after continuing on the vectors the first model finds anomalous."""
    model = _trained(spark, sf_dir)
    scored = score_vectors(_vectors(spark, sf_dir), model)
    flagged = cut_lineage(scored.where(F.col("prediction") != "normal").select("vec_id", "embedding"))
    tuned = fine_tune(model, flagged) or model
    error = reconstruction_mse(spark, tuned, "embedding")
    return _vectors(spark, sf_dir).select("vec_id", F.round(error, 6).alias("mse"))


def encoded_documents(spark, sf_dir):
    """Vectors of the whole documents; numbers that are zero are left out."""
    rows = encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")
    numbers = rows.select("doc_id", F.posexplode("embedding").alias("dim", "x"))
    scaled = F.floor(F.col("x").cast("double") * 10_000)
    return numbers.where(F.col("x") != 0).select("doc_id", "dim", scaled.alias("x"))


def _event_rows(spark, sf_dir):
    return cut_lineage(event_records(spark, sf_dir))


def _semantic_model(source, dim=schemas.EMBEDDING_DIM):
    texts = semantic_rows(source).select("semantic_text")
    return SemanticBundle(fit_autoencoder(texts, text="semantic_text", encoded_dim=dim)[0])


def _structured_model(source):
    return fit_structured(cut_lineage(route_structured(parse_envelope(source))))[0]


def scored_events(spark, sf_dir):
    """Every event through text, vector, error and tier."""
    source = _event_rows(spark, sf_dir)
    scored = score_events(source, _semantic_model(source))
    return scored.select(
        "anomaly_id", "source_type", "semantic_text", "prediction", "mse", "threshold", "error"
    )


def structured_scores(spark, sf_dir):
    source = _event_rows(spark, sf_dir)
    bundle = _structured_model(source)
    routed = route_structured(parse_envelope(source, keep=("event_id",)), keep=("event_id",))
    return bundle.errors(routed, keep=["event_id"]).select("event_id", F.round("mse", 6).alias("mse"))


def detector_comparison(spark, sf_dir):
    source = _event_rows(spark, sf_dir)
    labelled = rule_labels(parse_envelope(source)).select("json_str", "label")
    return evaluate(labelled, _semantic_model(source), _structured_model(source))


def _pair_vectors(spark, sf_dir):
    pairs = rca_pairs(page_texts(spark, sf_dir), host_catalog(spark, sf_dir))
    pairs = encode(pairs, "semantic_text", "text_vector")
    return cut_lineage(encode(pairs, "entity_text", "entity_vector"))


def projection_gain(spark, sf_dir):
    """Similarity of confirmed texts to their service before and after contrastive training, and the mean relative gain."""
    pairs = _pair_vectors(spark, sf_dir)
    w, _ = fit_projection(pairs, **SECOND_TRAINING, batches_per_update=1)
    scored = rca_scores(pairs, "text_vector", "entity_vector", "before")
    scored = rca_scores(scored, "text_vector", "entity_vector", "after", w)
    scored = scored.select("page_id", "service", "before", "after")
    # One row: the mean over all samples.
    return scored.crossJoin(F.broadcast(rca_gain(scored, "before", "after").select("avg_gain")))


def page_root_causes(spark, sf_dir):
    services = encode_services(host_catalog(spark, sf_dir))
    found = root_cause(page_texts(spark, sf_dir), services)
    return found.select("page_id", F.posexplode("candidates").alias("rank", "c")).select(
        "page_id", "rank", "c.entity", "c.confidence"
    )


QUERIES = {
    "scaler_stats": scaler_stats,
    "standardized": standardized,
    "cosine_topk": nearest_prototypes,
    "cosine_topk_blocked": nearest_prototypes_blocked,
    "rca_scores": prototype_cosines,
    "network_scores": network_scores,
    "autoencoder_scores": autoencoder_scores,
    "autoencoder_losses": autoencoder_losses,
    "fine_tune": fine_tuned_scores,
    "encode": encoded_documents,
    "score_events": scored_events,
    "structured_scores": structured_scores,
    "detector_comparison": detector_comparison,
    "projection_gain": projection_gain,
    "root_cause": page_root_causes,
}

_UNNESTED = """v AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim
  FROM embeddings)"""

_STATS = f"""{_UNNESTED},
s AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS sd FROM v GROUP BY dim),
f AS (SELECT dim, mean, CASE WHEN sd > 0 THEN sd ELSE 1.0 END AS scale FROM s)"""

_MEANS = f"""{_UNNESTED},
m AS (SELECT label, dim, avg(x) AS x FROM v GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY dim) AS vector FROM m GROUP BY label)"""

_TOPK = f"""WITH {_MEANS},
r AS (SELECT vec_id, 'service-' || c.label AS entity,
             list_cosine_similarity(embedding::DOUBLE[], vector) AS confidence, c.label AS ord
      FROM embeddings CROSS JOIN c)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY confidence DESC, ord) AS rank,
       entity, round(confidence, 6) AS confidence
FROM r QUALIFY rank <= 3"""



def encode_sql(key: str, rows: str, text: str) -> str:
    """``vec(key, dim, x)``: the numbers of the default encoder's vectors that are not zero."""
    return f"""b AS (
  SELECT {key}, regexp_extract_all(hex(encode('<' || lower({text}) || '>')), '..') AS bytes
  FROM {rows}),
u AS (SELECT {key}, generate_subscripts(bytes, 1) AS i,
             ('0x' || unnest(bytes))::UBIGINT AS b0 FROM b),
w AS (SELECT {key}, b0, lead(b0, 1) OVER w AS b1, lead(b0, 2) OVER w AS b2, lead(b0, 3) OVER w AS b3
      FROM u WINDOW w AS (PARTITION BY {key} ORDER BY i)),
g AS (SELECT {key}, (b0 * 256 + b1) * 256 + b2 AS v FROM w WHERE b2 IS NOT NULL
      UNION ALL
      SELECT {key}, ((b0 * 256 + b1) * 256 + b2) * 256 + b3 FROM w WHERE b3 IS NOT NULL),
h AS (SELECT {key}, (v::UBIGINT * {FACTOR}::UBIGINT) // 128 AS h FROM g),
s AS (SELECT {key}, CAST((h // 2) % {schemas.EMBEDDING_DIM} AS INT) AS dim,
        sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS c FROM h GROUP BY 1, 2),
l AS (SELECT {key}, sqrt(sum(c * c)) AS len FROM s GROUP BY 1),
vec AS (SELECT {key}, dim, CAST(c / len AS FLOAT)::DOUBLE AS x FROM s JOIN l USING ({key}) WHERE c <> 0)"""


def network_sql(key: str, vectors: str) -> str:
    """``e(key, mse)`` of the written network over ``vectors(key, dim, x)``, every number of each."""
    return f"""z AS (SELECT {key}, dim, (x - 0.01) / 0.5 AS x FROM {vectors}),
units AS (SELECT unnest(range({_UNITS})) AS j),
hid AS (SELECT {key}, j,
        greatest(0.0, sum(x * ((dim * 7 + j * 3) % 11 - 5) / 50.0) + j / 100.0) AS h
      FROM z CROSS JOIN units GROUP BY {key}, j),
o AS (SELECT z.{key}, z.dim, z.x,
        sum(hid.h * ((z.dim * 5 + hid.j * 2) % 13 - 6) / 40.0) + z.dim / 1000.0 AS y
      FROM z JOIN hid USING ({key}) GROUP BY z.{key}, z.dim, z.x),
e AS (SELECT {key}, avg((x - y) * (x - y)) AS mse FROM o GROUP BY {key})"""


def tier_sql(threshold: float) -> str:
    return f"""CASE WHEN mse / {threshold} > 2 THEN 'high_anomaly' WHEN mse / {threshold} > 1 THEN 'low_anomaly'
            ELSE 'normal' END"""


ORACLES = {
    "scaler_stats": f"""WITH {_STATS}
SELECT dim, round(mean, 8) AS mean, round(scale, 8) AS scale FROM f""",
    "standardized": f"""WITH {_STATS}
SELECT vec_id, dim, round((x - mean) / scale, 6) AS z FROM v JOIN f USING (dim)""",
    "cosine_topk": _TOPK,
    "cosine_topk_blocked": _TOPK,
    "encode": f"""WITH {encode_sql("doc_id", "documents", "text")}
SELECT doc_id, dim, CAST(floor(x * 10000) AS BIGINT) AS x FROM vec""",
    "rca_scores": f"""WITH {_MEANS}
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], vector), 6) AS score
FROM embeddings JOIN c USING (label)""",
    "network_scores": f"""WITH {_UNNESTED},
{network_sql("vec_id", "v")}
SELECT vec_id, round(mse, 6) AS mse, 0.06::DOUBLE AS threshold, {tier_sql(0.06)} AS prediction FROM e""",
}
