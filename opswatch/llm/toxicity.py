"""Toxicity categories by a chain of linear classifiers fitted with out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.llm.common import id_bucket
from opswatch.llm.quality import _minimise
from opswatch.session import cut_lineage

#: Labelled documents of either label that the chain is fitted on, at most, and the features it keeps.
SAMPLE_DOCS = 2_000
MOST_FEATURES = 2_048
FOLDS = 4
#: Log-likelihood ratio (G) of a kept feature's counts among toxic and clean documents, at least; chance gives 28 once in ten million.
LEAST_G = 28.0
TOXIC_FROM = 0.5
#: Weak labels of the earlier categories: a document labelled toxic that holds one of these words. The last category is
#: the label itself, which other languages and other words reach as well.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown", "fool", "dumb"),
    "contempt": ("pathetic", "worthless", "disgusting", "useless"),
    "dehumanising": ("scum", "trash", "vermin", "filth"),
}
LAST = "toxic"
_EDGE = b".,;:!?|\"'()[]{}*%&#$<>-"
_PREFIXES = (4, 5, 6, 7, 8)


def word_features(word: bytes) -> list[bytes]:
    """A word without edge punctuation, and its beginnings, which inflected words share."""
    word = word.strip(_EDGE)
    if not word:
        return []
    return [b"w" + word, *(b"%d" % n + word[:n] for n in _PREFIXES if len(word) > n)]


def text_features(text: bytes | None) -> set[bytes]:
    return {f for w in set(text.lower().split()) for f in word_features(w)} if text else set()


class _Known(dict):
    """The kept features of a word; forgotten when there are too many words."""

    def __init__(self, places: dict[bytes, int]):
        super().__init__()
        self.places = places

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = tuple(self.places[f] for f in word_features(word) if f in self.places)
        return value

    def rows(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Texts and features of the cells that are 1."""
        rows, cells = [], []
        for i, text in enumerate(texts):
            found = {p for w in set(text.lower().split()) for p in self[w]} if text else ()
            rows.extend([i] * len(found))
            cells.extend(sorted(found))
        return np.array(rows, np.int64), np.array(cells, np.int64)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit_linear(rows: np.ndarray, cells: np.ndarray, chain: np.ndarray, y: np.ndarray, width: int, ridge: float) -> np.ndarray:
    """Weights of the features, the earlier categories' probabilities and a constant; both labels weigh the same."""
    n = len(y)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        x = np.bincount(rows, theta[cells], minlength=n) + chain @ theta[width:-1] + theta[-1]
        p = _logistic(x)
        error = share * (p - y)
        value = -(share * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum()
        slope = np.concatenate([np.bincount(cells, error[rows], minlength=width), chain.T @ error, [error.sum()]])
        return value + ridge / 2 * theta[:-1] @ theta[:-1], slope + ridge * np.append(theta[:-1], 0)

    return _minimise(evaluate, np.zeros(width + chain.shape[1] + 1), 40)


@dataclass(frozen=True)
class Chain:
    """The kept features and a weight vector per category; a later one also weighs the earlier probabilities."""

    features: tuple[bytes, ...]
    names: tuple[str, ...]
    weights: tuple[np.ndarray, ...]

    def probabilities(self, rows: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
        """A column per category, each computed from the features and the columns before it."""
        out, width = np.zeros((n, len(self.names))), len(self.features)
        for c, theta in enumerate(self.weights):
            out[:, c] = _logistic(np.bincount(rows, theta[cells], minlength=n) + out[:, :c] @ theta[width : width + c] + theta[-1])
        return out


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, ...]] | None = None,
    sample_docs: int = SAMPLE_DOCS, most_features: int = MOST_FEATURES, folds: int = FOLDS, ridge: float = 1e-4,
) -> Chain:
    """Fit the chain on labelled documents whose crc32(doc_id as text) modulo 4 is not 2.

    At most ``sample_docs`` documents of either label are used, the first by a hash of the id. Features that occur in
    five of them or more are kept if their counts among toxic and clean documents give a likelihood ratio of ``LEAST_G``,
    the ``most_features`` clearest of them. Each category's model is
    fitted once per fold without the fold, to predict it; these out-of-fold probabilities, not those of a model that has seen the
    document, are what later categories are fitted on. Labels without both values leave a chain that answers 0.5.
    """
    categories = CATEGORIES if categories is None else categories
    names = (*categories, LAST)
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(id_bucket("doc_id", 4) != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    by = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == t).orderBy(by, "doc_id").limit(sample_docs) for t in (0, 1)]
    chosen = cut_lineage(chosen[0].union(chosen[1]))  # at most twice sample_docs rows

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(text_features(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.binary()))], names=["doc_id", "toxic", "features"]
            )

    text = F.col("text").cast("binary").alias("text")
    sample = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "toxic", "text")
    sample = cut_lineage(sample.mapInArrow(featured, "doc_id long, toxic int, features array<binary>"))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Chain((), names, tuple(np.zeros(c + 1) for c in range(len(names))))
    seen = sample.select("toxic", F.explode("features").alias("f")).groupBy("f")
    seen = seen.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t + c >= 5")
    n = F.col("t") + F.col("c")
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (n * share))).otherwise(0.0)
    everyone = size[0] + size[1]
    clear = 2 * (part(F.col("t"), size[1] / everyone) + part(F.col("c"), size[0] / everyone))
    seen = seen.withColumn("g", clear).where(F.col("g") >= LEAST_G)
    kept = sorted(bytes(r["f"]) for r in seen.orderBy(F.desc("g"), "f").limit(most_features).select("f").collect())
    places = {f: i for i, f in enumerate(kept)}
    words = {name: {b"w" + w.encode() for w in ws} for name, ws in categories.items()}
    wanted = kept + sorted({w for ws in words.values() for w in ws} - places.keys())
    held = F.array_intersect("features", F.array(*[F.lit(w) for w in wanted])).alias("features")
    rows = sample.select("doc_id", "toxic", held).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # bounded by sample and features

    toxic = np.array([r["toxic"] for r in rows], np.float64)
    found = [{bytes(f) for f in r["features"]} for r in rows]
    cells = [sorted(places[f] for f in fs if f in places) for fs in found]
    row_of = np.repeat(np.arange(len(rows)), [len(c) for c in cells])
    cell_of = np.array([p for c in cells for p in c], np.int64)
    fold = np.arange(len(rows)) % folds  # rows are in the order of a hash
    target = {name: toxic * np.array([bool(fs & words[name]) for fs in found]) for name in categories} | {LAST: toxic}
    chain, weights = np.zeros((len(rows), 0)), []
    for name in names:
        y, outside = target[name], np.zeros(len(rows))
        for f in range(folds):
            train = fold != f
            number = np.cumsum(train) - 1
            use = train[row_of]
            theta = _fit_linear(number[row_of[use]], cell_of[use], chain[train], y[train], len(kept), ridge)
            x = np.bincount(row_of, theta[cell_of], minlength=len(rows)) + chain @ theta[len(kept) : -1] + theta[-1]
            outside[~train] = _logistic(x)[~train]
        weights.append(_fit_linear(row_of, cell_of, chain, y, len(kept), ridge))
        chain = np.concatenate([chain, outside[:, None]], axis=1)
    return Chain(tuple(kept), names, tuple(weights))


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """Every document's probabilities: ``doc_id``, ``held_out``, one column per category, ``score`` (the last), ``predicted``.

    Whole texts are read. A null text counts as empty and has no feature. Repeated rows get equal scores, a row
    without an id is not held out, other columns are ignored, an empty table gives no rows.
    """
    names = chain.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known({f: i for i, f in enumerate(chain.features)})
        for batch in batches:
            p = chain.probabilities(*known.rows(batch.column(2).to_pylist()), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array((p[:, -1] >= TOXIC_FROM).astype(np.int32))],
                names=["doc_id", "held_out", *names, "score", "predicted"],
            )

    held_out = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    schema = "doc_id long, held_out boolean, " + "".join(f"{n} double, " for n in names) + "score double, predicted int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)
