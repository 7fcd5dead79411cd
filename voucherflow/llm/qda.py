"""Operator 8: regularised quadratic discriminant over transformed document statistics.

Statistics of the whole text (lengths, ratios of kinds of characters, repetition) are put on log or square-root scales. Each class of
``labels.quality`` gets a mean and a covariance from sums that Spark adds up; the covariance is shrunk to the pooled one
by ``pool`` and to its own diagonal by ``ridge``. Its Cholesky factor is computed once and shipped with the scoring tasks; a score is the
logistic of the difference of the Gaussian log densities plus that of the log priors.

Only doc_id is used to find labels; lang, source, labels and doc_id never enter a score.

Defined cases: null and empty texts are scored as texts without words; rows of ``labels`` with a null doc_id or a quality other than
0 or 1 are left out; a null doc_id is scored and never trained on; repeated rows count as often as they occur; without labels of both
classes the score is the smoothed share of the label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, fold, pick, table, written
from .textstats import stats

D = 20


def features(text: bytes) -> list[float]:
    s = stats(text)
    words, chars, lines = max(1, s["n_words"]), max(1, s["word_chars"]), max(1, s["n_lines"])
    share = lambda n, of: (n / of) ** 0.5
    letters = max(1, s["n_upper"] + s["n_lower"])
    return [
        np.log1p(s["n_words"]),
        np.log1p(s["n_lines"]),
        np.log(chars / words),
        np.log1p(s["longest_word"]),
        np.log1p(s["longest_line"]),
        np.log1p(s["n_words"] / lines),
        np.log1p(s["n_words"] / max(1, s["n_stops"])),
        share(s["n_distinct"], words),
        share(s["n_dup_lines"], lines),
        share(s["n_repeat_words"], words),
        share(s["n_symbols"], chars),
        share(s["n_bars"], chars),
        share(s["n_shouts"], chars),
        share(s["n_upper"], letters),
        share(s["n_digit"], chars),
        share(s["n_marks"], chars),
        share(s["n_stops"], chars),
        share(s["n_ended_lines"], lines),
        share(max(0, chars - s["n_upper"] - s["n_lower"] - s["n_digit"] - s["n_marks"] - s["n_symbols"]), chars),
        share(s["n_lower"], chars),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.array(features(t)).tobytes() for t in batch["text"].cast(pa.binary()).to_pylist()]
        yield pa.record_batch([batch["doc_id"], pa.array(x, pa.binary())], names=["doc_id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the products of (1, x) with itself, by class, as cells."""
    total = np.zeros((2, D + 1, D + 1))
    for batch in batches:
        y = batch["quality"].to_numpy()
        x = np.frombuffer(b"".join(batch["x"].to_pylist())).reshape(len(y), D)
        x = np.c_[np.ones(len(y)), x]
        for c in (0, 1):
            total[c] += x[y == c].T @ x[y == c]
    yield pa.record_batch({"cell": np.arange(total.size), "v": total.ravel()})


class Model:
    """Means, Cholesky factors and priors of the two classes."""

    def __init__(self, total: np.ndarray, pool: float, ridge: float):
        self.n = total[:, 0, 0]
        self.whole = bool((self.n > 1).all())
        if not self.whole:
            return
        self.mean = total[:, 0, 1:] / self.n[:, None]
        own = total[:, 1:, 1:] / self.n[:, None, None] - self.mean[:, :, None] * self.mean[:, None, :]
        pooled = (self.n[:, None, None] * own).sum(0) / self.n.sum()
        scale = np.diag(np.diag(pooled) + 1e-6)
        mixed = (1 - pool) * own + pool * pooled
        self.factor = np.linalg.cholesky((1 - ridge) * mixed + ridge * scale)
        self.inverse = np.linalg.inv(self.factor)
        self.half_log_det = np.log(np.diagonal(self.factor, axis1=1, axis2=2)).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.whole:
            return np.full(len(x), (self.n[1] + 1) / (self.n.sum() + 2))
        log = [-0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(1) - self.half_log_det[c] + np.log(self.n[c]) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _score(model: Model, threshold: float):
    """Scores of written statistics, or of texts: one Python worker a task either way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "x" in batch.schema.names:
                x = np.frombuffer(b"".join(batch["x"].to_pylist())).reshape(batch.num_rows, D)
            else:
                x = np.array([features(t) for t in batch["text"].cast(pa.binary()).to_pylist()]).reshape(batch.num_rows, D)
            score = model.score(x)
            keep = [c for c in batch.schema.names if c != "x"]
            yield pa.record_batch([*(batch[c] for c in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return run


def fit(points: DataFrame, labels: DataFrame, train: Column, pool: float, ridge: float) -> Model:
    """From rows (doc_id, x) and labels (doc_id, quality), using those for which ``train`` holds."""
    marked = pick(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & train)
    cells = points.where(train).join(marked, "doc_id").select("x", "quality").mapInArrow(_moments, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(2 * (D + 1) ** 2)
    total[cells["cell"].to_numpy()] = cells["v"].to_numpy()
    return Model(total.reshape(2, D + 1, D + 1), pool, ridge)


def quality_scores(docs: DataFrame, labels: DataFrame, *columns: str, pool: float = 0.3, ridge: float = 0.05, threshold: float = 0.3) -> DataFrame:
    """doc_id, the further ``columns``, held_out, score, predicted; learns where crc32(doc_id) mod 5 is not 0.

    The statistics are written once, without the texts. Only where columns must be carried are they computed
    again beside them: that costs a second reading, but neither a copy of the texts on disk nor a shuffle of them.
    """
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    docs = pick(docs, "doc_id", *dict.fromkeys(["text", *columns])).withColumn("text", F.coalesce("text", F.lit("")))

    points = written(docs.select("doc_id", "text").mapInArrow(_features, "doc_id long, x binary"), "qda-features")
    model = fit(points, labels, ~held, pool, ridge)
    rows = (docs if columns else points).withColumn("held_out", held)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("x").dtypes)
    out = rows.mapInArrow(_score(model, threshold), f"{schema}, score double, predicted int")
    return out.select("doc_id", *columns, "held_out", "score", "predicted")


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality_scores(docs, labels)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier accepts."""
    labels = table(spark, sf_dir, "labels")
    scored = quality_scores(docs, labels, *[c for c in DOCUMENT_COLUMNS if c != "doc_id"])
    return scored.where("predicted = 1").select(*DOCUMENT_COLUMNS)
