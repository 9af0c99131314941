"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1. Unlabelled web text is every document of
the training fold; labels 0 are never used. With logistic loss the unbiased risk is

    -prior * mean(f over positives) + mean(log(1 + exp(f)) over unlabelled)

and its part for negatives, mean(log(1 + exp f) over unlabelled) - prior *
mean(log(1 + exp f) over positives), must not fall below zero, where it would only fit noise:
a step that leads there is halved until it does not.

The class prior is estimated without negatives: for any scorer and threshold t,
share(unlabelled >= t) >= prior * share(positives >= t), so the least ratio of the two
shares bounds the prior from above; it is taken where half the positives remain.

Every training document takes part in every step. A step is one Spark job over stored
statistics; it sends one row per coefficient (pair) to the driver, whatever the input.

Edge cases: a null text counts as empty; an empty text gets the score of a text
without words. A repeated doc_id is scored row by row; it is a trusted
positive if all its label rows say 1. A null doc_id is scored but never learnt from.
Without trusted positives all scores are 0.5. Ties at 0.5 are predicted 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corpusloom.llm import textstats
from corpusloom.llm.common import held_out
from corpusloom.session import written

STEPS = 25
RIDGE = 1e-3
#: Bound on the change of any coefficient in one step.
REACH = 5.0
TOLERANCE = 1e-3
#: Share of positives above the thresholds at which the prior is read.
LEAST_SHARE = 0.5
BINS = 2000


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float


def basis(x: np.ndarray) -> np.ndarray:
    """Each statistic, its root, and itself up to a tenth."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0)), np.minimum(x, 0.1)], axis=1)


def rows_of(x: pa.Array) -> np.ndarray:
    return np.asarray(x.flatten()).reshape(len(x), len(textstats.FEATURES))


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    return sigmoid(design(model, x) @ model.weights)


def design(model: Model, x: np.ndarray) -> np.ndarray:
    return np.c_[(basis(x) - model.centre) / model.scale, np.ones(len(x))]


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def training_rows(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the training fold and whether the document is a trusted positive."""
    trusted = (
        labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.min(F.coalesce("quality", F.lit(0))) == 1).alias("p"))
        .where("p")
    )
    return (
        measured.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", F.col("stats.x").alias("x"))
        .join(trusted, "doc_id", "left")
        .select("x", F.coalesce("p", F.lit(False)).alias("p"))
    )


def summed(rows: DataFrame, terms) -> np.ndarray:
    """Sum of ``terms(x, p)`` (a flat array per batch) over all rows, added up by Spark per place."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = terms(rows_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.float64())], ["place", "value"]
            )

    got = rows.select("x", "p").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(got))
    for row in got:
        out[row.place] = row.value
    return out


def standardised(rows: DataFrame) -> Model | None:
    def terms(x, p):
        z = basis(x)
        return np.concatenate([[len(z), p.sum()], z.sum(0), (z * z).sum(0)])

    sums = summed(rows, terms)
    if not len(sums) or not sums[1]:
        return None
    mean, square = np.split(sums[2:] / sums[0], 2)
    scale = np.sqrt(np.maximum(square - mean * mean, 0))
    scale[scale < 1e-9] = 1.0
    return Model(mean, scale, np.zeros(len(mean) + 1), 0.5)


def minimised(rows: DataFrame, model: Model, prior: float) -> Model:
    """Newton steps on the unbiased risk that keep the risk of negatives at zero or above."""
    size = len(model.weights)
    weights = now = step = np.zeros(size)
    for _ in range(STEPS):

        def terms(x, p, now=now):
            z = design(model, x)
            f = z @ now
            s, loss = sigmoid(f), np.logaddexp(0, f)
            curve = (z * (s * (1 - s))[:, None]).T @ z
            return np.concatenate(
                [[len(z), p.sum(), loss.sum(), loss[p].sum()], z[p].sum(0), s @ z, curve.ravel()]
            )

        sums = summed(rows, terms)
        n, positives, loss, loss_p = sums[:4]
        of_p, pulled, curve = np.split(sums[4:], [size, 2 * size])
        if loss / n - prior * loss_p / positives < 0:
            step = step / 2
            now = weights - step
            continue
        weights = now
        if step.any() and np.abs(step).max() < TOLERANCE:
            break
        slope = pulled / n - prior * of_p / positives + RIDGE * now
        step = np.linalg.solve(curve.reshape(size, size) / n + RIDGE * np.eye(size), slope)
        step *= min(1.0, REACH / max(np.abs(step).max(), 1e-12))
        now = weights - step
    return Model(model.centre, model.scale, weights, prior)


def estimated_prior(rows: DataFrame, model: Model) -> float:
    """Least ratio of the shares of unlabelled and positive rows above a score."""

    def terms(x, p):
        place = np.minimum((scores(model, x) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place[p], minlength=BINS)]).astype(float)

    everything, positives = np.split(summed(rows, terms), 2)
    above, above_p = (np.cumsum(v[::-1]) / v.sum() for v in (everything, positives))
    usable = above_p >= LEAST_SHARE
    return float(np.clip((above[usable] / above_p[usable]).min(), 0.01, 0.99))


def fit(measured: DataFrame, labels: DataFrame) -> Model | None:
    """``measured`` has doc_id and ``stats`` (``textstats.column``); None without trusted positives."""
    rows = written(training_rows(measured, labels))
    start = standardised(rows)
    if start is None:
        return None
    first = minimised(rows, start, start.prior)
    return minimised(rows, start, estimated_prior(rows, first))


def score(model: Model | None, stats: Column) -> Column:
    if model is None:
        return F.lit(0.5)

    def run(x: pa.Array) -> pa.Array:
        return pa.array(scores(model, rows_of(x)), pa.float64())

    return arrow_udf(run, "double")(stats["x"])


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the columns named in ``keep``.

    The statistics that the fit reads again and again are stored. Kept columns are not: with
    any, texts are measured a second time on the way to the scores, so no text is ever copied.
    """
    kept = [c for c in keep if c != "doc_id"]
    stats = textstats.column(F.col("text")).alias("stats")
    measured = written(docs.select("doc_id", stats))
    model = fit(measured, labels.select("doc_id", "quality"))
    rows = docs.select("doc_id", *kept, stats) if kept else measured
    scored = rows.select("doc_id", *kept, held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
