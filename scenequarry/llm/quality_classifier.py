"""Quality classifier: regularised quadratic discriminant analysis.

Document statistics are transformed towards normality; each class has a mean and a covariance, shrunk
towards the pooled one and a scaled identity. A score is the posterior of class 1 from the difference of
the two log densities: half the Mahalanobis distances and log determinants, both from Cholesky factors
that are computed once and travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.llm.shared import learnable, store
from scenequarry.llm.statistics import document_statistics

#: Shares of the pooled covariance and of the scaled identity in each class's covariance.
POOLED, IDENTITY = 0.1, 0.01
#: Log density differences are divided by this before they become scores: statistics of one text depend on each other.
TEMPERATURE = 2.0
THRESHOLD = 0.7


def features() -> dict[str, Column]:
    """Transformed statistics by name. An empty text has 0 in all."""
    c = F.col
    ratio = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    return {
        "words": F.log1p("n_words"),
        "mean_word": F.log1p(ratio("word_chars", "n_words")),
        "symbols": F.log1p(50 * ratio("n_symbols", "n_words")),
        "dup_lines": F.log1p("n_dup_lines"),
        "dup_share": ratio("n_dup_lines", "n_lines"),
        "repeats": F.sqrt(ratio("n_repeat_words", "n_words")),
        "upper": F.log1p(50 * ratio("n_upper", "n_points")),
        "digits": F.log1p(50 * ratio("n_digits", "n_points")),
        "punctuation": F.log1p(50 * ratio("n_punct", "n_points")),
        "stops": F.log1p(100 * ratio("n_stops", "n_words")),
        "variety": F.when(c("n_distinct") > 0, F.log("n_distinct") - 0.85 * F.log("n_words")).otherwise(F.lit(0.0)),
        "echo": F.sqrt(ratio("n_echo", "n_words")),
        "long_words": F.sqrt(ratio("long_chars", "word_chars")),
        "line_length": F.log1p(ratio("n_words", "n_lines")),
    }


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and log priors of the classes 0 and 1."""

    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        log = [self.log_prior[k] - self.log_det[k] / 2 - (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(axis=1) / 2 for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / TEMPERATURE, -50, 50)))


def fit(examples: DataFrame, names: list[str]) -> Discriminant | None:
    """From ``examples(label 0 or 1, features…)``: counts, sums and products are summed in Spark, two rows reach the driver.

    None if a class has fewer than two examples.
    """
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = examples.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x) for x in names]).alias("s"), F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("p"))
    rows = {r["label"]: r for r in sums.collect()}
    if not all(k in rows and rows[k]["n"] > 1 for k in (0, 1)):
        return None
    n = np.array([rows[k]["n"] for k in (0, 1)], float)
    mean = np.array([rows[k]["s"] for k in (0, 1)]) / n[:, None]
    cov = np.zeros((2, d, d))
    for k in (0, 1):
        for (i, j), v in zip(pairs, rows[k]["p"], strict=True):
            cov[k, i, j] = cov[k, j, i] = v / n[k] - mean[k, i] * mean[k, j]
    pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    whiten, log_det = [], []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - POOLED - IDENTITY) * cov[k] + POOLED * pooled + IDENTITY * scale + 1e-9 * np.eye(d))
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(mean, np.array(whiten), np.array(log_det), np.log(n / n.sum()))


def classify_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``.

    Learns from labelled rows with crc32(doc_id) mod 4 other than 2 only; inputs are statistics of the whole text. An id
    labelled both ways counts as bad. Null and empty texts are scored as texts without words; a null
    doc_id isn't held out and never learnt from. Without examples of both classes the score is the share of class 1 among them,
    or 0.5. Repeated rows are scored each; empty tables give no rows; other columns are ignored.
    """
    made = features()
    names = list(made)
    table = store(document_statistics(documents).select("doc_id", *[v.cast("double").alias(k) for k, v in made.items()]), "quality-features")
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    examples = table.join(marked, "doc_id")
    model = fit(examples, names)
    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    if model is None:
        prior = examples.agg(F.avg("label")).first()[0]
        scored = table.select("doc_id", F.lit(0.5 if prior is None else float(prior)).alias("score"))
    else:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"doc_id": frame.doc_id, "score": model.score(frame[names].to_numpy())})

        scored = table.mapInPandas(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
