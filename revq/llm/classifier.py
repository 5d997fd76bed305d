"""Document quality from a conditional random field over lines.

Every line is labelled good or bad from its own statistics and those of its
neighbours. The marginal probabilities of a document's lines, weighted by their
lengths, average to its score; a logistic curve fitted on the same sample brings the
scores to probabilities. Labels come from at most `sample_rows` labelled documents
outside the held-out fold; lang, source and doc_id are never inputs.

A null text counts as empty, and an empty text is one empty line; both get a score.
Where labels hold fewer than two classes, every document scores 1. Repeated rows score
alike; an empty table gives an empty result; a null doc_id is carried along, and is
not held out. `score` looks at doc_id and text alone; `with_scores` carries all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revq.llm import crf, stats
from revq.llm.blocks import Batches
from revq.llm.tokens import find_words, slices
from revq.llm.training import labelled

SAMPLE_ROWS = 4_000
LEAST_SCORE = 0.3


@dataclass
class Model:
    chain: crf.Chain
    slope: float
    offset: float


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and weight of each line, and lines per text."""
    words = find_words(column)
    start, end, doc = stats.line_bounds(words)
    c = stats.counts(words, words.hashes(), start, end)
    r = stats.ratios(c)
    # Shares act by being there at all as much as by their size.
    there = [r[k] > least for k, least in (("upper", 0.5), ("bangs", 0.2), ("symbols", 0.2), ("bars", 0.1), ("echoes", 0.1))]
    x = np.stack([*r.values(), *there], axis=1).astype(float)
    return x, c["chars"] + 1.0, np.bincount(doc, minlength=len(words.count))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _averages(chain: crf.Chain, x: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mean of the lines' probabilities of being good, weighted by length."""
    good = crf.line_scores(chain, x, crf.Layout(lengths))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(doc, good * weight, len(lengths)) / np.bincount(doc, weight, len(lengths))


def _curve(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the labels over the logits of the averages, by Newton steps."""
    x = np.stack([_logit(score), np.ones(len(score))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (good - p) - 0.1 * (theta - [1.0, 0.0])
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        theta = theta + np.linalg.solve(bend, slope)
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model for labels.quality; None if the labels hold one class or none."""

    def measure(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch):
                x, weight, lengths = _lines(part["text"])
                cuts = np.cumsum(lengths)[:-1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part["doc_id"],
                        "label": part["label"],
                        "x": pa.array([a.astype(np.float32).tobytes() for a in np.split(x, cuts)], pa.binary()),
                        "weight": pa.array([a.tobytes() for a in np.split(weight, cuts)], pa.binary()),
                    }
                )

    rows = labelled(docs, labels, "quality", sample_rows).select("doc_id", "label", "text")
    sample = rows.mapInArrow(measure, "doc_id long, label int, x binary, weight binary").toPandas()
    sample = sample.sort_values("doc_id")  # the order of rows must not change sums
    if sample["label"].nunique() < 2:
        return None
    weights = [np.frombuffer(w) for w in sample["weight"]]
    lengths = np.array([len(w) for w in weights])
    x = np.concatenate([np.frombuffer(b, np.float32) for b in sample["x"]]).reshape(lengths.sum(), -1).astype(float)
    good = sample["label"].to_numpy()
    chain = crf.fit(x, lengths, good)
    return Model(chain, *_curve(_averages(chain, x, np.concatenate(weights), lengths), good))


def with_scores(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """The documents with their score as a further column; no shuffle."""
    schema = T.StructType([f for f in docs.schema if f.name != column]).add(column, "double")
    names = [f.name for f in schema][:-1]

    def score(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch):
                if model is None or not part.num_rows:
                    p = np.ones(part.num_rows)
                else:
                    average = _averages(model.chain, *_lines(part["text"]))
                    p = 1 / (1 + np.exp(-(model.slope * _logit(average) + model.offset)))
                yield pa.RecordBatch.from_arrays([*[part[n] for n in names], pa.array(p, pa.float64())], [*names, column])

    return docs.select(*names).mapInArrow(score, schema)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted label."""
    scored = with_scores(docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text"), model)
    return scored.select("doc_id", "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
