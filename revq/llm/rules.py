"""Quality rules: base rules on document counts, then boosted trees over document statistics.

Trees are fitted on at most `sample_rows` labelled documents outside the held-out fold
and flattened into node arrays, with which every task scores its documents. The
probability of being good may only fall with the shares of symbols, bars, exclamation
marks, repeated lines, repeated windows and echoed words.

A null text has no words and fails the base rules, as does any text of fewer than 20
words. Where labels hold fewer than two classes, the base rules alone decide. Repeated
rows are judged alike; an empty table gives an empty result; a null doc_id is carried
along. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revq.llm import boosting, stats
from revq.llm.blocks import Batches
from revq.llm.tokens import find_words, slices
from revq.llm.training import labelled

SAMPLE_ROWS = 10_000
LEAST_PROBABILITY = 0.5
FEATURES = {  # name: constraint on the probability of being good
    "log_words": 0, "word_length": 0, "upper": 0, "digits": 0, "bangs": -1, "symbols": -1, "bars": -1,
    "points": 0, "repeats": 0, "echoes": -1, "repeated_lines": -1, "repeated_words": -1,
}
RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, probability double"
)


def _measure(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts that are reported, and the features."""
    words = find_words(column)
    hashes = words.hashes()
    c = stats.counts(words, hashes, words.offsets[:-1], words.offsets[1:])
    dup, repeat = stats.repeated_lines(words), stats.repeated_words(words, hashes)
    lines = np.maximum(np.bincount(stats.line_bounds(words)[2], minlength=len(words.count)), 1)
    r = stats.ratios(c) | {"repeated_lines": dup / lines, "repeated_words": repeat / np.maximum(c["words"], 1)}
    reported = {
        "n_words": c["words"], "word_chars": c["word_chars"], "n_symbols": c["symbols"],
        "n_dup_lines": dup, "n_repeat_words": repeat,
    }
    return reported, np.stack([r[name] for name in FEATURES], axis=1)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> boosting.Trees | None:
    """Trees for labels.quality; None if the labels hold one class or none."""

    def measure(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch):
                _, x = _measure(part["text"])
                features = pa.array(list(x.astype(float)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], features], ["doc_id", "label", "x"])

    rows = labelled(docs, labels, "quality", sample_rows).select("doc_id", "label", "text")
    sample = rows.mapInArrow(measure, "doc_id long, label int, x array<double>").toPandas()
    sample = sample.sort_values("doc_id")  # the order of rows must not change sums
    if sample["label"].nunique() < 2:
        return None
    x = np.stack(sample["x"].to_numpy())
    return boosting.fit(x, sample["label"].to_numpy(float), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, trees: boosting.Trees | None, least: float = LEAST_PROBABILITY) -> DataFrame:
    """Counts and verdict per document; no shuffle."""

    def judged(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch):
                reported, x = _measure(part["text"])
                n = reported["n_words"]
                failed = (n < 20) | (100 * reported["n_repeat_words"] > 30 * n)
                p = trees.probability(x) if trees else np.ones(len(n))
                columns = {name: pa.array(v, pa.int64()) for name, v in reported.items()}
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part["doc_id"]} | columns
                    | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= least)), "probability": p}
                )

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(judged, RESULT)
