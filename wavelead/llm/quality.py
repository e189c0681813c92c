"""Quality classifier: gradient-boosted trees over statistics of the text.

Labelled rows are learned from unless crc32(id) mod 5 is 0. At most ``SAMPLE``
of them are used, those whose ids hash lowest: the fit runs on the driver, on
that many rows of a few numbers each. Everything else covers all documents: one
pass reads the texts of the labelled ones, one scores every text.

Scores use the text alone. A null text counts as empty; empty texts have
statistics like any other. Without labels of both classes every score is the
rate of ones, (ones + 1) / (rows + 2). Labels of ids that occur repeatedly count
once for each label row; a null label or id is not learned from. A null id is
never learned from and shown as held out. Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelead.llm.boosting import Forest, fit
from wavelead.llm.text import split_words

SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
FEATURES = (
    "log_words",
    "word_length",
    "long_word",
    "symbols",
    "capitals",
    "digits",
    "marks",
    "exclamations",
    "bars",
    "other_bytes",
    "distinct_words",
    "top_word",
    "adjacent_repeats",
    "lines",
    "repeated_lines",
    "wordless",
)


def statistics(text: str | None) -> list[float]:
    """The ``FEATURES`` of a text: shares of its bytes or words, mean lengths, counts as logarithms."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = split_words(text)
    n, size = max(len(words), 1), max(len(raw), 1)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    capitals, small = byte[65:91].sum(), byte[97:123].sum()
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        max(map(len, counts), default=0) / 100,
        byte[list(b"#*$%&|<>")].sum() / size,
        capitals / max(capitals + small, 1),
        byte[48:58].sum() / size,
        byte[list(b".,;:?")].sum() / size,
        byte[33] / size,
        byte[124] / size,
        byte[128:].sum() / size,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(c for w, c in counts.items() if not any(map(str.isalnum, w))) / n,
    ]


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def labelled_statistics(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> pd.DataFrame:
    """``label`` and ``x`` of at most ``sample`` labelled documents outside the held-out fold."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col(label).cast("double").alias("label"))
        .where(F.col("label").isin(0.0, 1.0) & (remainder(F.col("labelled")) != 0))
        .orderBy(F.xxhash64("labelled"), "labelled", "label")
        .limit(sample)
    )
    # At most ``sample`` rows of two numbers.
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("labelled")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))],
                names=["doc_id", "label", "x"],
            )

    rows = joined.select("doc_id", "label", "text").mapInArrow(measure, "doc_id long, label double, x array<double>")
    return rows.dropDuplicates(["doc_id", "label"]).orderBy("doc_id", "label").toPandas()


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Forest:
    rows = labelled_statistics(docs, labels, label, sample)
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["label"].to_numpy(float))


def score_column(forest: Forest, text: Column) -> Column:
    """Score of a text column; 0 to 1, higher where label 1 is likelier."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return pd.Series(forest.score(x))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    forest = train(docs, labels, label, sample)
    scored = docs.select(
        F.col("doc_id").cast("long"), score_column(forest, F.col("text").cast("string")).alias("score")
    )
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    forest = train(docs, labels, label, sample)
    return docs.where(score_column(forest, F.col("text").cast("string")) >= THRESHOLD)
