"""A regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from sums over the labelled documents, one
aggregate however many there are. A covariance is shrunk towards the pooled one
and then towards the pooled diagonal. The Cholesky factor of each is computed
once; a score is the logistic of the difference of Mahalanobis log densities
and log priors, by two triangular products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, parts, written
from tidemark.llm.quality_rules import _repeat_and_adjacent

#: Shrinkage towards the pooled covariance, and towards its diagonal.
TO_POOLED = 0.3
TO_DIAGONAL = 0.1
THRESHOLD = 0.3

FEATURES = [
    "log_words", "log_word_length", "symbols", "upper", "repeated", "adjacent", "distinct", "duplicate_lines",
    "log_line_words", "digits", "stops", "exclaims", "rare_bytes",
]
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)


def features(text: bytes | None) -> np.ndarray:
    """The transformed statistics of one text in UTF-8; all 0 without words."""
    words = text.split() if text else []
    if not words:
        return np.zeros(len(FEATURES))
    n = len(words)
    octets = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    marks = max(int(octets.sum() - octets[9:14].sum() - octets[32]), 1)
    upper, lower = int(octets[65:91].sum()), int(octets[97:123].sum())
    repeat, adjacent = _repeat_and_adjacent(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    root = lambda a, b: (a / max(b, 1)) ** 0.5  # noqa: E731  spreads small shares
    return np.array([
        np.log1p(n), np.log(marks / n), root(int(octets[_SYMBOLS].sum()), marks), root(upper, upper + lower), root(repeat, n), root(adjacent, n),
        np.log1p(len(set(words))) / np.log1p(n), root(len(lines) - len(set(lines)), len(lines)), np.log1p(n / max(len(lines), 1)),
        root(int(octets[48:58].sum()), marks), root(int(octets[[33, 44, 46, 58, 59, 63]].sum()), marks), root(int(octets[33]), marks), root(int(octets[128:].sum()), marks),
    ])


def _feature_batches(batches):
    for batch in parts(batches, 1):
        found = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], names=["doc_id", *FEATURES])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every row of ``docs``, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return written(rows.mapInArrow(frugal(_feature_batches), "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)))[0]


@dataclass
class Discriminant:
    """Means, cached Cholesky factors (inverted) and offsets of class 0 and class 1."""

    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        logs = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offsets)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    @classmethod
    def of(cls, counts, sums, products, to_pooled=TO_POOLED, to_diagonal=TO_DIAGONAL) -> "Discriminant":
        counts = np.asarray(counts, dtype=float)
        means = sums / counts[:, None]
        scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(axis=0) / counts.sum()
        floor = np.diag(np.diag(pooled) + 1e-6)
        whiten, offsets = [], []
        for n, s in zip(counts, scatter):
            sigma = (1 - to_diagonal) * ((1 - to_pooled) * s / n + to_pooled * pooled) + to_diagonal * floor
            factor = np.linalg.cholesky(sigma)
            whiten.append(np.linalg.inv(factor))
            offsets.append(np.log(n / counts.sum()) - np.log(np.diag(factor)).sum())
        return cls(means, np.array(whiten), np.array(offsets))


@dataclass
class Constant:
    """Stands in where the labels hold fewer than two classes: the smoothed share of class 1."""

    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def fit(rows: DataFrame, label: str = "quality") -> Discriminant | Constant:
    """Fit on rows with the features and a label of 0 or 1; other labels are left out.

    Sums are taken about the features' means over all labelled rows, so that
    covariances keep their digits at any number of rows.
    """
    rows = rows.where(F.col(label).isin(0, 1))
    middle = np.array([x or 0.0 for x in rows.agg(*(F.avg(f) for f in FEATURES)).first()])
    off = [F.col(f) - F.lit(float(m)) for f, m in zip(FEATURES, middle)]
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(off)] + [F.sum(off[i] * off[j]).alias(f"p{i}_{j}") for i, j in pairs]
    found = {r[label]: r for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    if len(found) < 2:
        n = {k: r["n"] for k, r in found.items()}
        return Constant((n.get(1, 0) + 1) / (sum(n.values()) + 2))
    d = len(FEATURES)
    total, products = np.zeros((2, d)), np.zeros((2, d, d))
    for k, r in found.items():
        total[k] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            products[k, i, j] = products[k, j, i] = r[f"p{i}_{j}"]
    model = Discriminant.of([found[0]["n"], found[1]["n"]], total, products)
    model.means = model.means + middle
    return model


def held_out():
    """True for the fold that labels are never learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality; other columns
    are ignored. Labels of the held-out fold, null labels and labels without a
    document are not used; several labels of one document all count. Null and
    empty texts have features of 0 and get the score of those. Where the labels
    hold fewer than two classes, all scores are the smoothed share of class 1.
    """
    rows = featured(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out())
    model = fit(rows.join(known, "doc_id"))

    def run(batches):
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", held_out().alias("held_out"), *FEATURES).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
