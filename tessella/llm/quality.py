"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics of a text (lengths, shares of kinds of characters, repetition) are transformed by logs and square roots.
Each class has a mean and a covariance that is shrunk towards the diagonal of the pooled covariance. The score is
the posterior of class 1, from the difference of the two log densities; each Mahalanobis distance is one product with the
cached inverse of the covariance's Cholesky factor. Classes are fitted from sums and sums of products alone.

Defined results: null counts as empty; empty texts have statistics of zero and are scored as such; if one class has no
row, the score is that of the other; without any labelled row every score is 0.5; labels of null or repeated ids: null
ids and null labels don't count, an id labelled more than once counts with its largest label, for each of its rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialise, pieces, table, texts_of
from .rules import _MARKS, _SYMBOLS, _UPPER, repeated_words

THRESHOLD = 0.3
_DIGITS = b"0123456789"
NAMES = ("words", "word_length", "symbols", "marks", "upper", "digits", "repeated", "different", "top_word", "copied_lines", "marked_words", "line_words", "foreign")


def statistics(text: str) -> list[float]:
    """Transformed statistics, in the order of NAMES."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    # Shares count a few neutral characters, words or lines besides, so that short texts don't look extreme.
    body = sum(map(len, words)) + 60
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / body
    times = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = frozenset(_MARKS)
    return [
        float(np.log1p(n)),
        float(np.log(body / (n + 12))),
        float(np.sqrt(share(_SYMBOLS))),
        float(np.sqrt(share(_MARKS))),
        float(np.sqrt(share(_UPPER))),
        float(np.sqrt(share(_DIGITS))),
        repeated_words(words) / (n + 12),
        float(np.log((n + 12) / (len(times) + 12))),
        float(np.sqrt((max(times.values()) - 1) / (n + 12))),
        (len(lines) - len(set(lines))) / (len(lines) + 3),
        sum(w[-1] in marks for w in words) / (n + 12),
        float(np.log((n + 12) / (len(lines) + 1))),
        float(np.sqrt(len(raw.translate(None, bytes(range(128)))) / body)),
    ]


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``f``, the statistics of each text."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "f array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in pieces(batches, "text"):
            f = [statistics(t) for t in texts_of(rb, "text")]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), pa.array(f, pa.list_(pa.float64()))], [*keep, "f"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Log prior, mean, inverse Cholesky factor and log determinant of each class."""

    classes: list[tuple[int, float, np.ndarray, np.ndarray, float]]

    def score(self, f: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        logs = {}
        for label, prior, mean, inverse, logdet in self.classes:
            z = (f - mean) @ inverse.T
            logs[label] = prior - 0.5 * (z * z).sum(1) - 0.5 * logdet
        if not logs:
            return np.full(len(f), 0.5)
        if len(logs) == 1:
            return np.full(len(f), float(next(iter(logs))))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.2, floor: float = 1e-4) -> Discriminant:
    """From each class's count, sum and sum of outer products."""
    total = sum(n for n, _, _ in sums.values())
    if not total:
        return Discriminant([])
    mean_all = sum(s for _, s, _ in sums.values()) / total
    pooled = np.diag(sum(p for _, _, p in sums.values()) / total - np.outer(mean_all, mean_all)).clip(floor)
    out = []
    for label, (n, s, p) in sorted(sums.items()):
        mean = s / n
        cov = p / n - np.outer(mean, mean)
        # a class of few rows leans on the pooled variances more
        a = (shrink * n + len(s)) / (n + len(s))
        factor = np.linalg.cholesky((1 - a) * cov + a * np.diag(pooled) + floor * np.eye(len(s)))
        out.append((label, float(np.log(n / total)), mean, np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))
    return Discriminant(out)


def fit(labelled: DataFrame, shrink: float = 0.2) -> Discriminant:
    """``labelled`` has ``f`` and ``label`` (0 or 1). All its rows count; only sums leave the tasks."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for rb in batches:
            if not rb.num_rows:
                continue
            f = np.asarray(rb.column("f").flatten()).reshape(-1, d)
            y = np.asarray(rb.column("label"))
            for c in (0, 1):
                own = f[y == c]
                sums[c] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        for c in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([sums[c]], pa.list_(pa.float64()))], ["label", "v"])

    parts = labelled.select("f", F.col("label").cast("int").alias("label")).where("label in (0, 1)").mapInArrow(run, "label int, v array<double>")
    rows = parts.select("label", F.posexplode("v").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect()  # 2 x (1 + d + d * d) rows
    v = np.zeros((2, 1 + d + d * d))
    for r in rows:
        v[r.label, r.at] = r.v
    return discriminant({c: (v[c, 0], v[c, 1 : 1 + d], v[c, 1 + d :].reshape(d, d)) for c in (0, 1) if v[c, 0] > 0}, shrink)


def score(feats: DataFrame, model: Discriminant, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with score and predicted."""
    schema = ", ".join([*(f"`{c}` {feats.schema[c].dataType.simpleString()}" for c in keep), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            f = np.asarray(rb.column("f").flatten()).reshape(rb.num_rows, len(NAMES))
            s = np.round(model.score(f), 9)
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return feats.select(*keep, "f").mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    rest = crc_mod("doc_id", 5)
    feats = materialise(features(docs.select("doc_id", "text", (rest == 0).alias("held_out"), (rest > 0).alias("learn")), ("doc_id", "held_out", "learn")), "quality-features")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = fit(feats.where("learn").join(known, "doc_id"))
    return score(feats, model, ("doc_id", "held_out"))


QUERIES = {"op2_quality": op2_quality}
ORACLE_SQL: dict[str, str] = {}
