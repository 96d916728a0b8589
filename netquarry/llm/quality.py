"""Quality scores from a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte classes whose shares of a text are statistics.
CLASSES = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "newline": b"\n", "stop": b".,;:", "shout": b"!?",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "quote": b"\"'()-", "beyond": bytes(range(128, 256)),
}
MASKS = np.array([[b in members for b in range(256)] for members in CLASSES.values()], np.float64).T
NAMES = ["bytes", "words", *CLASSES, "word_length", "word_spread", "distinct_words", "top_word", "distinct_lines", "entropy", "ended"]


def statistics(text: bytes | None) -> np.ndarray:
    """The statistics of one whole text on scales where they are near normal: logs of counts, roots of shares. Null counts as empty."""
    text = text or b""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts @ MASKS / n
    p = counts[counts > 0] / n
    words = text.lower().split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    lines = text.split(b"\n")
    ended = sum(w[-1:] in (b".", b",", b"!", b"?", b":", b";") for w in seen) / max(1, len(seen))
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), *np.sqrt(shares), np.log1p(lengths.mean()), np.log1p(lengths.std()),
        np.log1p(len(seen)) / np.log1p(m), np.sqrt(max(seen.values(), default=0) / m), len(set(lines)) / len(lines), float(-(p * np.log2(p)).sum()), np.sqrt(ended),
    ])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def document_statistics(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        rows = [statistics(t.as_py()) for t in column]
        flat = np.concatenate(rows) if rows else np.zeros(0)
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(NAMES), pa.int32()), pa.array(flat))


class Model:
    """Means, inverses of the cached Cholesky factors, and log priors of the two classes."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, pool: float = 0.2):
        d = len(NAMES)
        total = sum(n for n, _, _ in moments.values())
        cov = {c: s2 / n - np.outer(s1 / n, s1 / n) for c, (n, s1, s2) in moments.items()}
        pooled = sum(n * cov[c] for c, (n, _, _) in moments.items()) / max(total, 1)
        self.mean, self.factor, self.offset = {}, {}, {}
        for c, (n, s1, _) in moments.items():
            mixed = (1 - pool) * cov[c] + pool * pooled
            mixed = (1 - shrink) * mixed + shrink * np.diag(np.diag(mixed)) + 1e-4 * np.eye(d)
            self.mean[c] = s1 / n
            factor = np.linalg.cholesky(mixed)
            self.factor[c] = np.linalg.inv(factor)  # of a triangle of this size, so that batches are one product each
            self.offset[c] = np.log(n / total) - np.log(np.diag(factor)).sum()

    def log_density(self, x: np.ndarray, c: int) -> np.ndarray:
        """Log of prior times density, without the constant that both classes share."""
        z = (x - self.mean[c]) @ self.factor[c].T
        return self.offset[c] - 0.5 * (z * z).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if 0 not in self.mean or 1 not in self.mean:
            return np.full(len(x), 1.0 if 1 in self.mean else 0.0 if 0 in self.mean else 0.5)
        return 1 / (1 + np.exp(-np.clip(self.log_density(x, 1) - self.log_density(x, 0), -500, 500)))


def train(features: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """Fits on all labelled rows of ``features(doc_id, features)``. Only the sums of each class reach the driver.

    A repeated label counts as often as it stands, for each row of its document; conflicting labels count in both classes. Null labels
    and labels of unknown documents are left out. Without a labelled row the model scores 0.5 everywhere, with one class only 0 or 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(label), -1)
            for c in np.unique(label):
                own = x[label == c]
                sums[int(c)] = sums.get(int(c), 0) + np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for c, v in sums.items():
            yield pa.record_batch({"label": pa.array(np.full(len(v), c), pa.int64()), "at": pa.array(np.arange(len(v)), pa.int32()), "v": pa.array(v)})

    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("of"), F.col(label_col).cast("long").alias("label"))
    rows = features.join(known, features[id_col] == known["of"]).select("label", "features")
    got = rows.mapInArrow(run, "label long, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    d = len(NAMES)
    moments = {}
    for c in {r.label for r in got}:
        v = np.zeros(1 + d + d * d)
        for r in got:
            if r.label == c:
                v[r.at] = r.v
        moments[c] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return Model(moments)


def scored(features: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` (likelihood of label 1, 0 to 1) and ``predicted`` (1 from 0.5 on).

    Each row is scored by its text's statistics alone, null and empty texts too. Without training rows
    the score is 0.5, with one class only 0 or 1. Very long texts count whole. Repeated rows get repeated results, an empty
    table an empty one; other columns of ``features`` stay, but for ``score`` and ``predicted``, which are replaced.
    """
    held = features.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(held.value.score(column.flatten().to_numpy().reshape(len(column), -1)), pa.float64())

    return features.withColumn("score", run("features")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
