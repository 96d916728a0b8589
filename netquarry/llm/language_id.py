"""Language identification with a string kernel: Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: n-grams of 1 to LONGEST bytes of the lower-cased text are hashed to DIM presence features.
LONGEST, DIM = 4, 1 << 14
#: Bytes of text turned into features at once.
BYTES_AT_ONCE = 2 << 20


def presence(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, DIM) of 0 and 1: which hashed n-grams each text holds. data: the texts' bytes, joined."""
    found = np.zeros((len(sizes), DIM), np.uint8)
    flat, owner = found.reshape(-1), np.repeat(np.arange(len(sizes), dtype=np.int64) * DIM, sizes)
    h = np.zeros(len(data), np.uint32)
    for n in range(1, LONGEST + 1):
        last = data[n - 1 :].astype(np.uint32)
        h = h[: len(last)] * np.uint32(0x01000193) + last + np.uint32(1)
        same = owner[: len(last)] == owner[n - 1 :] if n > 1 else slice(None)
        at = ((h ^ h >> np.uint32(15)) * np.uint32(0x9E3779B1)) >> np.uint32(18)
        flat[(owner[: len(last)] + at)[same]] = 1
    return found


def _pieces(column: pa.Array) -> Iterator[np.ndarray]:
    """Presence features of the texts of a column in order, some at a time; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, "right")) - 1)
        to = min(to, at + 512)
        yield presence(data[offsets[at] : offsets[to]], np.diff(offsets[at : to + 1]))
        at = to


def _unit(packed: np.ndarray) -> np.ndarray:
    x = np.unpackbits(packed, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


class Model:
    """Landmarks as unit rows of presence features, and for each language the weight of each landmark."""

    def __init__(self, packed: np.ndarray, langs: list[str], landmarks: int, ridge: float):
        """packed: the rows' presence features, eight to a byte; they are unpacked some rows at a time."""
        self.langs = sorted(set(langs))
        of = np.array([self.langs.index(a) for a in langs])
        rank = np.empty(len(of), np.int64)  # of a row among those of its language: landmarks are dealt evenly
        for c in range(len(self.langs)):
            rank[of == c] = np.arange((of == c).sum())
        chosen = np.lexsort((of, rank))[:landmarks]
        self.marks = np.ascontiguousarray(_unit(packed[chosen]).T)
        values, vectors = np.linalg.eigh((self.marks.T @ self.marks).astype(np.float64))
        good = values > 1e-6 * values[-1]
        whiten = vectors[:, good] / np.sqrt(values[good])
        z = np.concatenate([(_unit(packed[at : at + 256]) @ self.marks).astype(np.float64) @ whiten for at in range(0, len(packed), 256)])
        y = np.where(of[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weight = 1 / np.bincount(of)[of]  # each language counts the same
        mean = y.T @ weight / weight.sum()
        left = (z * weight[:, None]).T @ z + ridge * weight.sum() / len(of) * np.eye(z.shape[1])
        self.weights = whiten @ np.linalg.solve(left, z.T @ ((y - mean) * weight[:, None]))
        self.bias = mean

    def predict(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its share of the clipped one-versus-rest values."""
        x = found.astype(np.float32)
        kernel = (x @ self.marks) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        value = np.clip((kernel @ self.weights + self.bias + 1) / 2, 1e-6, 1)
        best = value.argmax(axis=1)
        return best, value[np.arange(len(best)), best] / value.sum(axis=1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [row.tobytes() for part in _pieces(batch.column(2)) for row in np.packbits(part, axis=1)]
        yield pa.record_batch({"lang": batch.column(0), "h": batch.column(1), "bits": pa.array(bits, pa.binary())})


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 4000, landmarks: int = 256, ridge: float = 0.01) -> Model | None:
    """Fits on about ``sample`` distinct labelled texts (a bound), dealt evenly over the languages; None if no row has a text and a language.

    Texts are chosen by their hash alone, at least one of each language, and only their packed features (2 KB each) come to the driver.
    Of more than ``sample`` different labels the most frequent are learnt. Copies of a text count once.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col)).alias("text"), F.xxhash64(F.lit(1), F.col(text_col)).bitwiseAND(2**62 - 1).alias("h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    if not counts:
        return None
    each = max(1, sample // len(counts))
    most = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, max(r.least, int(min(1.0, 1.1 * each / r.n) * (2**62 - 1))))))
    chosen = rows.where(F.col("h") <= most[F.col("lang")]).dropDuplicates(["lang", "h"]).select("lang", "h", F.col("text").cast("binary"))
    got = chosen.mapInArrow(_packed, "lang string, h long, bits binary").orderBy("h", "lang").limit(2 * sample).collect()
    packed = np.frombuffer(b"".join(bytes(r.bits) for r in got), np.uint8).reshape(len(got), -1)
    return Model(packed, [r.lang for r in got], landmarks, ridge)


def predicted(model, text: Column) -> Column:
    """struct(lang_pred, score) of a text; ``und`` and 0 if it is null or has no letter, or nothing was learned. model: a broadcast."""

    @F.arrow_udf("lang_pred string, score double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        for column in columns:
            best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
            at = 0
            for part in _pieces(column):
                best[at : at + len(part)], score[at : at + len(part)] = m.predict(part)
                at += len(part)
            yield pa.StructArray.from_arrays([pa.array(np.array(m.langs, object)[best], pa.string()), pa.array(score)], ["lang_pred", "score"])

    nothing = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if model.value is None:
        return nothing
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.when(has_letter, run(F.when(has_letter, F.lower(text)).cast("binary"))).otherwise(nothing)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """Adds the column ``out_col`` (struct of lang_pred and score) to the rows of ``docs``; a column of that name is replaced.

    Texts are whole, however long; equal texts get equal results, and repeated rows repeated ones. Null texts, texts without a letter
    and every text where nothing was learned get ``und`` with score 0. An empty table gives an empty one. Other columns stay as they are.
    """
    return docs.withColumn(out_col, predicted(docs.sparkSession.sparkContext.broadcast(model), F.col(text_col)))
