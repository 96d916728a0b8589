"""Token log-probabilities from a log-bilinear model that is trained with noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import cut

#: Classes of the model: the most frequent words, the end of a text, and groups of all other words by their last bytes.
WORDS, GROUPS = 767, 256
END = WORDS
CLASSES = WORDS + 1 + GROUPS
#: Words whose counts are broadcast; those of all others are joined.
HEAD = 100_000
#: Counter entries of a task before they are sent on.
ENTRIES = 300_000
#: Rounds of training. Each training text is learnt from whole, in the round that its hash names; after a round the tasks' networks are averaged.
ROUNDS = 4
#: A task learns from so many tokens at least, and all tasks together from so many: a smaller corpus is gone through several times.
TASK_TOKENS, LEAST_TOKENS = 500_000, 4_000_000
#: Tokens that a task mixes before it learns from them; a minibatch and its shared noise words.
AT_ONCE, BATCH, NOISES = 1 << 17, 2048, 128
#: Parts of a network's parameters that are averaged apart.
PARTS = 16


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def group_of(word: bytes) -> int:
    """Class of a word that isn't among the most frequent."""
    return WORDS + 1 + zlib.crc32(word[-3:]) % GROUPS


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` over ``docs(text binary)``, counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(seen: Counter) -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(list(seen), pa.binary()), "c": pa.array(list(seen.values()), pa.int64())})

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                if len(seen) >= ENTRIES:
                    yield sent(seen)
                    seen.clear()
        yield sent(seen)

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Network:
    """P(class | two classes before): the context's prediction is a sum of one matrix product for each position."""

    def __init__(self, unigram: np.ndarray, dim: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.context = rng.normal(0, 0.1, (CLASSES, dim)).astype(np.float32)
        self.target = rng.normal(0, 0.1, (CLASSES, dim)).astype(np.float32)
        self.position = [np.eye(dim, dtype=np.float32), np.eye(dim, dtype=np.float32) / 2]
        self.noise = unigram / unigram.sum()
        self.bias = np.log(self.noise).astype(np.float32)
        self.squares = [np.full_like(x, 1e-4) for x in (self.context, self.target, *self.position, self.bias)]

    def state(self) -> list[np.ndarray]:
        return [self.context, self.target, *self.position, self.bias, *self.squares]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.state()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.state():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def learn(self, texts: list[np.ndarray], rng: np.random.Generator, rate: float = 0.3) -> None:
        """One pass of noise-contrastive estimation with Adagrad; the noise words of a batch are shared, so scores are matrix products."""
        now = np.concatenate(texts)
        one = np.concatenate([np.r_[END, t[:-1]] for t in texts])
        two = np.concatenate([np.r_[END, END, t[:-2]][: len(t)] for t in texts])
        log_noise = (np.log(self.noise) + np.log(NOISES)).astype(np.float32)
        cum = np.cumsum(self.noise)

        def step(k: int, value: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
            self.squares[k][rows] += grad * grad
            value[rows] += rate * grad / np.sqrt(self.squares[k][rows])

        def summed(ids: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            return ids[starts], np.add.reduceat(grad[order], starts)

        def sigmoid(x: np.ndarray, scale: float) -> np.ndarray:
            """scale / (1 + exp(x)), in the place of x."""
            np.exp(x, out=x)
            x += 1
            return np.divide(np.float32(scale), x, out=x)

        order = rng.permutation(len(now))
        with np.errstate(over="ignore"):
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                w, a, b = now[pick], one[pick], two[pick]
                noise = np.minimum(np.searchsorted(cum, rng.random(NOISES)), CLASSES - 1).astype(w.dtype)
                qa, qb = self.context[a], self.context[b]
                guess = qa @ self.position[0] + qb @ self.position[1]
                rw, rn = self.target[w], self.target[noise]
                true = np.einsum("ij,ij->i", guess, rw)
                true += self.bias[w] - log_noise[w]
                false = guess @ rn.T
                false += self.bias[noise] - log_noise[noise]
                up = sigmoid(true, 1 / len(pick))
                down = sigmoid(np.negative(false, out=false), -1 / len(pick))
                g_guess = down @ rn
                grad = np.empty((len(w) + NOISES, guess.shape[1] + 1), np.float32)
                np.multiply(guess, up[:, None], out=grad[: len(w), :-1])
                grad[len(w) :, :-1] = down.T @ guess
                grad[: len(w), -1], grad[len(w) :, -1] = up, down.sum(axis=0)
                g_guess += rw * up[:, None]
                rows, g = summed(np.concatenate([w, noise]), grad)
                step(1, self.target, g[:, :-1], rows)
                step(4, self.bias, g[:, -1], rows)
                rows, g = summed(np.concatenate([a, b]), np.concatenate([g_guess @ self.position[0].T, g_guess @ self.position[1].T]))
                for i, q in enumerate((qa, qb)):
                    step(2 + i, self.position[i], q.T @ g_guess)
                step(0, self.context, g, rows)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 parts of each class after each class at distance 1 (bias included) and 2, and of the normaliser of each pair.

        The normaliser of all pairs at once is one matrix product of the exponentials.
        """
        first = (self.context @ self.position[0]) @ self.target.T + self.bias
        second = (self.context @ self.position[1]) @ self.target.T
        a, b = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
        z = np.exp(first - a).astype(np.float64) @ np.exp(second - b).astype(np.float64).T
        norm = np.log(z) + a + b.T
        ten = np.log(10)
        return (first / ten).astype(np.float32), (second / ten).astype(np.float32), (norm / ten).astype(np.float32)


@dataclass
class Model:
    index: dict[bytes, int]  # of the head's words
    head_class: np.ndarray
    head_log: np.ndarray  # log10(c + 1)
    end_count: int
    tokens: int
    distinct: int
    share: np.ndarray  # log10 of a class's count + distinct + 1; 0 for classes of one word
    first: np.ndarray
    second: np.ndarray
    norm: np.ndarray

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class and head index (-1 beyond the head) of each word."""
        at = np.fromiter((self.index.get(w, -1) for w in words), np.int64, len(words))
        out = self.head_class[at] if len(self.head_class) else np.zeros(len(words), np.int64)
        for i in np.flatnonzero(at < 0).tolist():
            out[i] = group_of(words[i])
        return out, at

    def parts(self, text: bytes | None) -> tuple[int, int, float, float, bytes]:
        """Tokens, known head tokens, base and model log10 without log10(c + 1) of words beyond the head, and those words."""
        words = words_of(text)
        classes, at = self.classes(words)
        known = at >= 0
        log_count = self.head_log[at[known]]
        base = float(log_count.sum()) + np.log10(self.end_count + 1) - (len(words) + 1) * np.log10(self.tokens + self.distinct + 1)
        w = np.r_[classes, END]
        a, b = np.r_[END, w[:-1]], np.r_[END, END, w[:-2]][: len(w)]
        value = (self.first[a, w] + self.second[b, w] - self.norm[a, b]).sum(dtype=np.float64) - self.share[w].sum()
        value += float(log_count[self.head_class[at[known]] > END].sum())
        return len(words) + 1, int(known.sum()) + (self.end_count > 0), base, float(value), b" ".join(words[i] for i in np.flatnonzero(~known).tolist())


def _learn(held, epochs: int, seed: int):
    """Learns from the texts of a partition, starting from the network of ``held``; emits the parts of its parameters with the tokens behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, network = held.value
        rng, tokens, kept, size = np.random.default_rng(seed), 0, [], 0
        again: list[list[np.ndarray]] = []  # held in a small corpus only
        for batch in batches:
            for text in batch.column(0):
                kept.append(np.r_[model.classes(words_of(text.as_py()))[0], END].astype(np.uint16))
                size += len(kept[-1])
                if size >= AT_ONCE:
                    network.learn(kept, rng)
                    tokens += size
                    if epochs > 1:
                        again.append(kept)
                    kept, size = [], 0
        if kept:
            network.learn(kept, rng)
            tokens += size
            again.append(kept)
        for _ in range(epochs - 1):
            for texts in again:
                network.learn(texts, rng)
        if tokens:
            parts = np.array_split(network.flat(), PARTS)
            yield pa.record_batch({"part": pa.array(range(PARTS), pa.int32()), "tokens": pa.array([tokens] * PARTS, pa.int64()), "values": pa.array([p.tobytes() for p in parts], pa.binary())})

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the parts, weighted by tokens; rows are taken one by one."""
    sums: dict[int, list] = {}
    for batch in batches:
        for part, tokens, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(values, np.float32).astype(np.float64) * tokens
            if part in sums:
                sums[part][0] += tokens
                sums[part][1] += x
            else:
                sums[part] = [tokens, x]
    yield pa.record_batch({"part": pa.array(list(sums), pa.int32()), "tokens": pa.array([n for n, _ in sums.values()], pa.int64()), "values": pa.array([(x / n).astype(np.float32).tobytes() for n, x in sums.values()], pa.binary())})


def fit(docs: DataFrame, model: Model, unigram: np.ndarray, tokens: int) -> Network:
    """The network fitted on every text of ``docs(text binary)``. Texts stay in their tasks; only parameters (half a megabyte a task and round) move."""
    network, sc = Network(unigram), docs.sparkSession.sparkContext
    epochs, schema = max(1, -(-LEAST_TOKENS // max(1, tokens))), "part int, tokens long, values binary"
    turn = F.pmod(F.xxhash64(F.lit(3), F.coalesce("text", F.lit(b""))), F.lit(ROUNDS))
    for n in range(ROUNDS):
        held = sc.broadcast((model, network))
        learnt = docs.where(turn == n).coalesce(max(1, tokens // TASK_TOKENS)).mapInArrow(_learn(held, epochs, n), schema)
        got = sorted(learnt.repartition(PARTS, "part").mapInArrow(_averaged, schema).collect())
        if got:
            network.load(np.concatenate([np.frombuffer(r["values"], np.float32) for r in got]))
        held.unpersist()
    return network


def train(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """Counts and a network over all of ``docs``; returns the model and ``word, c`` of every word. Null texts are empty ones, very long ones count whole."""
    docs = docs.select(F.col(text_col).cast("binary").alias("text"))
    counts = cut(word_counts(docs))
    ends = docs.count()
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = (total.n or 0) + ends, total.v + (ends > 0)
    # rarer words than this may be left to the join, so that few rows are sent to be ordered
    head = counts.where(F.col("c") >= tokens // (8 * HEAD)).orderBy(F.desc("c"), "word").limit(HEAD).collect()
    words, c = [bytes(r.word) for r in head], np.array([r.c for r in head], np.float64)
    classes = np.array([i if i < WORDS else group_of(w) for i, w in enumerate(words)], np.int64)
    group = (F.expr("crc32(substring(word, -3, 3))") % GROUPS + WORDS + 1).cast("int")
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy(group.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        size[r.k], kinds[r.k] = r.n, r.v
    for w, n in zip(words[:WORDS], c[:WORDS], strict=True):
        size[group_of(w)] -= n
        kinds[group_of(w)] -= 1
    share = np.zeros(CLASSES)
    share[END + 1 :] = np.log10(size[END + 1 :] + kinds[END + 1 :] + 1)
    unigram = size.copy()
    unigram[: min(WORDS, len(c))] = c[:WORDS]
    unigram[END] = ends
    model = Model({w: i for i, w in enumerate(words)}, classes, np.log10(c + 1), ends, tokens, distinct, share, *[np.zeros((1, 1), np.float32)] * 3)
    network = fit(docs, model, unigram + 1, tokens)
    model.first, model.second, model.norm = network.tables()
    return model, counts


def scored(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Probabilities are normalised: P(class | two classes before) from the network, times (c + 1) over
    the sum of this in a class of many words, one more for all unseen words. Words of the head are
    looked up, others joined with their counts. Null texts are empty ones: the end token alone. Texts are scored whole, however
    long. Repeated rows get repeated results; an empty table gives an empty result. Columns other than ``keep`` are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("n_tokens long, n_known long, base double, value double, rest binary")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = list(zip(*(held.value.parts(t.as_py()) for t in column), strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            yield pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], ["n_tokens", "n_known", "base", "value", "rest"])

    parts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, run(F.col(text_col).cast("binary")).alias("p"))
    parts = cut(parts.select("doc_id", *keep, "p.*")).withColumn("row", F.monotonically_increasing_id())
    rest = parts.where(F.length("rest") > 0).select("row", F.explode(F.split(F.col("rest").cast("string"), " ")).alias("word"))
    logs = counts.select(F.col("word").cast("string").alias("counted"), F.log10(F.col("c") + 1).alias("log_c"))
    sums = rest.join(logs, F.col("word") == F.col("counted")).groupBy(F.col("row").alias("of")).agg(F.sum("log_c").alias("more"), F.count(F.lit(1)).alias("seen"))
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return parts.join(sums, F.col("row") == F.col("of"), "left").select(
        "doc_id", *keep, "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("value") + more).alias("score"),
    )
