"""Nearest neighbours by inner product: randomly rotated one-bit codes, error bounds, and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netquarry.llm.common import cut

#: Bits of a code for each component: vectors are padded to so many before they are rotated. An estimate's error goes as the root of 1 / bits and the
#: spread of inner products as that of 1 / components, so that in this proportion the bounds find as much at any length of the vectors.
BITS_PER_COMPONENT = 8
#: Bit planes of a query's rotated components.
PLANES = 5
#: Width of the error bounds in standard deviations: on random directions about 1 % of the true neighbours are lost, whatever their length.
EPSILON = 0.9
#: Bytes of the codes and of the queries' planes in a block at most. A group of the scan holds one block of each, and what the bounds leave of it.
CODE_BYTES, QUERY_BYTES = 92 << 20, 6 << 20
#: Codes and queries that meet at once within a group.
CODES_AT_ONCE, AT_ONCE = 4_096, 16
#: Parts of a group of equal vectors when its smallest ids are found.
SALTS = 16


def rotation(dim: int, per_component: int = BITS_PER_COMPONENT, seed: int = 5) -> np.ndarray:
    """(bits, dim) with orthonormal columns: a random rotation of the padded space. The bits are a multiple of 64."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(-(-dim * per_component // 64) * 64, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of the rotated residuals as 64-bit words; the factor of an estimate from them, and the error of one for a query of length 1."""
    away = (x - centre) @ turn.T
    bits = away.shape[1]
    length = np.linalg.norm(away, axis=1)
    cosine = np.where(length > 0, np.abs(away).sum(axis=1) / (np.sqrt(bits) * np.maximum(length, 1e-300)), 1.0)
    error = length * EPSILON * np.sqrt(np.maximum(0, 1 - cosine**2)) / (cosine * np.sqrt(bits - 1))
    return np.packbits(away > 0, axis=1, bitorder="little").view(np.uint64), length / (np.sqrt(bits) * cosine), error


def planes(q: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, PLANES, words): bit planes of each query's rotated components on a scale of its own; and that scale (low, step), the
    sum of its steps, its product with the centre, and its length."""
    turned = q @ turn.T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    bits = np.stack([np.packbits(level >> p & 1, axis=1, bitorder="little") for p in range(PLANES)], axis=1)
    total = low * turned.shape[1] + step * level.sum(axis=1)
    return np.ascontiguousarray(bits).view(np.uint64), np.column_stack([low, step, total, q @ centre, np.linalg.norm(q, axis=1)])


def bounds(codes: np.ndarray, factor: np.ndarray, error: np.ndarray, bits: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of (queries, codes), from counted bits and the scalars alone."""
    low, step, total, centre, size = (scale[:, i, None] for i in range(5))
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
    met, both = np.zeros((len(bits), len(codes)), np.int32), np.empty((len(bits), len(codes)), np.uint64)
    columns = np.ascontiguousarray(codes.T)
    for p in range(bits.shape[1]):
        count = np.zeros(met.shape, np.uint16)
        for word, column in enumerate(columns):
            count += np.bitwise_count(np.bitwise_and(column, bits[:, p, word, None], out=both))
        met += count.astype(np.int32) << p
    guess = (2 * (low * ones + step * met) - total) * factor + centre
    spread = size * error + 2 * EPSILON * step * np.sqrt(64 * codes.shape[1] / 12) * factor + 1e-9 * size
    return guess - spread, guess + spread


def survivors(codes: np.ndarray, factor: np.ndarray, error: np.ndarray, bits: np.ndarray, scale: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, code, lower bound, upper bound) of what a block may add to each query's ``k`` nearest: upper bounds from the block's k-th lower bound on."""
    for at in range(0, len(bits), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        best = np.full((len(bits[some]), k), -np.inf)
        held: list[tuple[np.ndarray, ...]] = []
        for start in range(0, len(codes), CODES_AT_ONCE):
            part = slice(start, start + CODES_AT_ONCE)
            low, high = bounds(codes[part], factor[part], error[part], bits[some], scale[some])
            top = np.partition(low, low.shape[1] - k, axis=1)[:, -k:] if low.shape[1] > k else low
            best = np.partition(np.concatenate([best, top], axis=1), top.shape[1], axis=1)[:, -k:]
            i, j = np.nonzero(high >= best.min(axis=1)[:, None])
            held.append((i, j + start, low[i, j], high[i, j]))
        i, j, low, high = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, int),) * 4
        stay = high >= best.min(axis=1)[i]
        yield i[stay] + at, j[stay], low[stay], high[stay]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _words(column, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), *shape, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def index(reps: DataFrame, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """``rep, code, factor, error`` of ``reps(rep, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, factor, error = encode(_matrix(batch.column(1)), centre, turn)
                yield pa.record_batch({"rep": batch.column(0), "code": _binary(code), "factor": pa.array(factor), "error": pa.array(error)})

    return reps.select("rep", "v").mapInArrow(run, "rep long, code binary, factor double, error double")


def asked_planes(queries: DataFrame, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """``query, bits, scale`` of ``queries(rep, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits, scale = planes(_matrix(batch.column(1)), centre, turn)
                yield pa.record_batch({"query": batch.column(0), "bits": _binary(bits), "scale": pa.array(list(scale), pa.list_(pa.float64()))})

    return queries.select("rep", "v").mapInArrow(run, "query long, bits binary, scale array<double>")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.record_batch({"query": batch.column(0), "ids": batch.column(1), "score": pa.array((_matrix(batch.column(2)) * _matrix(batch.column(3))).sum(axis=1))})


def search(vectors: DataFrame, query_step: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", per_component: int = BITS_PER_COMPONENT) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of each row whose id is divisible by ``query_step``.

    Nearness is the inner product in double precision, ties go to the smaller id. Equal vectors are
    scored once, and of them only the ``k + 1`` smallest ids can be results. Every distinct vector has a code. Blocks of codes
    and their scalars meet blocks of queries' bit planes; the bounds of all blocks together leave few vectors for each query, and
    only those are fetched and scored exactly.

    Null ids, vectors that are null, zero, of another length than most, or hold a null or non-finite
    component take no part. Rows with the query's id are its own. Repeated queries with one vector
    give one result, an id with two vectors a ranking for each. An empty table, or one vector alone, gives an empty result. Extra columns are ignored.
    """
    stored = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(vector_col).cast("array<float>" if stored else "array<double>")  # products are double either way
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    spark = vectors.sparkSession
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["dim"]
    rows = rows.where(F.size("v") == dim).select("id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))  # 96 bits stand for a vector
    same = ["h1", "h2"]
    narrow = rows.select("id", *same).distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    least = narrow.withColumn("i", F.row_number().over(Window.partitionBy(*same, "salt").orderBy("id"))).where(F.col("i") <= k + 1)
    least = least.withColumn("i", F.row_number().over(Window.partitionBy(*same).orderBy("id"))).where(F.col("i") <= k + 1)
    ids = least.groupBy(*same).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    reps = cut(rows.groupBy(*same).agg(F.first("v").alias("v")).join(ids, same)).withColumn("rep", F.monotonically_increasing_id())
    means = reps.agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col("v")[i].cast("double")).alias(f"m{i}") for i in range(dim))).first()
    n, centre = means["n"], np.array(means[1:], float)
    turn = rotation(dim, per_component)
    bits = len(turn)
    asked = cut(rows.where(F.col("id") % query_step == 0).select("id", *same).distinct().join(reps.select(*same, "rep"), same).select(F.col("id").alias("query_id"), F.col("rep").alias("query")))
    queries = cut(asked.select("query").distinct().join(reps.select(F.col("rep").alias("query"), "v"), "query").select(F.col("query").alias("rep"), "v"))
    # few large blocks of codes, as each one passes on what may be nearest in it; within them cores share the queries
    blocks, count = -(-n * (bits // 8 + 24) // CODE_BYTES), queries.count()
    parts = max(1, -(-count * PLANES * bits // 8 // QUERY_BYTES), min(-(-spark.sparkContext.defaultParallelism // blocks), -(-count // AT_ONCE)))

    def spread(df: DataFrame, by: str, own: str, count: int, other: str, many: int) -> DataFrame:
        """Deals rows to ``count`` blocks of their own and repeats them for each of ``many`` blocks of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(many - 1))))

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            rep, query = left["rep"].to_numpy(), right["query"].to_numpy()
            codes, asked_bits = _words(left["code"]), _words(right["bits"], PLANES)
            for i, j, low, high in survivors(codes, left["factor"].to_numpy(), left["error"].to_numpy(), asked_bits, _matrix(right["scale"]), k + 1):
                found.append((query[i], rep[j], low, high))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * 4
        return pa.table({name: pa.array(x, kind) for name, x, kind in zip(("query", "rep", "low", "high"), columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})

    left, right = spread(index(reps, centre, turn), "rep", "block", blocks, "part", parts), spread(asked_planes(queries, centre, turn), "query", "part", parts, "block", blocks)
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(pairs, "query long, rep long, low double, high double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
    edge = F.min(F.when(F.col("i") <= k + 1, F.col("low"))).over(Window.partitionBy("query"))
    near = cut(met.withColumn("i", place).withColumn("edge", edge).where(F.col("high") >= F.col("edge")).select("query", "rep"))
    both = near.join(reps.select("rep", "v", "ids"), "rep").drop("rep").join(queries.select(F.col("rep").alias("query"), F.col("v").alias("of")), "query").select("query", "ids", "v", "of")
    scored = both.mapInArrow(_products, "query long, ids array<long>, score double").select("query", F.explode("ids").alias("vec_id"), "score")
    best = scored.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("i") <= k + 1).drop("i")
    ranked = best.join(asked, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
