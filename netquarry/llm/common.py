"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` splits in the same way.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """True where the row belongs to the held-out fold; a null id is never held out."""
    return F.coalesce(crc_bucket(column, modulus) == remainder, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where none is set (tests, one machine) one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), "netquarry-checkpoints"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own below the shared one, in whatever store Spark has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder, so that later jobs survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: A key is heavy if it holds more than one row in so many; so this is also the most heavy keys that there can be.
HEAVY = 1_000
#: Tables of nodes of at most so many narrow rows (about 4 MB) are broadcast; larger ones are repeated for each of SALTS parts of a key.
BROADCAST_ROWS, SALTS = 200_000, 16


def hot_join(big: DataFrame, small: DataFrame, key: str, rows: str = "n") -> DataFrame:
    """Joins ``big``, of which one key may hold any share, with ``small``, one row a key with its number of rows in ``big``.

    The heavy keys, HEAVY at most, are broadcast, and their rows aren't shuffled; all others are joined as usual. ``small`` is already written by ``cut``.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    heavy = small.where(F.col(rows) * HEAVY > total).drop(rows)
    light = small.drop(rows)
    if heavy.isEmpty():
        return big.join(light, key)
    return big.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key).unionByName(big.join(F.broadcast(heavy), key))


def salted_join(big: DataFrame, small: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Joins ``big``, of which one key may hold any share, with ``small`` (two numbers, one row a key, already written by ``cut``), where the shares aren't known."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key)
    salted = big.withColumn("join_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("join_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "join_salt"]).drop("join_salt")


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that working columns can't clash with them; ``select("row.*")`` gives them back."""
    return F.struct(*(quoted(c) for c in docs.columns)).alias("row")


def row_hash(docs: DataFrame, *seed: Column) -> Column:
    """A hash over all columns, and ``seed`` where a second one is needed; maps, which have no order, as JSON."""
    return F.xxhash64(*seed, *(F.to_json(F.struct(quoted(f.name))) if "map" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else quoted(f.name) for f in docs.schema.fields))


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the variable-length ``column`` of a piece holds about ``most_bytes`` (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    cum = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < n:
        before = cum[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(cum, before + most_bytes, "right")))
        yield batch.slice(start, end - start)
        start = end


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column's values one after another, and where each begins and the last one ends. Null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def as_int64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())
