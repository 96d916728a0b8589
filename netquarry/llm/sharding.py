"""Minimax contiguous sharding of atomic groups, with DataFrame operations only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netquarry.llm.common import cut

#: Leading bits of the group hash in the first histogram; its size is fixed.
FIRST_BITS = 16
#: Histogram cells wanted at most from one refinement.
CELLS = 200_000
#: Cells of the slot numbering: ranges of the group hash times salts, so that one large group is dealt out too.
RANGES, SALTS = 1024, 64


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _greedy(cum: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Ends (indices into cum) of the longest runs of atoms within ``capacity``; None if ``shards`` runs don't do."""
    ends, at, n = [], 0, len(cum)
    for _ in range(shards):
        before = int(cum[at - 1]) if at else 0
        at = int(np.searchsorted(cum, before + capacity, "right"))
        ends.append(at)
        if at == n:
            return ends + [n] * (shards - len(ends))
    return None


def smallest_capacity(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest shard capacity for which greedy contiguous filling fits, by binary search, and the cuts."""
    cum = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(cum[-1]) // shards)), int(cum[-1])
    while low < high:
        middle = (low + high) // 2
        if _greedy(cum, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low, _greedy(cum, shards, low)


def _uncertain(sizes: np.ndarray, shards: int, low: int, high: int) -> np.ndarray:
    """Which atoms a cut can fall into for a capacity from low to high, if the atoms were finer."""
    cum = np.cumsum(sizes)
    total, found = int(cum[-1]), np.zeros(len(sizes), bool)
    least = most = 0
    for _ in range(shards):
        i = int(np.searchsorted(cum, least + low, "right"))
        least = int(cum[i - 1]) if i else 0
        most = min(total, most + high)
        j = int(np.searchsorted(cum, most, "left"))
        found[i : j + 1] = True
        most = int(cum[min(j, len(cum) - 1)])
    return found


def _histogram(groups: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First hash, bytes and rows of each cell of ``bits`` leading bits, ordered by hash (taken as unsigned)."""
    cell = F.shiftrightunsigned("h", 64 - bits) if bits < 64 else F.col("h")
    got = groups.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toPandas()
    start = got["cell"].to_numpy(np.int64).view(np.uint64) << np.uint64(64 - bits)
    order = np.argsort(start)
    return start[order], got["bytes"].to_numpy(np.int64)[order], got["n"].to_numpy(np.int64)[order]


def cuts(groups: DataFrame, shards: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """((first hash, shard) of each run in order, shard of each group that alone exceeds an equal share).

    groups: ``h long, size long`` rows, a group being an h. A group above the equal share gets a shard
    of its own; the others, in hash order, get the minimax contiguous partition of the shards that
    remain. The capacity is searched on a histogram of fixed size, then again where a cut can
    still fall, on ever finer hash ranges down to single groups, so the driver never holds all groups.
    """
    start, size, rows = _histogram(groups, FIRST_BITS)
    alone: dict[int, int] = {}
    if not len(start):
        return [(0, 0)], alone
    total, left = int(size.sum()), shards
    if int(size.max()) * left > total:
        for r in groups.groupBy("h").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes"), "h").limit(shards).collect():
            if r.bytes * left <= total or left == 1:
                break
            left -= 1
            alone[r.h] = left
            total -= r.bytes
            i = int(np.searchsorted(start, np.uint64(r.h % 2**64), "right")) - 1
            size[i] -= r.bytes
            rows[i] -= r.n
        if not rows.sum():
            return [(0, 0)], alone
        groups = groups.where(~F.col("h").isin(list(alone))) if alone else groups
    bits = np.full(len(start), FIRST_BITS)
    while True:
        keep = rows > 0
        start, size, rows, bits = start[keep], size[keep], rows[keep], bits[keep]
        high, ends = smallest_capacity(size, left)
        doubtful = _uncertain(size, left, -(-total // left), high) & (bits < 64) & (rows > 1)
        if not doubtful.any():
            break
        finer = int(bits[doubtful].max())
        finer = 64 if int(rows[doubtful].sum()) <= CELLS else min(64, finer + max(1, int(np.log2(CELLS / doubtful.sum()))))
        where = F.lit(False)
        for level in np.unique(bits[doubtful]).tolist():
            cells = start[doubtful & (bits == level)] >> np.uint64(64 - level)
            where = where | F.shiftrightunsigned("h", 64 - level).isin(cells.astype(np.int64).tolist())
        s, z, n = _histogram(groups.where(where), finer)
        start, size, rows, bits = (np.concatenate([x[~doubtful], y]) for x, y in ((start, s), (size, z), (rows, n), (bits, np.full(len(s), finer))))
        order = np.argsort(start)
        start, size, rows, bits = start[order], size[order], rows[order], bits[order]
    runs, at = [], 0
    for shard, end in enumerate(ends):
        if end > at or shard == 0:
            runs.append((int(start[at]) if at else 0, shard))
        at = end
    return runs, alone


def _unsigned(column: str) -> Column:
    """The hash, so that signed order is the unsigned order."""
    return F.col(column).bitwiseXOR(F.lit(-(2**63)))


def _biased(value: int) -> Column:
    return F.lit(value - 2**63)


def shard_of(runs: list[tuple[int, int]], alone: dict[int, int]) -> Column:
    found = F.lit(runs[0][1])
    for first, shard in runs[1:]:
        found = F.when(_unsigned("h") >= _biased(first), shard).otherwise(found)
    for h, shard in alone.items():
        found = F.when(F.col("h") == h, shard).otherwise(found)
    return found.cast("int")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row: the law is ``bytes``.

    A row's size is its text's UTF-8 bytes (none for null) plus ``overhead``. Groups of equal texts
    (by a 64-bit hash; null is a text of its own) stay together. Slots run from 0 in each shard.
    Repeated rows share a group and differ in slot; crc32 of null is 0. A very long text counts whole; a group above an equal share
    has a shard of its own. An empty table gives an empty result. Extra columns are ignored.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (text_bytes(text) + overhead).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text)).cast("long").alias("h"),
    )
    rows = cut(rows)
    runs, alone = cuts(rows.select("h", "size"), shards)
    placed = rows.withColumn("shard", shard_of(runs, alone)).withColumn("range", F.shiftrightunsigned("h", 64 - (RANGES - 1).bit_length())).withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)))
    cell = ["shard", "range", "salt"]
    counts = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(*cell, (F.sum("n").over(Window.partitionBy("shard").orderBy("range", "salt")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("i", F.row_number().over(Window.partitionBy(*cell).orderBy("h", "doc_id")))
    return numbered.join(before, cell).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("i") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
