"""Removal of lines that many documents share, by two Bloom filters and an exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import cut, hot_join, slices

#: The first filter has about one bit for 4 bytes of text, this many at least. It lies dealt over the tasks and grows with the text.
LEAST_BITS = 1 << 20
#: The second filter is broadcast (64 MB at most), so it is the first one folded to at most so many bits.
MOST_BITS = 1 << 29
#: Bits of a part of the second filter, and of a part of the first at most (a byte each in memory). A task holds one part of each at a time.
SECOND_PART, MOST_PART = 1 << 16, 1 << 27


#: Shared keys (24 bytes each) that are broadcast to the tasks that read the texts; beyond that documents are shuffled to meet the keys that they lose.
MOST_SHARED = 1_000_000


class Shared(NamedTuple):
    """Keys to lose and the document that keeps each, sorted by the keys' halves."""

    high: np.ndarray
    low: np.ndarray
    keeper: np.ndarray
    longest: int

    @classmethod
    def of(cls, keys: np.ndarray, keeper: np.ndarray) -> Shared:
        halves = keys.view(np.uint64).reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        high = halves[order, 0]
        runs = np.diff(np.r_[np.flatnonzero(np.r_[True, high[1:] != high[:-1]]), len(high)]) if len(high) else np.zeros(1, np.int64)
        return cls(high, halves[order, 1], keeper[order], int(runs.max()))

    def keepers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are shared, and the document that keeps each of these."""
        halves = keys.view(np.uint64).reshape(-1, 2)
        found, keeper = np.zeros(len(halves), bool), np.zeros(len(halves), np.int64)
        first = np.searchsorted(self.high, halves[:, 0])
        for step in range(self.longest):
            at = np.minimum(first + step, max(len(self.high) - 1, 0))
            same = (self.high[at] == halves[:, 0]) & (self.low[at] == halves[:, 1])
            found[same], keeper[same] = True, self.keeper[at[same]]
        return found, keeper


class Layout(NamedTuple):
    """Bits of a part of the first filter, and the numbers of parts: the first's parts p, p + seconds, ... fold to the second's part p."""

    span: int
    parts: int
    seconds: int

    @classmethod
    def of(cls, bits: int) -> Layout:
        seconds = max(1, min(bits, MOST_BITS) // SECOND_PART)
        parts = max(seconds, bits // MOST_PART)
        return cls(bits // parts, parts, seconds)

    @property
    def number(self) -> type:
        """The type of a position within a part."""
        return np.uint16 if self.span <= 1 << 16 else np.uint32

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of the first filter that each digest falls into, and its two positions there."""
        words = digests.view(np.uint64).reshape(-1, 2)
        within = np.column_stack([words[:, 0] >> np.uint64(32), words[:, 1]]) & np.uint64(self.span - 1)
        return (words[:, 0] & np.uint64(self.parts - 1)).astype(np.int64), within


def line_key(line: bytes, least: int) -> bytes | None:
    """The line without ASCII white space at its ends, A-Z lower-cased; None below ``least`` code points."""
    key = line.strip().lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _digests(text: bytes | None, least: int) -> set[bytes]:
    """128-bit digests of the distinct keys of a text."""
    digest = xxhash.xxh3_128_digest
    return {digest(k) for line in (text or b"").split(b"\n") if (k := line_key(line, least)) is not None}


def _seen(layout: Layout, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_ in slices(batch, 0, 64 << 20):
                found = [d for t in slice_.column(0) for d in _digests(t.as_py(), least)]
                if not found:
                    continue
                keys, counts = np.unique(np.frombuffer(b"".join(found), "V16"), return_counts=True)
                part, at = layout.places(keys)
                order = np.lexsort((counts == 1, part))  # of each part the keys seen again come first
                part, at, again = part[order], at[order].astype(layout.number), (counts > 1)[order]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                ends = np.r_[starts[1:], len(part)]
                places = pa.array([at[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
                yield pa.record_batch({"part": pa.array(part[starts]), "places": places, "again": pa.array(np.add.reduceat(again, starts, dtype=np.int64))})

    return run


def _fold(layout: Layout):
    """The second filter's parts. Rows of a part come in any order and follow each other, so one part of each filter is held at a time.

    A key was seen before where both its positions are set in the first filter; only such keys enter the second.
    """

    def filled(second: int, twice: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"second": pa.array([second], pa.int64()), "twice": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_part = second_part = None
        once, twice = np.zeros(layout.span, bool), np.zeros(SECOND_PART, bool)
        for batch in batches:
            for second, first, places, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if second != second_part:
                    if second_part is not None:
                        yield filled(second_part, twice)
                    second_part = second
                    twice[:] = False
                if first != first_part:
                    first_part = first
                    once[:] = False
                at = np.frombuffer(places, layout.number).reshape(-1, 2)
                before = once[at].all(axis=1)
                before[:again] = True
                twice[at[before] & (SECOND_PART - 1)] = True
                once[at] = True
        if second_part is not None:
            yield filled(second_part, twice)

    return run


def _suspects(twice, layout: Layout, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = twice.value
        for batch in batches:
            for slice_ in slices(batch, 1, 64 << 20):
                found = [_digests(t.as_py(), least) for t in slice_.column(1)]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                if not sizes.sum():
                    continue
                keys = np.frombuffer(b"".join(d for one in found for d in one), "V16")
                part, at = layout.places(keys)
                at = ((part % layout.seconds).astype(np.uint64) * np.uint64(SECOND_PART))[:, None] + (at & np.uint64(SECOND_PART - 1))
                hit = ((words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
                row = np.repeat(np.arange(len(found)), sizes)[hit]
                yield pa.record_batch({"doc_id": slice_.column(0).take(pa.array(row)), "key": pa.array([x.tobytes() for x in keys[hit]], pa.binary())})

    return run


def _keep(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch, 1, 64 << 20):
                total, dropped, kept = [], [], []
                for text, drop in zip(part.column(1), part.column(2), strict=True):
                    lines = (text.as_py() or b"").split(b"\n")
                    drop = set(drop.as_py() or ())
                    stay = [x for x in lines if (k := line_key(x, least)) is None or digest(k) not in drop] if drop else lines
                    total.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay))
                yield pa.record_batch({"doc_id": part.column(0), "kept": pa.array(kept, pa.binary()), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

    return run


def _keep_where_read(shared, least: int):
    """As ``_keep``, with all shared keys at hand, so that no text leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, known = xxhash.xxh3_128_digest, shared.value
        for batch in batches:
            for part in slices(batch, 1, 16 << 20):
                texts = [(t.as_py() or b"").split(b"\n") for t in part.column(1)]
                keyed = [(row, i, digest(k)) for row, lines in enumerate(texts) for i, x in enumerate(lines) if (k := line_key(x, least)) is not None]
                total, dropped = [len(lines) for lines in texts], np.zeros(len(texts), np.int64)
                if keyed and len(known.high):
                    row, at = (np.fromiter((k[j] for k in keyed), np.int64, len(keyed)) for j in (0, 1))
                    found, keeper = known.keepers(np.frombuffer(b"".join(k[2] for k in keyed), "V16"))
                    own = part.column(0).fill_null(0).to_numpy()[row]
                    is_own = (keeper == own) & part.column(0).is_valid().to_numpy(zero_copy_only=False)[row]
                    gone = found & ~is_own
                    for r, i in zip(row[gone].tolist(), at[gone].tolist(), strict=True):
                        texts[r][i] = None
                    dropped = np.bincount(row[gone], minlength=len(texts))
                kept = [b"\n".join(x for x in lines if x is not None) for lines in texts]
                yield pa.record_batch({"doc_id": part.column(0), "kept": pa.array(kept, pa.binary()), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

    return run


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, bits: int | None = None) -> DataFrame:
    """``doc_id, kept_text, n_lines, n_dropped`` of each row.

    Lines with a key of at least ``least_chars`` code points that at least ``least_docs`` (3 or more)
    documents hold go, but for those in the largest doc_id that holds the key. The first filter has
    the keys seen once, the second those seen again; only lines that the second suspects are shuffled,
    by a 128-bit digest of the key, and counted exactly by distinct doc_id. A line of very many documents isn't gathered in one task.
    Up to ``MOST_SHARED`` shared keys are broadcast, and lines go where the texts are read; with more, texts are shuffled once to meet theirs.
    ``bits`` is the first filter's size, a power of two of at least ``SECOND_PART``; by default it follows the text's.

    A null or empty text is one empty line. Rows that share a doc_id are one document when counted.
    Null ids are together one document, which is never the largest. Repeated rows give repeated
    results, an empty table an empty one. Extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(LEAST_BITS, 1 << (size // 4).bit_length())
    layout = Layout.of(bits)
    filled = (
        docs.select("text").mapInArrow(_seen(layout, least_chars), "part long, places binary, again long").select((F.col("part") % layout.seconds).alias("second"), "part", "places", "again")
        .repartition("second").sortWithinPartitions("second", "part").mapInArrow(_fold(layout), "second long, twice binary")
    )
    twice = np.zeros(layout.seconds * SECOND_PART // 8, np.uint8)
    for second, words in filled.toLocalIterator():
        twice[second * (SECOND_PART // 8) : (second + 1) * (SECOND_PART // 8)] = np.frombuffer(words, np.uint8)
    suspects = cut(docs.mapInArrow(_suspects(spark.sparkContext.broadcast(twice), layout, least_chars), "doc_id long, key binary").distinct())
    shared = cut(suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least_docs))
    out, readable = "doc_id long, kept binary, n_lines long, n_dropped long", lambda kept: kept.select("doc_id", F.col("kept").cast("string").alias("kept_text"), "n_lines", "n_dropped")
    if shared.limit(MOST_SHARED + 1).count() <= MOST_SHARED:
        found = [(r.key, r.keeper) for r in shared.where(F.col("keeper").isNotNull()).select("key", "keeper").toLocalIterator()]
        known = Shared.of(np.frombuffer(b"".join(k for k, _ in found), "V16"), np.array([keeper for _, keeper in found], np.int64))
        return readable(docs.mapInArrow(_keep_where_read(spark.sparkContext.broadcast(known), least_chars), out))
    drops = hot_join(suspects, shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("key").alias("keys"))
    rows = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "keys")
    return readable(rows.mapInArrow(_keep(least_chars), out))
