"""SimHash near-duplicate components by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import as_int64, cut, hot_join
from netquarry.llm.components import components, forest

#: Buckets up to this size are compared pair by pair in numpy, larger ones by searching outwards from one member.
PAIRWISE = 256
#: Random members that a bucket may hold; beyond that wider segments are taken.
FEW = 64
#: Pairs held in memory at once.
PAIRS_AT_ONCE = 2_000_000
#: Shingles hashed at once, so that a very long text needs no more memory.
SHINGLES_AT_ONCE = 500_000


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """64 bits; each is 1 if it is set in over half of the XXH64 hashes of all word shingles.

    A text of fewer words is one shingle; a null text or one without words gives 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - shingle + 1)]
    ends = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        some = slice(at, at + SHINGLES_AT_ONCE)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(starts)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``doc_id, fp`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": as_int64(found)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment; widths differ by at most one."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _flips(width: int, radius: int) -> list[tuple[int, int]]:
    """(bits that must be 0, bits that must be 1) of the moves of 1..radius bits out of a segment.

    Of a move and its reverse only the one that sets the highest changed bit is kept, so each pair of segments meets once.
    """
    moves: list[tuple[int, int]] = []

    def extend(zero: int, one: int, below: int, left: int) -> None:
        if zero:
            moves.append((zero, one))
        if left:
            for b in range(below):
                extend(zero | 1 << b, one, b, left - 1)
                if zero:
                    extend(zero, one | 1 << b, b, left - 1)

    extend(0, 0, width, radius)
    return moves


def _probes(segments: int, radius: int):
    """Rows ``bucket, probe, fp``: one for each segment of a fingerprint, and one for each move out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)

            def rows(keys: np.ndarray, probe: int, of: np.ndarray) -> pa.RecordBatch:
                return pa.record_batch({"bucket": as_int64(keys), "probe": pa.array(np.full(len(keys), probe, np.int8)), "fp": as_int64(of)})

            for s, (low, width) in enumerate(segment_bounds(segments)):
                key = (fps >> np.uint64(low)) & np.uint64((1 << width) - 1)
                tag = np.uint64(s << 56)
                yield rows(key | tag, 0, fps)
                for zero, one in _flips(width, radius // segments):
                    fit = np.flatnonzero(((key & np.uint64(zero)) == 0) & ((key & np.uint64(one)) == np.uint64(one)))
                    yield rows(key[fit] ^ np.uint64(zero | one) | tag, 1, fps[fit])

    return run


def _outwards(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a bucket: each member found leaves the search, so a dense bucket costs few scans."""
    left, right = [], []
    while len(fps):
        frontier, fps = [fps[0]], fps[1:]
        while frontier and len(fps):
            x = frontier.pop()
            near = np.bitwise_count(fps ^ x) <= radius
            if near.any():
                left.append(np.full(int(near.sum()), x))
                right.append(fps[near])
                frontier.extend(fps[near])
                fps = fps[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _within(bucket: np.ndarray, probe: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Links between table entries and other members of their bucket; rows are sorted by bucket, table entries first."""
    n = len(bucket)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    ends = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= PAIRWISE, sizes)

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"u": as_int64(a), "v": as_int64(b)})

    first = np.flatnonzero((probe == 0) & small)
    counts = ends[first] - first - 1
    first, counts = first[counts > 0], counts[counts > 0]
    cum = np.cumsum(counts)
    at = 0
    while at < len(first):
        before = cum[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(cum, before + PAIRS_AT_ONCE, "right")))
        c = counts[at:to]
        a = np.repeat(first[at:to], c)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        if near.any():
            yield links(fps[a[near]], fps[b[near]])
        at = to
    for k in np.flatnonzero(sizes > PAIRWISE):
        if probe[starts[k]] == 0:
            a, b = _outwards(fps[starts[k] : starts[k] + sizes[k]], radius)
            if len(a):
                yield links(a, b)


def _bucket_links(radius: int):
    """Links of the buckets of a partition, contracted to a forest before they leave the task."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            new = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
            if not len(new[0]):
                continue
            last = int(np.searchsorted(new[0], new[0][-1], "left"))
            if last == 0 and kept and kept[-1][0][-1] == new[0][0]:
                kept.append(new)  # the batch continues one bucket
                continue
            whole = [np.concatenate(x) for x in zip(*kept, tuple(x[:last] for x in new), strict=True)]
            if len(whole[0]):
                yield from _within(*whole, radius)
            kept = [tuple(x[last:] for x in new)]
        if kept:
            yield from _within(*(np.concatenate(x) for x in zip(*kept, strict=True)), radius)

    return lambda batches: forest(found(batches))


def segments_for(count: int, radius: int) -> int:
    """The most segments (the fewest probes) with which a bucket still holds few of ``count`` random fingerprints."""
    for segments in range(radius - 1, 1, -1):
        width = 64 // segments
        probes = 1 + sum(comb(width + 1, bits) for bits in range(1, radius // segments + 1))
        if count * probes <= FEW << width:
            return segments
    return 2


def near_links(fps: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """Links ``u, v`` that connect the distinct fingerprints ``fps(fp long)`` as all pairs within ``radius`` bits do.

    With ``segments`` segments a pair within ``radius`` bits differs by at most ``radius // segments``
    bits in one of them: each fingerprint stands in the table under its segments and probes the
    small Hamming ball around them; whole distances decide. Rows are dealt by (segment, value).
    """
    rows = fps.select("fp").mapInArrow(_probes(segments, radius), "bucket long, probe byte, fp long")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "probe").mapInArrow(_bucket_links(radius), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4, segments: int | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row.

    Fingerprints within ``radius`` bits link; a component's id is the smallest doc_id in it. The number of segments follows
    the counted fingerprints unless it is given (three to some millions, then two, of 32 bits); any number finds all links. Texts
    are whole and lower-cased in A-Z. Null texts and texts without words have fingerprint zero and
    link as any other. Equal fingerprints are compared once, so copies cost no pairs, and are never gathered in one task. Rows with a null id take part; a component of null ids only has a
    null id. Repeated rows give repeated results, an empty table an empty one. Extra columns are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    labels = components(near_links(fps, radius, segments or segments_for(fps.count(), radius))).withColumnRenamed("node", "fp")
    labelled = fps.join(labels, "fp", "left").select("fp", "least", F.col("n").alias("copies"), F.coalesce("label", "fp").alias("root"))
    smallest = cut(labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    of_fp = cut(hot_join(labelled.select("root", "fp", "copies"), smallest, "root").select("fp", "component_id", F.col("copies").alias("n")))
    return hot_join(rows, of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
