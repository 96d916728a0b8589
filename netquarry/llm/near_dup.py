"""Groups of documents whose sets of word shingles are alike: SimHash and MinHash candidates, confirmed by exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import as_int64, cut, slices
from netquarry.llm.components import components
from netquarry.llm.simhash import fingerprint, near_links, segments_for

#: A pair of similarity s shares a bucket with probability 1 - (1 - s^DEPTH)^BANDS: all but 1.2e-7 of the pairs at 0.8.
BANDS, DEPTH = 40, 5
#: Pairs held in memory at once, and hashes that are permuted at once.
PAIRS_AT_ONCE, HASHES_AT_ONCE = 500_000, 512
#: Bits of a sketch that rules out pairs without their sets, and never one that is similar enough.
SKETCH = 1024

_draw = np.random.default_rng(20)
_ODD = _draw.integers(0, 2**32, BANDS * DEPTH, np.uint32) | np.uint32(1)
_PLACE = _draw.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_BAND = _draw.integers(0, 2**64, (BANDS, DEPTH + 1), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles, lower-cased in A-Z; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    of_word = np.fromiter(map(digest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total += of_word[j : j + n] * _PLACE[j]
    return np.unique(_mixed(total))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band: the smallest hashes under DEPTH permutations; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * DEPTH, 2**32 - 1, np.uint32)
    for at in range(0, len(high), HASHES_AT_ONCE):
        np.minimum(least, (high[at : at + HASHES_AT_ONCE, None] * _ODD).min(axis=0), out=least)
    return _mixed((least.reshape(BANDS, DEPTH).astype(np.uint64) * _BAND[:, :DEPTH]).sum(axis=1, dtype=np.uint64) + _BAND[:, DEPTH])


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of SKETCH bins: two sets differ in at least as many hashes as their sketches do in bits."""
    return np.packbits((np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def _key(hashes: np.ndarray) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return value >> 64, value & (2**64 - 1)


def _key_columns(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    keys = np.array([_key(s) for s in sets], np.uint64).reshape(-1, 2)
    return {"k1": as_int64(keys[:, 0]), "k2": as_int64(keys[:, 1])}


def _distinct_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``node, k1, k2, n, sketch, bands, fp, least`` of each distinct shingle set; ``least`` is the first of its rows, ``fp`` a SimHash fingerprint of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = [shingle_set(t.as_py(), shingle) for t in part.column(2)]
                bands = pa.array([buckets(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.record_batch({"doc_id": part.column(0), "row_hash": part.column(1), **_key_columns(sets), "n": pa.array(map(len, sets), pa.int64()), "sketch": pa.array(map(sketch, sets), pa.binary()), "bands": bands, "fp": as_int64(np.array([fingerprint(t.as_py()) for t in part.column(2)], np.uint64))})

    found = rows.mapInArrow(run, "doc_id long, row_hash long, k1 long, k2 long, n long, sketch binary, bands array<long>, fp long")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("least")
    sets = found.groupBy("k1", "k2").agg(least, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.min("fp").alias("fp"))
    return cut(sets.withColumn("node", F.monotonically_increasing_id()))


def _simhash_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """Pairs of nodes that join all sets whose SimHash fingerprints link: each set with the first one of its fingerprint, and these along the links."""
    sets = sets.where("n > 0")
    firsts = cut(sets.groupBy("fp").agg(F.min("node").alias("first")))
    links = near_links(firsts.select("fp"), radius, segments_for(firsts.count(), radius))
    one, other = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}")) for c in "uv")
    across = links.join(one, "u").join(other, "v").select(F.least("of_u", "of_v").alias("a"), F.greatest("of_u", "of_v").alias("b"))
    same = sets.select("fp", "node").join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return cut(across.unionByName(same).distinct())


def _by_bucket(work: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]):
    """Calls ``work`` with the columns of whole buckets, from rows sorted by bucket (the first column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            new = [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, SKETCH // 64) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]
            if not len(new[0]):
                continue
            last = int(np.searchsorted(new[0], new[0][-1], "left"))
            if last == 0 and kept and kept[-1][0][-1] == new[0][0]:
                kept.append(new)  # the batch continues one bucket
                continue
            whole = [np.concatenate(x) for x in zip(*kept, [x[:last] for x in new], strict=True)]
            if len(whole[0]):
                yield from work(whole)
            kept = [[x[last:] for x in new]]
        if kept:
            yield from work([np.concatenate(x) for x in zip(*kept, strict=True)])

    return run


def _spans(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return starts, np.diff(np.r_[starts, len(bucket)])


def _shared(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of buckets with several members."""
    _, sizes = _spans(rows[0])
    several = np.repeat(sizes > 1, sizes)
    yield pa.record_batch({name: pa.array(x[several], pa.int64()) for name, x in zip(("bucket", "node", "n"), rows, strict=True)})


def _may_link(n: np.ndarray, bits: np.ndarray, a, b, similarity: tuple[int, int]) -> np.ndarray:
    """Whether sizes and sketches allow the similarity of members a and b; true of every pair that has it."""
    up, down = similarity
    fit = down * np.minimum(n[a], n[b]) >= up * np.maximum(n[a], n[b])
    apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=-1, dtype=np.int64)
    return fit & ((down + up) * apart <= (down - up) * (n[a] + n[b]))


def _as_pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})


def _pairs(a: np.ndarray, b: np.ndarray, node: np.ndarray, n: np.ndarray, bits: np.ndarray, similarity: tuple[int, int]) -> pa.RecordBatch:
    """Pairs that may link, the smaller node first."""
    fit = _may_link(n, bits, a, b, similarity)
    return _as_pairs(node[a[fit]], node[b[fit]])


def _forest_pairs(similarity: tuple[int, int]):
    """A spanning forest of the pairs of a bucket that may link, so that a dense bucket sends few."""

    def work(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket, node, n, bits = rows
        x, y = [], []
        for s, size in zip(*map(np.ndarray.tolist, _spans(bucket)), strict=True):
            left = np.arange(s, s + size)
            while len(left) > 1:
                frontier, left = [left[0]], left[1:]
                while frontier and len(left):
                    at = frontier.pop()
                    near = _may_link(n, bits, at, left, similarity)
                    found = left[near]
                    x.append(np.full(len(found), node[at]))
                    y.append(node[found])
                    frontier.extend(found.tolist())
                    left = left[~near]
        if x:
            yield _as_pairs(np.concatenate(x), np.concatenate(y))

    return _by_bucket(work)


def _all_pairs(similarity: tuple[int, int]):
    """Of all members that aren't linked yet: those with different labels."""

    def work(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket, label, node, n, bits = rows
        starts, sizes = _spans(bucket)
        several = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
        a, b, held = [], [], 0
        for s, size in zip(starts[several].tolist(), sizes[several].tolist(), strict=True):
            ends = s + np.searchsorted(label[s : s + size], label[s : s + size], "right")
            for i, end in enumerate(ends.tolist(), s):
                if end < s + size:
                    b.append(np.arange(end, s + size))
                    a.append(np.full(s + size - end, i))
                    held += s + size - end
                    if held >= PAIRS_AT_ONCE:
                        yield _pairs(np.concatenate(a), np.concatenate(b), node, n, bits, similarity)
                        a, b, held = [], [], 0
        if held:
            yield _pairs(np.concatenate(a), np.concatenate(b), node, n, bits, similarity)

    return _by_bucket(work)


def _alike(pairs: DataFrame, members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links ``u, v``: the pairs whose exact Jaccard similarity is at least ``similarity``."""
    up, down = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(down * common >= up * (len(x) + len(y) - common))
            yield pa.record_batch({"u": batch.column(0), "v": batch.column(1)}).filter(pa.array(near, pa.bool_()))

    one, other = (members.select(F.col("node").alias(f"at_{x}"), F.col("hashes").alias(f"of_{x}")) for x in "ab")
    both = pairs.distinct().join(one, F.col("a") == F.col("at_a")).join(other, F.col("b") == F.col("at_b"))
    return cut(both.select("a", "b", "of_a", "of_b").mapInArrow(run, "u long, v long"))


def first_rows(docs: DataFrame, row_hash: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (4, 5), radius: int = 4) -> DataFrame:
    """``doc_id, row_hash`` of the row that stays of each group of similar texts.

    Texts link when the Jaccard similarity of their shingle sets is at least the fraction ``similarity``; groups
    are connected components. The row with the smallest id stays, of equal ids that with the smallest
    ``row_hash`` (a column over all columns), null ids last. Equal sets meet by their digest, others first along the
    links of their SimHash fingerprints (within ``radius`` bits), then in MinHash buckets, for those whose fingerprints lie further apart. Every pair
    is confirmed on whole sets, those in a bucket unless both are in one group already.
    Texts without words are one group, null texts among them. Very long texts are compared whole, some megabytes of texts
    at a time. An empty table gives an empty one; columns other than the three are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(row_hash).alias("row_hash"), F.col(text_col).cast("binary").alias("text"))
    sets = _distinct_sets(rows, shingle)
    entries = sets.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = cut(entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_by_bucket(_shared), "bucket long, node long, n long"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                of = [shingle_set(t.as_py(), shingle) for t in part.column(0)]
                yield pa.record_batch({**_key_columns(of), "hashes": pa.array([s.tobytes() for s in of], pa.binary())})

    linked = _simhash_pairs(sets, radius)
    met = shared.select("node").unionByName(linked.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = cut(sets.join(met, "node", "left_semi").select("node", "k1", "k2", F.col("least.row_hash").alias("wanted")))
    found = rows.join(wanted.select("wanted"), F.col("row_hash") == F.col("wanted"), "left_semi").select("text").mapInArrow(hashes, "k1 long, k2 long, hashes binary")
    members = cut(found.join(wanted, ["k1", "k2"]).select("node", "hashes").dropDuplicates(["node"]))

    shared = cut(shared.join(sets.select("node", "sketch"), "node").select("bucket", "node", "n", "sketch"))
    forest = cut(shared.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_forest_pairs(similarity), "a long, b long").unionByName(linked).distinct())
    links = _alike(forest, members, similarity)
    labels = components(links)
    labelled = shared.join(labels.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("bucket", F.coalesce("label", "node").alias("label"), "node", "n", "sketch")
    rest = labelled.repartition("bucket").sortWithinPartitions("bucket", "label").mapInArrow(_all_pairs(similarity), "a long, b long")
    tried = forest.withColumnsRenamed({"a": "u", "b": "v"})
    rest = rest.join(tried, (F.col("a") == F.col("u")) & (F.col("b") == F.col("v")), "left_anti")
    labels = components(links.unionByName(_alike(rest, members, similarity)))

    grouped = sets.select("node", "least").join(labels.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    return grouped.groupBy(F.coalesce("label", "node").alias("of")).agg(F.min("least").alias("least")).select("least.doc_id", "least.row_hash")
