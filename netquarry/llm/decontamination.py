"""Benchmark passages in documents: exact pieces by the pigeonhole principle, verified by bit-parallel edit distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import cut

#: Share of an item's characters that may be edited.
EDITS = 0.1
#: Normalised items shorter than this hit by chance within other words; with their edits they must stand as whole words.
SHORT = 20
#: Characters of benchmark text that are broadcast at once; a larger benchmark takes several passes, each written before the next.
BLOCK_CHARS = 4_000_000


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def edit_distance_within(masks: dict[str, int], length: int, text: str) -> int:
    """Smallest edit distance of a pattern to any substring of ``text`` (Myers' bit vectors, the pattern in one integer)."""
    every = (1 << length) - 1
    top = 1 << (length - 1)
    more, less, score, best = every, 0, length, length
    for c in text:
        same = masks.get(c, 0)
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up = less | (every & ~(across | more))
        fall = more & across
        if up & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best = score
        up <<= 1
        more = ((fall << 1) | ~(down | up)) & every
        less = up & down & every
    return best


def at_edge(text: str, at: int) -> bool:
    """Whether a word may begin or end here: not between two letters or digits."""
    return not (0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum())


def whole_word_distance(pattern: str, text: str, first: int, last: int, most: int) -> int | None:
    """Smallest edit distance of a pattern to the parts of ``text`` from a word's edge in ``first`` to ``last`` to another one; None beyond ``most``."""
    best = most + 1
    for start in range(max(0, first), min(last, len(text)) + 1):
        if not at_edge(text, start):
            continue
        row = list(range(len(pattern) + 1))
        for end in range(start, min(len(text), start + len(pattern) + most) + 1):
            if end > start:
                before, row[0] = row[0], end - start
                for j, c in enumerate(pattern, 1):
                    before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != text[end - 1]))
            if row[-1] < best and at_edge(text, end):
                best = row[-1]
    return best if best <= most else None


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


class Item:
    """A benchmark text in budget + 1 pieces, and the binary tree above them.

    A node above j pieces may have j - 1 edits. If a node matches, one of its two children does
    within its own budget, so a piece's hit is checked upwards and most chance hits end at its parent.
    """

    def __init__(self, text: str, edits: float):
        self.text, self.short = text, len(text) < SHORT
        self.budget = int(edits * len(text))
        n = self.budget + 1
        self.edges = [len(text) * j // n for j in range(n + 1)]
        self.masks: dict[tuple[int, int], dict[str, int]] = {}

    def stands(self, text: str, at: int) -> bool:
        """Whether an exact hit counts: a short item's only as whole words."""
        return not self.short or at_edge(text, at) and at_edge(text, at + len(self.text))

    def ancestors(self, piece: int) -> list[tuple[int, int]]:
        """(first piece, end piece) of the nodes above a piece, the lowest first."""
        low, high, path = 0, self.budget + 1, []
        while high - low > 1:
            path.append((low, high))
            middle = (low + high) // 2
            low, high = (low, middle) if piece < middle else (middle, high)
        return path[::-1]

    def verify(self, text: str, piece: int, at: int) -> int | None:
        """Distance of the best match around a hit of ``piece`` at ``at``; None beyond the budget."""
        distance = 0
        for low, high in self.ancestors(piece):
            a, b, budget = self.edges[low], self.edges[high], high - low - 1
            start = at - (self.edges[piece] - a)
            window = text[max(0, start - budget) : start + (b - a) + budget]
            if (low, high) not in self.masks:
                self.masks[low, high] = char_masks(self.text[a:b])
            distance = edit_distance_within(self.masks[low, high], b - a, window)
            if distance > budget:
                return None
        if self.short:
            start = at - self.edges[piece]
            return whole_word_distance(self.text, text, start - self.budget, start + self.budget, self.budget)
        return distance


class Matcher:
    """Items by their place in a list."""

    def __init__(self, items: list[str], edits: float):
        self.items = [Item(text, edits) for text in items]
        self.pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, item in enumerate(self.items):
            for p, (a, b) in enumerate(zip(item.edges, item.edges[1:], strict=False)):
                self.pieces[item.text[a:b]].append((i, p))
        self.automaton = ahocorasick.Automaton()
        for piece in self.pieces:
            self.automaton.add_word(piece, piece)
        if self.pieces:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> dict[int, int]:
        """Item to the smallest distance found, for the items within their budget."""
        found: dict[int, int] = {}
        if not text or not self.pieces:
            return found
        text = normalised(text)
        tried: set[tuple[int, int, int]] = set()
        for last, piece in self.automaton.iter(text):
            at = last + 1 - len(piece)
            for i, p in self.pieces[piece]:
                item = self.items[i]
                if found.get(i) == 0:
                    continue
                start = at - item.edges[p]
                if start >= 0 and text.startswith(item.text, start) and item.stands(text, start):
                    found[i] = 0
                    continue
                if not item.budget or (i, p, at) in tried:
                    continue
                tried.add((i, p, at))
                distance = item.verify(text, p, at)
                if distance is not None:
                    found[i] = min(distance, found.get(i, distance))
        return found


#: The block last used in this Python worker, and the matcher built from it.
_built: list = [None, None]


def hits_of(block, edits: float, text: Column) -> Column:
    """array<struct<item_id, distance>> of a text. block: a broadcast of (item_id, normalised text)."""

    @F.arrow_udf("array<struct<item_id: long, distance: int>>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys = [k for k, _ in block.value]
        if _built[0] is not block.value:
            _built[:] = [block.value, Matcher([t for _, t in block.value], edits)]
        matcher = _built[1]
        for column in columns:
            rows = [[{"item_id": keys[i], "distance": d} for i, d in sorted(matcher.hits(t.as_py()).items())] for t in column]
            yield pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())])))

    return run(text)


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[tuple]:
    """(broadcast, whether it is the last) of the benchmark's items, ``BLOCK_CHARS`` characters at once. Null and blank texts are left out; null ids stay null."""
    sc = benchmark.sparkSession.sparkContext
    held: list[tuple[int | None, str]] = []
    size = 0
    for key, text in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        text = normalised(text)
        if not text:
            continue
        if held and size + len(text) > BLOCK_CHARS:
            yield sc.broadcast(held), False
            held, size = [], 0
        held.append((key, text))
        size += len(text)
    if held:
        yield sc.broadcast(held), True


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: float = EDITS) -> DataFrame:
    """``doc_id, item_id, distance``: which rows hold a benchmark text within ``edits`` of its length.

    Texts and items are compared whole, however long, in lower case with white space runs as one space. Items of less than
    ``SHORT`` characters hit only as whole words, with as many edits as their length allows (none below 10 characters). There is a row for each document row and item row that match, with
    the distance found; clean documents have none. Null and blank texts and items match nothing; an item's id may be
    null; repeated rows give repeated results; an empty table or benchmark gives an empty result. Extra columns are
    ignored. One block's items are in memory at a time.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int")
    for n, (block, last) in enumerate(blocks(benchmark)):
        hits = docs.select("doc_id", F.explode(hits_of(block, edits, F.col("text"))).alias("hit")).select("doc_id", "hit.item_id", "hit.distance")
        if n or not last:
            hits = cut(hits)
            block.unpersist()
        found = found.unionByName(hits) if n else hits
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text, all columns as they are. No row is shuffled. Cases as in ``benchmark_hits``."""
    for n, (block, last) in enumerate(blocks(benchmark)):
        docs = docs.where(F.size(hits_of(block, edits, F.col(text_col))) == 0)
        if n or not last:
            docs = cut(docs)
            block.unpersist()
    return docs
