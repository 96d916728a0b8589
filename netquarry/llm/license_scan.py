"""License notices in texts: phrases word for word, and short notices with a bounded number of edits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import slices

# Phrases that count word for word, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices in lower-case words: the label, what may be edited, and the words that must follow unedited, as they tell one license from another.
NOTICES = (
    ("mit", "under the mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ""),
    ("apache-2", "apache license version", "2"),
    ("apache-1.1", "apache license version", "1 1"),
    ("gpl-2", "gnu general public license version", "2"),
    ("gpl-3", "gnu general public license version", "3"),
    ("lgpl-2.1", "gnu lesser general public license version", "2 1"),
    ("lgpl-3", "gnu lesser general public license version", "3"),
    ("agpl-3", "gnu affero general public license version", "3"),
    ("mpl-2", "mozilla public license version", "2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ""),
    ("cc-by", "licensed under cc", "by 4 0"),
    ("cc-by-nc", "licensed under cc", "by nc"),
    ("cc-by-sa", "licensed under cc", "by sa"),
    ("cc-by-nd", "licensed under cc", "by nd"),
    ("unlicense", "free and unencumbered software released into the public domain", ""),
)
#: One edit for so many characters of what may be edited.
CHARS_PER_EDIT = 10
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


class Place(NamedTuple):
    label: str
    first_word: int
    last_word: int
    edits: int
    base: bool
    score: float


class Notice:
    """A notice with its seeds: cut in one piece more than edits may fall into, so that some piece stands unedited wherever the notice does."""

    def __init__(self, label: str, loose: str, strict: str, chars_per_edit: int = CHARS_PER_EDIT):
        self.label, self.size, self.edits = label, len(loose), len(loose) // chars_per_edit
        self.rest = len(strict) + 1 if strict else 0
        ends = [len(loose) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.seeds = [(a, loose[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        self.pattern = regex.compile(rf"(?b)(?<= )(?:{regex.escape(loose, special_only=True)}){{e<={self.edits}}}{' ' + regex.escape(strict, special_only=True) if strict else ''}(?= )")

    def near(self, text: str, at: int) -> tuple[int, int, int] | None:
        """Start, end and edits of the best match that an unedited piece allows, whose seed says that the notice would start at ``at``."""
        begin = max(0, at - self.edits - 1)
        found = self.pattern.search(text[begin : max(0, at + self.size + self.edits + self.rest + 1)])
        return (begin + found.start(), begin + found.end(), sum(found.fuzzy_counts)) if found else None


class Scanner:
    """Finds phrases and seeds in one pass of an automaton, then verifies what the seeds suggest."""

    def __init__(self, phrases: Iterable[tuple[str, str]] = PHRASES, notices: Iterable[tuple[str, str, str]] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        self.notices = [Notice(*n, chars_per_edit) for n in notices]
        keys: dict[str, list[tuple]] = {}
        for phrase, label in phrases:
            keys.setdefault(f" {phrase} ", []).append((None, label, len(phrase)))
        for notice in self.notices:
            for offset, piece in notice.seeds:
                keys.setdefault(piece, []).append((notice, offset, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for key, values in keys.items():
            self.automaton.add_word(key, (len(key), values))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, Notice]]:
        """All verified (start, end, edits, notice) of ``words(...)``, one for each place that a seed suggests."""
        return self._found(text)[1]

    def _found(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int, Notice]]]:
        exact, tried, found = [], set(), set()
        for end, (size, values) in self.automaton.iter(text):
            at = end + 1 - size
            for notice, what, length in values:
                if notice is None:
                    exact.append((at + 1, at + 1 + length, what))
                elif (notice, at - what) not in tried:
                    tried.add((notice, at - what))
                    if match := notice.near(text, at - what):
                        found.add((*match, notice))
        return exact, list(found)

    def places(self, text: str) -> list[Place]:
        """The phrases' places and the notices', in order. Of notices that overlap the one with fewest edits stays, then the longer, then the first."""
        exact, found = self._found(text)
        kept: list[tuple[int, int, int, Notice]] = []
        for group in _overlapping(found):
            taken: list[tuple[int, int, int, Notice]] = []
            for one in sorted(group, key=lambda m: (m[2], m[0] - m[1], m[0], self.notices.index(m[3]))):
                if all(one[1] <= a or b <= one[0] for a, b, _, _ in taken):
                    taken.append(one)
            kept += taken
        rows = [(a, b, label, 0, True, 1.0) for a, b, label in exact] + [(a, b, n.label, edits, False, 1 - edits / n.size) for a, b, edits, n in kept]
        rows.sort()
        out, word, last = [], -1, 0
        for a, b, label, edits, base, score in rows:
            word, last = word + text.count(" ", last, a), a
            out.append(Place(label, word, word + text.count(" ", a, b), edits, base, score))
        return out


def _overlapping(found: list[tuple[int, int, int, Notice]]) -> Iterator[list[tuple[int, int, int, Notice]]]:
    """Matches in groups that overlap one another."""
    group: list[tuple[int, int, int, Notice]] = []
    end = -1
    for one in sorted(found, key=lambda m: m[:3]):
        if group and one[0] >= end:
            yield group
            group = []
        group.append(one)
        end = max(end, one[1]) if len(group) > 1 else one[1]
    if group:
        yield group


def words(text: bytes) -> tuple[str, int]:
    """The text as lower-case words (A-Z only), one space before and after each, and their number."""
    found = text.translate(_WORDS).split()
    return f" {b' '.join(found).decode('utf-8', 'replace')} " if found else " ", len(found)


_PLACES = "array<struct<label: string, first_word: bigint, last_word: bigint, edits: int, base: boolean>>"
_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())]))


def license_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """``doc_id, n_words, places, score`` of each row: where phrases and notices stand in its whole text, by words from 0.

    Words are runs of ASCII letters, digits and anything beyond ASCII. A phrase stands where its words follow each other. A notice stands
    at a run of whole words (with single spaces) within one edit for ``chars_per_edit`` characters of its loose part, its
    strict words following unedited. Each notice is cut into one piece more than its edits; one automaton finds
    pieces and phrases, and the regex library's bounded-error match verifies the few characters around each piece. The
    score is 1 for a phrase, else the largest share of unedited characters, 0 where nothing stands. Nothing is shuffled.

    Null and empty texts have no words and no places. Rows are looked at one by one: repeated rows and ids repeat their
    results, a null id stays null. Very long texts are searched whole. An empty table gives an empty one; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, chars_per_edit)
        for batch in batches:
            for part in slices(batch, 1):
                n_words, places, score = [], [], []
                for value in part.column(1):
                    text, n = words(value.as_py() or b"")
                    found = scanner.places(text)
                    n_words.append(n)
                    places.append([p._asdict() for p in found])
                    score.append(max((p.score for p in found), default=0.0))
                yield pa.record_batch({"doc_id": part.column(0), "n_words": pa.array(n_words, pa.int64()), "places": pa.array(places, _TYPE), "score": pa.array(score, pa.float64())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id long, n_words long, places {_PLACES}, score double")
