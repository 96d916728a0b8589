"""License notices against edit distances over all runs of words, and phrases against a plain scan of words."""

import random
import re

from netquarry.llm import license_scan as ls
from netquarry.llm import queries

SCHEMA = "doc_id long, text string, places int, n_words string, label string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def stands(words, loose, strict, edits):
    """Fewest edits of the loose part over all runs of words that the strict words follow; None beyond ``edits``."""
    tail, best = strict.split(), None
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + len(loose.split()) + edits + 1) + 1):
            if words[j : j + len(tail)] == tail and abs(len(run := " ".join(words[i:j])) - len(loose)) <= edits:
                d = distance(run, loose)
                best = d if d <= edits and (best is None or d < best) else best
    return best


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abc xé")
        elif kind == 1:
            out.insert(at, rng.choice("abc xé"))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def test_notices_against_all_runs_of_words():
    rng = random.Random(13)
    scanner = ls.Scanner()
    filler = "the license under version apache mit general cc by nc 2 3 gnu of ünder".split()
    found = missed = 0
    for _ in range(400):
        label, loose, strict = rng.choice(ls.NOTICES)
        middle = edited(rng, loose, rng.randrange(len(loose) // 10 + 3)) + (" " + strict if strict else "")
        text = " ".join(rng.choices(filler, k=rng.randrange(6))) + " " + middle + rng.choice((" ", "! ", "")) + " ".join(rng.choices(filler, k=rng.randrange(6)))
        words, n = ls.words(text.encode())
        assert words.split() == split(text) and n == len(split(text))
        best = {}
        for _, _, edits, notice in scanner.matches(words):
            best[notice] = min(edits, best.get(notice, 99))
        for notice, (_, a, b) in zip(scanner.notices, ls.NOTICES, strict=True):
            want = stands(split(text), a, b, notice.edits)
            assert best.get(notice) == want, (text, a, b, want, best.get(notice))
            found, missed = found + (want is not None), missed + (want is None)
    assert found > 150 and missed > 1000


def test_overlaps_go_to_the_fewest_edits():
    text, _ = ls.words(b"Released under the GNU Lesser General Public Licence, version 3; see the GNU General Public License version 2.")
    assert [(p.label, p.first_word, p.last_word, p.edits, p.base) for p in ls.Scanner().places(text)] == [("lgpl-3", 3, 9, 1, False), ("gpl-2", 12, 17, 0, False)]


def test_query(spark, tmp_path):
    rows = [
        (1, "Released under the MIT License."), (2, "under  the\tmit-LICENSE under the mit license"), (3, "Licensed under the Apache License, Version 2.0."), (4, "apache license version 20"), (5, "CC BY-NC 4.0 and under the MIT licence"), (6, None), (7, ""), (8, "..."),
        (None, "cc by nc"), (9, "cc by nc cc by nc"), (9, "cc by nc cc by nc"), (10, "under the mit licenseé"), (11, "word é " * 40_000 + "Under the Mit License"), (12, "GNU general public licence version 3"), (13, "ccbync cc by ncs"),
    ]
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_license_scan(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    seen = sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r[0]))
    want = []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = split(text)
        places = [(k, label) for phrase, label in ls.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want.append((i, len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))))
    assert [r[:6] for r in seen] == want
    labels = {r[0]: (r[6], r[7]) for r in seen}
    assert labels[1] == ("mit", 1.0) and labels[3] == ("apache-2", 1.0) and labels[5] == ("cc-by-nc,mit", 1.0) and labels[6] == labels[7] == labels[8] == labels[4] == labels[13] == ("", 0.0)
    assert labels[12][0] == "gpl-3" and 0.9 < labels[12][1] < 1 and labels[10][0] == "mit" and labels[11] == ("mit", 1.0)
    assert queries.license_scan.license_places(spark.createDataFrame([], SCHEMA)).count() == 0
