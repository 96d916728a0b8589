"""Near-duplicates of the pipeline against all pairs of shingle sets."""

import random

import corpus_pipeline
from netquarry.llm import near_dup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pairs_at_the_similarity_go_and_others_stay(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for tenths in (1.4, 2.6):  # a tail of new words gives similarities of about 0.86 and 0.74
            cut = int(len(words) * (1 - tenths / 20))
            texts.append(" ".join(words[:cut] + [f"x{rng.randrange(10_000)}" for _ in range(len(words) - cut)]))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = sorted({find(a) for a in range(len(texts))})
    assert 40 < len(want) < len(texts)
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == want


def test_repeated_ids_and_rows(spark):
    one, other = ("one two three four five six seven", "eight nine ten eleven twelve thirteen")
    rows = [(1, one, "en", "s0", 1), (1, one, "en", "s0", 1), (1, one, "de", "s1", 1), (1, other, "en", "s0", 1), (2, other, "en", "s0", 1), (2, "  ", "en", "s0", 1), (None, one, "en", "s0", 1), (None, "alone", "en", "s0", 1), (3, None, "en", "s0", 1)]
    results = [sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(x, SCHEMA).repartition(n), "").collect()), key=str) for x, n in ((rows, 1), (rows[::-1], 3))]
    assert results[0] == results[1]
    assert [(r[0], r[1]) for r in results[0]] == [(1, other), (1, one), (2, "  "), (None, "alone")]


def test_simhash_links_are_candidates(spark):
    """Texts whose fingerprints lie within four bits are paired by SimHash, as op7 links them, before any MinHash bucket."""
    rng = random.Random(3)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(10_000)}" for _ in range(800)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    rows = spark.createDataFrame([(i, i, bytearray(t.encode())) for i, t in enumerate(texts)], "doc_id long, row_hash long, text binary").repartition(3)
    sets = near_dup._distinct_sets(rows, 5)
    ids = {r.node: r.least.doc_id for r in sets.collect()}
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    near = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if (prints[a] ^ prints[b]).bit_count() <= 4}
    assert len(near) > 20
    assert {tuple(sorted((ids[r.a], ids[r.b]))) for r in near_dup._simhash_pairs(sets, 4).collect()} == near
