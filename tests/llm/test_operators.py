"""Each corpus operator against brute force, and its results for nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from netquarry.llm import ann, common, decontamination, language_id, language_model, line_dedup, mixing, quality, sharding, simhash, warc
from netquarry.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, score double, held_out boolean, v int, label int"
LONG = "the long one and " * 20_000
VOCABULARY = {"en": "the of and with this that from was thing other".split(), "fr": "le la de et que étre pour avec dans èque".split(), "de": "der die und nicht über auf sich ein für schön".split()}


def make(spark, rows):
    """Documents with columns whose names operators use within."""
    return spark.createDataFrame([(i, t, lang, s, None, 1, "k", 0.5, None, 7, 3) for i, t, lang, s in rows], SCHEMA)


def text(rng, lang="en", n=60):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(("", "er", "s", "ing")) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long one, copies, repeated rows."""
    rng = random.Random(0)
    base = [text(rng) for _ in range(6)]
    rows = [(1, base[0], "en", "src1"), (2, base[0], "en", "src2"), (2, base[0], "en", "src2"), (3, None, "en", None), (4, "", None, "src1"), (5, " \t\n", "en", "src1"), (None, base[1], "en", "src3"), (6, LONG, "en", "src1"), (7, "123 ###", "fr", "x")]
    rows += [(10 + i, text(rng, lang), lang, f"src{i % 5}") for i, lang in enumerate(list(VOCABULARY) * 4)]
    return make(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


# -- language ID


def test_language_id(spark, odd, none):
    model = language_id.train(odd)
    found = by_id(language_id.identify(odd, model))
    assert sum(map(len, found.values())) == odd.count()
    for i in (3, 4, 5, 7):
        assert tuple(found[i][0].language) == ("und", 0.0)
    assert found[2][0].language == found[2][1].language and 0 < found[6][0].language.score <= 1
    assert all(found[10 + i][0].language.lang_pred == lang for i, lang in enumerate(list(VOCABULARY) * 4))
    assert language_id.train(none) is None and language_id.identify(none, None).count() == 0
    assert {r.language.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def test_presence_is_set_membership():
    texts = [b"abcab", b"", b"zz"]
    found = language_id.presence(np.frombuffer(b"".join(texts), np.uint8), np.array([5, 0, 2]))
    assert found.sum(axis=1).tolist() == [len({t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}) for t in texts]


def test_landmarks_on_every_text_are_kernel_ridge_regression():
    rng = random.Random(9)
    langs = ["en", "fr", "de"] * 6
    data = [text(rng, lang, 8).encode() for lang in langs]
    found = language_id.presence(np.frombuffer(b"".join(data), np.uint8), np.array(list(map(len, data))))
    model = language_id.Model(np.packbits(found, axis=1), langs, landmarks=len(data), ridge=0.1)
    unit = found / np.sqrt(found.sum(axis=1, keepdims=True))
    y = np.array([[1.0 if a == b else -1.0 for b in model.langs] for a in langs])
    values = (unit @ unit.T) @ np.linalg.solve(unit @ unit.T + 0.1 * np.eye(len(data)), y - y.mean(axis=0)) + y.mean(axis=0)
    share = np.clip((values + 1) / 2, 1e-6, 1)
    best, score = model.predict(found)
    assert best.tolist() == values.argmax(axis=1).tolist()
    assert np.allclose(score, share.max(axis=1) / share.sum(axis=1), atol=1e-4)


# -- nearest neighbours


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).round(2)
    x[40:80] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(500, None, 1), (520, [0.0] * 8, 1), (540, [1.0] * 7 + [float("nan")], 1), (560, [1.0] * 7 + [None], 1), (580, [1.0] * 3, 1), (None, [1.0] * 8, 1), (20, x[20].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").withColumn("score", F.lit(1))
    got: dict = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = x.astype(np.float32).astype(float)
    assert set(got) == set(range(0, 300, 20))
    hits = 0
    for q, found in got.items():
        score = (x * x[q]).sum(axis=1)
        best = [int(j) for j in np.lexsort((np.arange(300), -score)) if j != q][:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert np.allclose([s for _, _, s in found], score[[v for _, v, _ in found]])
        hits += len(set(best) & {v for _, v, _ in found})
        if q in (40, 60):
            assert [v for _, v, _ in found] == best  # ties go to smaller ids
    assert hits >= 0.9 * 20 * len(got)
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 0")).count() == 0


def test_bounds_hold_on_random_vectors():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(20_000, 32)), rng.normal(size=(20, 32))
    turn, centre = ann.rotation(32), x.mean(axis=0)
    codes, factor, error = ann.encode(x, centre, turn)
    bits, scale = ann.planes(q, centre, turn)
    low, high = ann.bounds(codes, factor, error, bits, scale)
    exact = q @ x.T
    assert ((low <= exact) & (exact <= high)).mean() > 0.7
    best = np.argsort(-exact, axis=1)[:, :10]
    found = {(a, b) for i, j, _, _ in ann.survivors(codes, factor, error, bits, scale, 10) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert np.mean([(a, b) in found for a in range(20) for b in best[a].tolist()]) >= 0.95
    assert len(found) < 20 * 20_000 / 10  # most vectors aren't fetched


@pytest.mark.parametrize(("dim", "n"), [(64, 20_000), (256, 20_000), (768, 8_000)])
def test_recall_does_not_fall_with_length(dim, n):
    rng = np.random.default_rng(dim)
    x, q = rng.normal(size=(n, dim)).astype(np.float32), rng.normal(size=(16, dim))
    turn, centre = ann.rotation(dim), x.mean(axis=0)
    assert turn.shape == (8 * dim, dim) and np.allclose(turn.T @ turn, np.eye(dim))
    codes, factor, error = ann.encode(x, centre, turn)
    found = {(a, b) for i, j, _, _ in ann.survivors(codes, factor, error, *ann.planes(q, centre, turn), 20) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    recall = [np.mean([(a, b) in found for b in best[a].tolist()]) for a in range(len(q))]
    assert np.mean(recall) >= 0.97 and min(recall) >= 0.85, (np.mean(recall), min(recall), len(found) / len(q))
    assert len(found) < len(q) * n / 20


# -- mixing


def test_mixing(spark, odd, none):
    taken = mixing.mix(odd).collect()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in odd.collect()}
    total = sum(len((r.text or "").encode().split()) for r in odd.collect())
    spent: Counter = Counter()
    for r in taken:
        assert r.tokens == words[r.doc_id] > 0
        spent[r.domain, r.language, r.origin] += r.tokens
    assert all(spent[r.domain, r.language, r.origin] <= r.budget for r in taken) and 0 < sum(spent.values()) <= total * 6 // 10
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).columns == none.columns
    rows = mixing.mixed_rows(odd, share=(1, 1))
    assert rows.columns == odd.columns and rows.count() == sum(len((r.text or "").split()) > 0 for r in odd.collect())


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "fr", "c", 1000), ("d1", "en", "d", 1000)], "domain string, language string, origin string, tokens long")
    got = {r.origin: r.budget for r in mixing.leaf_budgets(leaves, 800, {"domain": {}, "language": {}, "origin": {}}, 1).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "d": 400}
    got = {r.origin: r.budget for r in mixing.leaf_budgets(leaves.where("origin <> 'b'"), 1600, {}, 1).collect()}
    assert got == {"a": 10, "c": 790, "d": 800}


def test_weight_zero_takes_nothing(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "fr", "c", 1000), ("d1", "en", "d", 1000)], "domain string, language string, origin string, tokens long")
    got = {r.origin: r.budget for r in mixing.leaf_budgets(leaves, 800, {"domain": {"d1": 0}, "language": {"fr": 0}, "origin": {}}, 1).collect()}
    assert got == {"a": 10, "b": 790, "c": 0, "d": 0}
    got = {r.origin: r.budget for r in mixing.leaf_budgets(leaves, 800, {"origin": {"a": 0, "b": 0}}, 1).collect()}
    assert got == {"a": 0, "b": 0, "c": 400, "d": 400}
    got = {r.origin: r.budget for r in mixing.leaf_budgets(leaves, 800, {"domain": {"d0": 0, "d1": 0}}, 1).collect()}
    assert set(got.values()) == {0}


def test_large_plans_are_joined(spark, odd, monkeypatch):
    want = sorted(map(tuple, mixing.mix(odd).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert sorted(map(tuple, mixing.mix(odd).collect()), key=str) == want


# -- line dedup


def brute_lines(rows):
    strip = "".join(map(chr, [32, *range(9, 14)]))
    keys = lambda t: [(x, "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in x.strip(strip))) for x in (t or "").split("\n")]
    holders: dict = {}
    for i, t in rows:
        for _, k in keys(t):
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        stay = [x for x, k in keys(t) if len(k) < 20 or len(holders[k]) < 3 or i == max((h for h in holders[k] if h is not None))]
        out.append((i, "\n".join(stay), len(keys(t)), len(keys(t)) - len(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("bits", "most_bits", "most_part"), [(None, 1 << 29, 1 << 27), (1 << 16, 1 << 29, 1 << 27), (1 << 20, 1 << 17, 1 << 27), (1 << 22, 1 << 18, 1 << 17)])
def test_line_dedup(spark, odd, none, monkeypatch, bits, most_bits, most_part):
    """Filters of one size; a first filter of longer positions than the second; and one of more parts than the second."""
    monkeypatch.setattr(line_dedup, "MOST_BITS", most_bits)
    monkeypatch.setattr(line_dedup, "MOST_PART", most_part)
    rng = random.Random(2)
    lines = ["a common line of enough length", "  A COMMON line of enough length\t", "é" * 20, "é" * 19, "short", "another line that is repeated", "", "x" * 25 + "\r"]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 6)))) for i in range(60)] + [(None, lines[0]), (7, lines[5]), (7, None), (99, "only one of its kind, this line")]
    df = make(spark, [(i, t, None, None) for i, t in rows])
    for shared in (1_000_000, 0):  # lines go where texts are read, or texts are shuffled
        monkeypatch.setattr(line_dedup, "MOST_SHARED", shared)
        got = sorted(map(tuple, line_dedup.drop_shared_lines(df, bits=bits).collect()), key=str)
        assert got == brute_lines(rows)
    assert line_dedup.drop_shared_lines(none, bits=bits).count() == 0
    if bits is None:
        assert {r.doc_id: r.n_dropped for r in line_dedup.drop_shared_lines(odd).collect()}[6] == 0


def test_shared_keys_are_told_by_all_their_bytes():
    keys = np.array([[5, 1], [5, 9], [5, 4], [0, 0], [7, 7]], np.uint64)
    as_keys = lambda x: np.frombuffer(x.tobytes(), "V16")
    known = line_dedup.Shared.of(as_keys(keys), np.arange(10, 15))
    found, keeper = known.keepers(as_keys(np.array([[5, 4], [5, 5], [7, 7], [0, 0], [9, 9], [5, 1], [5, 9]], np.uint64)))
    assert found.tolist() == [True, False, True, True, False, True, True] and keeper[found].tolist() == [12, 14, 13, 10, 11]
    assert line_dedup.Shared.of(as_keys(keys[:0]), np.zeros(0, np.int64)).longest == 0


@pytest.mark.parametrize(("bits", "most_bits", "most_part"), [(1 << 20, 1 << 29, 1 << 27), (1 << 20, 1 << 17, 1 << 27), (1 << 20, 1 << 17, 1 << 18)])
def test_line_filters(monkeypatch, bits, most_bits, most_part):
    """Every key of two slices, or seen twice in one, is suspected; of the others few are."""
    monkeypatch.setattr(line_dedup, "MOST_BITS", most_bits)
    monkeypatch.setattr(line_dedup, "MOST_PART", most_part)
    texts = [[f"the line of number {i} of this text" for i in range(a, b)] for a, b in ((0, 3000), (2900, 6000), (6000, 9000), (8990, 9000))]
    text = [[b"\n".join(line.encode() for line in lines)] for lines in texts]
    layout, rows = line_dedup.Layout.of(bits), []
    for some in ([text[0]], [text[1]], [text[2], text[3]]):
        for out in line_dedup._seen(layout, 20)(iter([pa.record_batch({"text": pa.array([t for (t,) in some], pa.binary())})])):
            rows += out.to_pylist()
    seconds = layout.seconds
    assert all(r["part"] < layout.parts for r in rows)
    rows.sort(key=lambda r: (r["part"] % seconds, r["part"]))
    batch = pa.record_batch({"second": [r["part"] % seconds for r in rows], "part": [r["part"] for r in rows], "places": pa.array([r["places"] for r in rows], pa.binary()), "again": [r["again"] for r in rows]})
    twice = np.zeros(seconds * line_dedup.SECOND_PART // 8, np.uint8)
    for out in line_dedup._fold(layout)(iter([batch])):
        for r in out.to_pylist():
            twice[r["second"] * 8192 : (r["second"] + 1) * 8192] = np.frombuffer(r["twice"], np.uint8)
    asked = pa.record_batch({"doc_id": pa.array(range(4), pa.int64()), "text": pa.array([t for (t,) in text], pa.binary())})
    hit = {r["key"] for out in line_dedup._suspects(SimpleNamespace(value=twice), layout, 20)(iter([asked])) for r in out.to_pylist()}
    digest = lambda i: line_dedup.xxhash.xxh3_128_digest(f"the line of number {i} of this text".encode())
    again = {digest(i) for i in [*range(2900, 3000), *range(8990, 9000)]}
    assert again <= hit and len(hit - again) <= 30


# -- WARC


def test_warc(spark, tmp_path):
    magic = "WARC/1.1\r\n"
    payloads = [None, "", "a" * 10, magic + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + magic * 3, "b" * 3000 + magic + "c" * 9000 + magic + "WARC-Type: x\r\nContent-Length: 1\r\n\r\nz" + "d" * 2000, "a" * 10, "é" * 4000 + ("x" * 50 + magic) * 300, "end" + magic]
    rows = [(i, f"http://x/{i}\r\n", p, 1) for i, p in enumerate(payloads)] + [(None, None, "a" * 10, 1), (None, None, "only nulls", 1), (2, "http://x/2", "a" * 10, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, length int").coalesce(2)
    first: dict = {}
    for i, _, p, _ in rows:
        if i is not None:
            first.setdefault(p or "", i)
    want = []
    for i, _, p, _ in rows:
        data, lead = (p or "").encode(), first.get(p or "")
        again = lead is not None and i != lead
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", lead if again else None))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for n, size in enumerate(("64m", "2k")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            warc.write_archives(df, str(tmp_path / f"w{n}"))
            assert sorted(map(tuple, warc.page_records(spark, str(tmp_path / f"w{n}")).collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    warc.write_archives(df, str(tmp_path / "some"), least_bytes=11)
    assert {r.record_type for r in warc.page_records(spark, str(tmp_path / "some")).collect()} == {"response"}
    warc.write_archives(df.limit(0), str(tmp_path / "none"))
    assert warc.page_records(spark, str(tmp_path / "none")).count() == 0


def test_long_payloads_over_many_splits_and_joined_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    long = ("long payload " * 100 + "WARC/1.1\r\n" + "\u00fc" * 700) * 200
    df = spark.createDataFrame([(1, "u", long), (2, "u", "short"), (3, "u", long), (4, "u", "short" + long)], "page_id long, url string, html string").coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
        warc.write_archives(df, str(tmp_path / "w"))
        found = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_records(spark, str(tmp_path / "w")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    size = len(long.encode())
    assert found == {1: (size, "response", None), 2: (5, "response", None), 3: (size, "revisit", 1), 4: (size + 5, "response", None)}


# -- sharding


def best(sizes, shards):
    """Minimax contiguous partition by dynamic programming."""
    cum = np.r_[0, np.cumsum(sizes)]
    now = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        now = [min(max(now[m], int(cum[i] - cum[m])) for m in range(i + 1)) for i in range(len(sizes) + 1)]
    return now[-1]


def test_smallest_capacity():
    rng = np.random.default_rng(0)
    for _ in range(40):
        sizes, shards = rng.integers(1, 50, rng.integers(1, 15)), int(rng.integers(1, 6))
        assert sharding.smallest_capacity(sizes, shards)[0] == best(sizes, shards)


def test_sharding(spark, odd, none, monkeypatch):
    rng = random.Random(1)
    rows = [(i, text(rng, n=rng.randint(1, 30)), None, None) for i in range(400)] + [(1000 + i, "hot " * 40, None, None) for i in range(200)]
    monkeypatch.setattr(sharding, "CELLS", 64)  # several refinements
    for df in (odd, make(spark, rows)):
        got = sharding.shard(df, 5).collect()
        assert len(got) == df.count()
        texts = {r.doc_id: r.text for r in df.collect()}
        places: dict = {}
        for r in got:
            t = texts[r.doc_id]
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes", None) and 0 <= r.shard < 5
            places.setdefault((t is None, t), set()).add(r.shard)
        assert all(len(p) == 1 for p in places.values())
        for s in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    total = Counter()
    for r in got:
        total[r.shard] += r.size
    hot = 200 * (160 + 8)
    groups = spark.createDataFrame([(r.text,) for r in df.collect()], "t string").where("t NOT LIKE 'hot%'").groupBy(F.xxhash64("t").alias("h")).agg(F.sum(F.octet_length("t") + 8).alias("z")).collect()
    ordered = [g.z for g in sorted(groups, key=lambda g: g.h % 2**64)]
    assert sorted(total.values())[-1] == hot and max(v for v in total.values() if v != hot) == sharding.smallest_capacity(np.array(ordered), 4)[0]
    assert sharding.shard(none, 5).count() == 0


# -- SimHash


def brute_fingerprint(t):
    words = (t or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams))


def test_simhash(spark, odd, none):
    rng = random.Random(3)
    base = [text(rng, n=200).split() for _ in range(5)]
    rows = []
    for i in range(60):
        words = list(base[i % 5])
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), None, None))
    for df in (odd, make(spark, rows)):
        texts = [(r.doc_id, r.text) for r in df.collect()]
        fps = [brute_fingerprint(t) for _, t in texts]
        root = list(range(len(fps)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[find(a)] = find(b)
        least: dict = {}
        for i, (doc, _) in enumerate(texts):
            if doc is not None:
                least[find(i)] = min(doc, least.get(find(i), doc))
        want = sorted(((doc, f"{fp:016x}", least.get(find(i))) for i, ((doc, _), fp) in enumerate(zip(texts, fps, strict=True))), key=str)
        assert sorted(map(tuple, simhash.simhash_components(df).collect()), key=str) == want
    assert simhash.simhash_components(none).count() == 0


def test_segments_follow_the_count(spark, odd, monkeypatch):
    assert [simhash.segments_for(n, 4) for n in (0, 10**5, 5 * 10**6, 10**7, 10**12)] == [3, 3, 3, 2, 2]
    want = sorted(map(tuple, simhash.simhash_components(odd).collect()), key=str)
    monkeypatch.setattr(simhash, "FEW", 0)
    assert sorted(map(tuple, simhash.simhash_components(odd).collect()), key=str) == want


@pytest.mark.parametrize(("heavy", "broadcast"), [(10**9, 0), (1, 0), (5, 200_000)])
def test_hot_keys_are_dealt_out(spark, odd, monkeypatch, heavy, broadcast):
    """All keys heavy, none, or some; nodes salted or broadcast: the results are the same."""
    want = sorted(map(tuple, simhash.simhash_components(odd).collect()), key=str)
    lines = sorted(map(tuple, line_dedup.drop_shared_lines(odd).collect()), key=str)
    monkeypatch.setattr(common, "HEAVY", heavy)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    assert sorted(map(tuple, simhash.simhash_components(odd).collect()), key=str) == want
    assert sorted(map(tuple, line_dedup.drop_shared_lines(odd).collect()), key=str) == lines


@pytest.mark.parametrize(("radius", "segments"), [(4, 3), (4, 2), (9, 5)])
def test_links_connect_what_all_pairs_connect(spark, radius, segments, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 8)  # dense buckets are searched outwards
    rng = random.Random(radius)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        fps |= {x} | {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 2))) for _ in range(20)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    label = {r.node: r.label for r in components(simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, segments)).collect()}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                p, q = find(signed[a]), find(signed[b])
                root[max(p, q)] = min(p, q)
    assert {x: label.get(x, x) for x in signed} == {x: find(x) for x in signed}


# -- quality


def test_quality(spark, odd, none):
    rng = random.Random(5)
    rows = [(100 + i, text(rng) + "." if i % 3 else " ".join("$$$#" for _ in range(30)), None, None) for i in range(90)]
    labels = spark.createDataFrame([(100 + i, int(i % 3 > 0), 0) for i in range(90)] + [(None, 1, 0), (101, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    df = make(spark, rows).unionByName(odd)
    features = df.select("doc_id", quality.document_statistics(F.col("text").cast("binary")).alias("features")).cache()
    got = by_id(quality.scored(features, quality.train(features, labels)))
    assert sum(map(len, got.values())) == df.count()
    assert all(got[100 + i][0].predicted == int(i % 3 > 0) for i in range(90))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for rows_ in got.values() for r in rows_)
    assert got[3][0].score == got[4][0].score
    assert {r.score for r in quality.scored(features, quality.train(features, labels.limit(0))).collect()} == {0.5}
    empty = none.select("doc_id", quality.document_statistics(F.col("text").cast("binary")).alias("features"))
    assert quality.scored(empty, quality.train(empty, labels)).count() == 0


def test_discriminant_is_the_normal_density():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = {c: rng.normal(c, 1 + c, (500, d)) for c in (0, 1)}
    model = quality.Model({c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()}, shrink=0, pool=0)
    p = rng.normal(size=(3, d))
    for c in (0, 1):
        cov = np.cov(x[c].T, bias=True) + 1e-4 * np.eye(d)
        away = p - x[c].mean(axis=0)
        want = np.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)
        assert np.allclose(model.log_density(p, c), want)


# -- language model


def test_language_model(spark, odd, none, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 25)  # most words are joined
    rng = random.Random(6)
    df = make(spark, [(100 + i, text(rng, lang), None, None) for i, lang in enumerate(list(VOCABULARY) * 10)]).unionByName(odd)
    trained = df.where("doc_id IS NULL OR doc_id < 125")
    model, counts = language_model.train(trained)
    got = by_id(language_model.scored(df, model, counts, keep=("source",)))
    assert sum(map(len, got.values())) == df.count()
    c: Counter = Counter()
    for r in trained.collect():
        c.update((r.text or "").encode().lower().split())
    ends = trained.count()
    n, v = sum(c.values()) + ends, len(c) + 1
    for r in df.collect():
        words = (r.text or "").encode().lower().split()
        one = got[r.doc_id][0]
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words) + np.log10((ends + 1) / (n + v + 1))
        assert (one.n_tokens, one.n_known, one.train_tokens) == (len(words) + 1, sum(c[w] > 0 for w in words) + 1, n)
        assert one.base_score == pytest.approx(base, rel=1e-9)
        # by hand: the class's probability after two classes, times the word's share of its class
        head = [w for w, i in model.index.items() if i < language_model.WORDS]
        cls = [head.index(w) if w in head else language_model.group_of(w) for w in words] + [language_model.END]
        before = [language_model.END, language_model.END, *cls]
        value = 0.0
        for j, (w, k) in enumerate(zip([*words, None], cls, strict=True)):
            logits = np.log(10) * (model.first[before[j + 1]] + model.second[before[j]]).astype(float)
            value += (logits[k] - np.log(np.exp(logits).sum())) / np.log(10)
            if k > language_model.END:
                own = [n for x, n in c.items() if x not in head and language_model.group_of(x) == k]
                value += np.log10((c[w] + 1) / (sum(own) + len(own) + 1))
        assert one.score == pytest.approx(value, rel=1e-4)
    assert language_model.scored(none, model, counts).count() == 0
    model, counts = language_model.train(none)
    assert {r.n_known for r in language_model.scored(odd, model, counts).collect()} == {0}


def test_network_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    texts = [np.r_[np.tile([1, 2, 3], 40), language_model.END] for _ in range(60)]
    unigram = np.bincount(np.concatenate(texts), minlength=language_model.CLASSES) + 1.0
    net = language_model.Network(unigram)
    for _ in range(80):
        net.learn(texts, rng)
    first, second, norm = net.tables()
    for a, b in rng.integers(0, language_model.CLASSES, (5, 2)):
        assert (10 ** (first[a] + second[b] - norm[a, b]).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    assert 10 ** (first[1, 2] + second[3, 2] - norm[1, 3]) > 0.8


# -- decontamination


def brute_distance(p, t):
    before = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        now = [i]
        for j, b in enumerate(t, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(200):
        p, t = "".join(rng.choices("abc", k=rng.randint(1, 30))), "".join(rng.choices("abc", k=rng.randint(0, 50)))
        assert decontamination.edit_distance_within(decontamination.char_masks(p), len(p), t) == brute_distance(p, t)


def test_every_match_within_the_budget_is_found():
    rng = random.Random(2)
    for _ in range(150):
        item = decontamination.normalised("".join(rng.choices("abcd ", k=rng.randint(25, 80))))
        if len(item) < decontamination.SHORT:
            continue
        chars = list(item)
        for _ in range(rng.randint(0, len(item) // 7)):
            at, what = rng.randrange(len(chars)), rng.random()
            chars[at : at + (what < 0.6)] = [] if what < 0.3 else [rng.choice("abcd")]
        t = decontamination.normalised("".join(rng.choices("abcd ", k=30)) + "".join(chars) + "".join(rng.choices("abcd ", k=30)))
        found = decontamination.Matcher([item], 0.1).hits(t).get(0)
        assert (found is not None) == (brute_distance(item, t) <= int(0.1 * len(item)))


def test_short_items_have_edits_as_whole_words():
    rng = random.Random(5)
    hits = 0
    for _ in range(600):
        item = decontamination.normalised("".join(rng.choices("abc  2+", k=rng.randint(4, 19))))
        if not item:
            continue
        chars = list(item)
        for _ in range(rng.randint(0, 2)):
            at, what = rng.randrange(len(chars) + 1), rng.random()
            chars[at : at + (what < 0.6)] = [] if what < 0.3 else [rng.choice("abc2")]
        t = decontamination.normalised("".join(rng.choices("abc  +", k=8)) + rng.choice((" ", "")) + "".join(chars) + rng.choice((" ", "")) + "".join(rng.choices("abc  +", k=8)))
        edges = [x for x in range(len(t) + 1) if decontamination.at_edge(t, x)]
        budget = int(0.1 * len(item))
        best = min((max(len(item), b - a) if min(len(item), b - a) == 0 else whole_distance(item, t[a:b]) for a in edges for b in edges if a <= b <= a + len(item) + budget), default=99)
        found = decontamination.Matcher([item], 0.1).hits(t).get(0)
        assert found == (best if best <= budget else None), (item, t)
        hits += found is not None
    assert hits > 50


def whole_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_decontamination(spark, odd, none, monkeypatch):
    item = "The quick brown fox jumps over the lazy dog, again and again."
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "2 + 2 = 4", "x"), (None, "y" * 50, "x"), (4, "z" * 40, "x"), (5, " ", "x"), (6, "fort", "x")], "item_id long, text string, doc_id string")
    rows = [(200, "so: " + item.upper().replace(" ", "\n ") + " end", None, None), (201, item.replace("lazy", "lady"), None, None), (201, item.replace("lazy", "lady"), None, None), (202, item[:30], None, None), (203, LONG + item + LONG, None, None), (None, item, None, None), (204, "is 2 +  2 = 4?", None, None), (205, "12 + 2 = 4", None, None), (206, "y" * 50, None, None), (207, "comfort, forte", None, None), (208, "a FORT.", None, None)]
    df = make(spark, rows).unionByName(odd)
    want = sorted([("200", 1, 0), ("201", 1, 1), ("201", 1, 1), ("203", 1, 0), ("None", 1, 0), ("204", 3, 0), ("206", None, 0), ("208", 6, 0)], key=str)
    for block in (decontamination.BLOCK_CHARS, 10):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", block)
        assert sorted(((str(r.doc_id), r.item_id, r.distance) for r in decontamination.benchmark_hits(df, items).collect()), key=str) == want
        assert decontamination.without_benchmark(df, items).count() == df.count() - len(want)
    assert decontamination.benchmark_hits(df, items.limit(0)).count() == 0
    assert decontamination.benchmark_hits(none, items).count() == 0
