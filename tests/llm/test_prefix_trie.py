"""The trie of conversations against one built turn by turn in Python, and against its SQL."""

import hashlib
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from netquarry.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, pos int, digest string, class long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    own: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, sha(f"{len((role or '').encode())}:{role or ''}{text or ''}"), role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def trie(convs):
    members: dict = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {p: [0, 0] for p in members}
    children: dict = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p, who in members.items():
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in children
            below[p[:d]][1] += (len(who) - 1) * len(p[-1][1]) if p else 0
    rows = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        rows.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children.get(p, ())), *below[p], sha(ends)))
    return sorted(rows, key=str)


def made(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "d", 2) for r in rows], SCHEMA).repartition(parts)


def found(turns, convs):
    return sorted(map(tuple, prefix_trie.prefix_trie(turns, convs).collect()), key=str)


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 700), 60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(("user", "assistant", None)), rng.choice(("a", "bé", "", None, "日本語"))))
    return rows + rows[:7]


def test_rebuilt_conversations(spark, tmp_path):
    for seed in (1, 2):
        rows = random_rows(seed) + [(None, 0, "user", "no conversation"), (300, 0, "user", "long " * 50_000)] + [(400, t, "user", f"{t % 3}") for t in range(500)] + [(c, t, "user", f"{t % 3}") for c in (401, 402, 403) for t in range(9)]
        path = tmp_path / str(seed)
        made(spark, rows, 5).write.parquet(str(path / "conversations.parquet"))
        got = queries.op11_prefix_trie(spark, str(path))
        assert got.columns == [c.split()[0] for c in prefix_trie.NODES.split(", ")]
        want = trie(rebuilt(ordered(rows)))
        assert sorted(map(tuple, got.collect()), key=str) == want
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
        assert sorted(con.execute(prefix_trie.oracle_sql()).fetchall(), key=str) == want


def test_copies_and_deep_forks(spark, small_chunks):
    base = [("user", f"turn {i}") for i in range(7)]
    convs = {c: list(base) for c in range(1, 30)} | {50: base[:3], 51: base[:3], 60: [*base, ("user", "on")], 61: [*base[:5], ("user", "off")], 62: [("other", "alone"), *base], 63: [("other", "alone"), *base]}
    df = made(spark, [(c, i, *turn) for c, turns in convs.items() for i, turn in enumerate(turns)])
    turns = prefix_trie.cut(prefix_trie.numbered_turns(df))
    assert found(turns, turns.select("conv_id").distinct()) == trie(convs)
    assert sorted((r.conv_id, r.pos, r.chars, r.cum) for r in turns.collect())[:3] == [(1, 1, 6, 6), (1, 2, 6, 12), (1, 3, 6, 18)]


def test_one_conversation_none_and_none_with_turns(spark, small_chunks):
    one = made(spark, [(5, 0, "u", "a"), (5, 1, "u", "b"), (6, 0, "u", "a"), (6, 1, "u", "b")])
    turns = prefix_trie.cut(prefix_trie.numbered_turns(one))
    assert found(turns, turns.select("conv_id").distinct()) == trie({5: [("u", "a"), ("u", "b")], 6: [("u", "a"), ("u", "b")]})
    ids = spark.range(7, 12).select(F.col("id").alias("conv_id"))
    assert found(turns.limit(0), ids) == trie({c: [] for c in range(7, 12)})
    assert found(turns, ids.unionByName(turns.select("conv_id").distinct())) == trie({c: [] for c in range(7, 12)} | {5: [("u", "a"), ("u", "b")], 6: [("u", "a"), ("u", "b")]})
    assert found(turns.limit(0), ids.limit(0)) == []
    assert prefix_trie.prefix_trie(*prefix_trie.forked(prefix_trie.numbered_turns(one.limit(0)))).count() == 0


def test_a_conversation_over_many_tasks(spark):
    rows = [(9, t // 2, "u", "x" * (t % 5)) for t in range(400)] + [(3, 0, "u", "é"), (12, 0, "u", "b")] + [(10, 1, "u", "same")] * 50
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.numbered_turns(made(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, own = [], ordered(rows)
    for c, turns in own.items():
        total = 0
        for i, (_, text) in enumerate(turns, 1):
            total += len(text)
            want.append((c, i, len(text), total))
    assert sorted((r.conv_id, r.pos, r.chars, r.cum) for r in got) == sorted(want)
