"""Fill-in-the-middle forms against a plain restatement, and rank and select against counting."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from netquarry.llm import fill_in_middle as fim

SCHEMA = "doc_id long, text string, n long, form string, h1 string, output int"


def plain(doc_id, text):
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_against_plain_restatement(spark):
    rng = random.Random(12)
    parts = ["a", "bc", "é", "日本", " ", "  ", "\n", "\t", "\v", " ", " ", "<", ">", "<P", "S>", "<M>", "𝔸", "\x1c"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.choice((1, 3, 20, 200)))), 1, "f", "h", 2) for i in range(1500)]
    rows += [(None, "a null id", 1, "f", "h", 2), (7, None, 1, "f", None, None), (8, "", None, None, "h", 2), (9, " \n", 1, "f", "h", 2), (10, "one and the same", 1, "f", "h", 2), (10, "one and the same", 1, "f", "h", 2), (11, "long one é " * 50_000, 1, "f", "h", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    key = lambda r: (r[0] is None, r[0], r[1], r[5])
    want = sorted(((i, *plain(i, t), t or "") for i, t, *_ in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_rank_and_select_are_counts():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        for share in (0.0, 0.01, 0.5, 1.0):
            bits = rng.random(size) < share
            vector = fim.BitVector(bits)
            assert vector.rank(np.arange(size + 1)).tolist() == np.r_[0, np.cumsum(bits)].tolist()
            assert vector.select(np.arange(bits.sum())).tolist() == np.flatnonzero(bits).tolist()


def test_share_of_forms(spark):
    forms = fim.fill_in_middle(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))).groupBy("form").count().collect()
    share = {r.form: r["count"] / 4000 for r in forms}
    assert abs(share["plain"] - 0.5) < 0.05 and abs(share["spm"] - 0.4) < 0.05 and abs(share["psm"] - 0.1) < 0.03
