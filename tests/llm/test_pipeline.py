"""The registered queries and the pipeline on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from netquarry.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DIR).checkpoint()
        if name != "sharding":
            assert after.columns == columns
            assert after.join(before, "doc_id", "left_anti").count() == 0
            assert after.count() == after.select("doc_id").distinct().count() <= before.count()
        else:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        before = after
    kept = {r.text for r in stage_texts(spark, after)}
    assert len(kept) == after.count()  # no copies are left


def stage_texts(spark, sharded):
    return spark.read.parquet(f"{DIR}/documents.parquet").join(sharded.select("doc_id"), "doc_id", "left_semi").select("text").collect()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars int, kept string, language string, text_hash long, row int, mark long, tokens long, `a.b` int, more map<string, int>"
LONG = " ".join(f"word{i} and" for i in range(60_000))
ENGLISH = "the quick brown fox jumps over the lazy dog while the cat sleeps near the warm fire in the old house by the river".split()


def odd_rows():
    rows = [(i, " ".join(ENGLISH[i % 7 :] + [f"number{i * j}" for j in range(1, 9)]), "en", f"src{i % 3}") for i in range(24)]
    rows += [(30, rows[0][1], "en", "src1"), (31, None, "en", "src1"), (32, "", None, None), (33, " \t\n", "en", None), (34, "123 ...", "en", "x"), (35, LONG, "en", "src1"), (36, rows[5][1], None, None)]
    rows += [(0, rows[0][1], "en", "src0"), (1, "an other text of this id that is like no other one here", "en", "src1"), (None, rows[2][1], "en", "src2"), (None, "no id but words which nobody else has written down yet", "en", "src2")]
    return [(*r, None, f"k{r[0]}", "mine", 5, 6, 7, 8, 9, {"x": 1} if r[0] else None) for r in rows]


def test_stages_keep_odd_rows_and_columns(spark):
    """Nulls in any column, empty and long texts, copies, repeated rows and ids, and columns whose names stages might use."""
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    kept = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DIR).cache()
        kept[name] = [tuple(r) for r in after.collect()]
        if name != "sharding":
            assert after.schema.names == docs.schema.names
            assert all(r in rows for r in kept[name])
            before = after
    texts = lambda name: {(r[0], r[1]) for r in kept[name]}
    assert texts("language_id") == {(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    assert len(kept["language_id"]) == len([r for r in rows if r[1] and any(c.isalpha() for c in r[1])])  # repeated rows stay
    deduped = kept["near_dedup"]
    assert len(deduped) == len({r[1] for r in deduped}) == len({r[1] for r in kept["language_id"]})
    assert {r[0] for r in deduped} == {*range(24), 35, 1, None} and (0, rows[0][1]) in texts("near_dedup") and (2, rows[2][1]) in texts("near_dedup")
    assert texts("decontamination") == texts("near_dedup")
    assert {r[0] for r in kept["sharding"]} == {r[0] for r in kept["mixing"]}


def test_run_is_the_stages_one_after_another(spark):
    found = {r.doc_id: (r.shard, r.slot) for r in corpus_pipeline.run(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR).checkpoint()
    assert found == {r.doc_id: (r.shard, r.slot) for r in docs.collect()}


def brute_pipeline(spark):
    """The kept ids by plain Python over all pairs, with the operator's own language decisions."""
    docs = [r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    known = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, spark.read.parquet(f"{DIR}/documents.parquet"), DIR).collect()}
    docs = sorted((r for r in docs if r.doc_id in known), key=lambda r: r.doc_id)
    sets = []
    for r in docs:
        words = r.text.encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = [r for i, r in enumerate(docs) if find(i) == i]
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect() if r.text]
    return {r.doc_id for r in docs if not any(item in flat(r.text) for item in items)}


def test_pipeline_against_brute_force(spark):
    """Near-duplicates and decontamination of the smallest tables; the planted passages are whole items."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, DIR).checkpoint()
    assert {r.doc_id for r in docs.collect()} == brute_pipeline(spark)


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang")
    found = queries.op1_language_id(spark, DIR).join(docs, "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for of in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {of} AS SELECT * FROM '{DIR}/{of}.parquet'")
    want = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)
