"""Mixing of sources to target weights: budgets down a domain-language-source tree, then seeded prefixes of its leaves."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from netquarry.llm.common import cut, packed

#: Levels of the tree, as columns.
LEVELS = ("domain", "language", "origin")
#: A plan of at most so many leaves is broadcast; a larger one is joined by its keys.
BROADCAST_LEAVES = 100_000
#: Weights in production; nodes without one weigh 1.
WEIGHTS: Mapping[str, Mapping[str, int]] = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "language": {"en": 5, "de": 2, "fr": 2, "es": 1}, "origin": {}}
#: The budget is this share (numerator, denominator) of all tokens; a leaf gives at most MAX_EPOCHS times its tokens.
SHARE, MAX_EPOCHS, SEED = (6, 10), 2, 17


@F.arrow_udf(T.LongType())
def word_count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        yield pa.array([len(t.as_py().split()) if t.is_valid else 0 for t in column], pa.int64())


def leaf_columns(lang_col: str = "lang", source_col: str = "source") -> dict[str, Column]:
    """The tree's keys of a document: a source's domain is its trailing number modulo 4 (d0 without one); null is an unnamed node."""
    number = F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(`{source_col}`, '([0-9]{{1,9}})$', 1), '') AS INT)"), F.lit(0))
    return {"domain": F.concat(F.lit("d"), (number % 4).cast("string")), "language": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "origin": F.coalesce(F.col(source_col).cast("string"), F.lit(""))}


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    found = F.lit(1).cast("long")
    for name, w in weights.items():
        found = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(found)
    return found


def fill(nodes: DataFrame, parents: list[str], level: str, weights: Mapping[str, int]) -> DataFrame:
    """Deals ``given`` of each parent to its children (``capacity``) by weight; replaces ``given`` by the child's part.

    What a child can't take goes to its siblings by their weights: in order of capacity over weight
    those that fill up form a prefix, which one running total finds. Children of weight 0 have no capacity and get nothing.
    """
    name = level
    nodes = nodes.withColumn("w", _weight(level, weights))
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.when(F.col("w") > 0, F.col("capacity") / F.col("w")).otherwise(0.0), name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest_w = F.sum("w").over(siblings) - F.sum("w").over(order) + F.col("w")
    rest_b = F.col("given") - F.sum("capacity").over(order) + F.col("capacity")
    nodes = nodes.withColumn("full", F.col("capacity") * rest_w <= F.col("w") * rest_b)
    full_c = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(siblings)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(siblings)
    part = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("((given - full_c) * w) div open_w"))
    return nodes.withColumn("full_c", full_c).withColumn("open_w", open_w).withColumn("given", part).drop("w", "full", "full_c", "open_w")


def leaf_budgets(leaves: DataFrame, budget: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """``domain, language, origin, tokens, budget, epochs, rest`` of each leaf of ``leaves(domain, language, origin, tokens)``.

    A node takes at most what its leaves hold in ``max_epochs`` epochs. So a shortage is met by the
    siblings first, and only what a whole subtree lacks goes to the siblings of an ancestor. A leaf below any node of
    weight 0 takes nothing, also where all siblings weigh 0.
    """
    barred = reduce(lambda a, b: a | b, (_weight(level, weights.get(level, {})) == 0 for level in LEVELS))
    leaves = leaves.withColumn("capacity", F.when(barred, 0).otherwise(F.col("tokens") * max_epochs))
    given = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("given", F.lit(budget).cast("long")) if given is None else nodes.join(given, keys[:-1])
        given = fill(nodes, keys[:-1], level, weights.get(level, {})).select(*keys, "given")
    return (
        leaves.join(given, list(LEVELS)).withColumn("epochs", F.expr("CASE WHEN tokens > 0 THEN given div tokens ELSE 0 END"))
        .select(*LEVELS, "tokens", F.col("given").alias("budget"), "epochs", (F.col("given") - F.col("epochs") * F.col("tokens")).alias("rest"))
    )


def _order(seed: int, id_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("epochs") + 1).cast("string"), F.col(id_col).cast("string")).cast("binary"))


def plan(narrow: DataFrame, id_col: str, share: tuple[int, int], weights: Mapping[str, Mapping[str, int]], max_epochs: int, seed: int) -> DataFrame:
    """The leaves' budgets with the order range in which the last epoch's prefix ends, and the tokens before that range.

    narrow: ``id_col, domain, language, origin, tokens`` of each document.
    """
    leaves = cut(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    total, rows = leaves.agg(F.sum("tokens"), F.max("rows")).first()
    total = total or 0
    budgets = cut(leaf_budgets(leaves.drop("rows"), total * share[0] // share[1], weights, max_epochs))
    digits = order_digits(rows or 0)
    ranges = narrow.join(_small(budgets.select(*LEVELS, "epochs")), list(LEVELS)).groupBy(*LEVELS, F.left(_order(seed, id_col), F.lit(digits)).alias("range")).agg(F.sum("tokens").alias("here"))
    running = F.sum("here").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edges = ranges.withColumn("before", running - F.col("here")).join(_small(budgets.select(*LEVELS, "rest")), list(LEVELS))
    edges = edges.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("here"))).select(*LEVELS, F.col("range").alias("edge"), "before")
    return cut(budgets.join(edges, list(LEVELS), "left"))


def order_digits(rows: int) -> int:
    """Leading hex digits of the order hash whose ranges cut the largest leaf into about the root of its rows: a leaf's running
    total is taken over these ranges, and row by row in one range only."""
    return max(2, -(-max(1, rows).bit_length() // 8))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else df


def selected(rows: DataFrame, leaf_plan: DataFrame, id_col: str, seed: int) -> DataFrame:
    """The rows that the plan takes, with ``epoch``: whole epochs, then the longest prefix of the next one within the rest.

    rows: any columns, ``id_col``, the levels and ``tokens``. Rows without tokens are never taken.
    """
    columns = rows.columns
    rows = rows.where("tokens > 0").join(_small(leaf_plan.drop("tokens")), list(LEVELS)).withColumn("place", _order(seed, id_col))
    at = F.left(F.col("place"), F.length("edge"))
    in_order = Window.partitionBy(*LEVELS).orderBy("place", id_col, "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where(at == F.col("edge")).withColumn("taken", F.sum("tokens").over(in_order) + F.col("before") <= F.col("rest"))
    others = rows.where(F.col("edge").isNull() | (at != F.col("edge"))).withColumn("taken", F.coalesce(at < F.col("edge"), F.lit(False)))
    times = F.col("epochs") + F.col("taken").cast("long")
    return edge.unionByName(others).where(times > 0).select(*columns, "budget", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("epoch"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: tuple[int, int] = SHARE, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, domain, language, origin, tokens, budget, epoch``: a row for each time that a document is taken.

    Tokens are words of the whole text; the budget is a share of all tokens. Null texts have none, and
    documents without tokens are never taken. Null languages and sources are unnamed nodes. Equal ids
    stand together in the order. Repeated rows count and are taken each. Budgets are rounded down at
    each node. Very long texts count whole. An empty table gives an empty result. Extra columns are ignored.
    """
    keys = leaf_columns(lang_col, source_col)
    narrow = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c.alias(k) for k, c in keys.items()), word_count(F.col(text_col).cast("binary")).alias("tokens")))
    return selected(narrow, plan(narrow, "doc_id", share, weights, max_epochs, seed), "doc_id", seed)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: tuple[int, int] = SHARE, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes within one epoch, with the columns of ``docs``, whatever their names. Cases as in ``mix``."""
    keys = leaf_columns(lang_col, source_col)
    rows = docs.select(packed(docs), F.col(id_col).cast("long").alias("order_id"), *(c.alias(k) for k, c in keys.items()), word_count(F.col(text_col).cast("binary")).alias("tokens"))
    narrow = cut(rows.select("order_id", *LEVELS, "tokens"))
    return selected(rows, plan(narrow, "order_id", share, weights, 1, seed), "order_id", seed).select("row.*")


def _sql_fill(source: str, parents: str, level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS[level].items())
    weight = f"CASE {level} {cases} ELSE 1 END" if cases else "1"
    over = f"PARTITION BY {parents}" if parents else ""
    order = f"{over} ORDER BY capacity / w, {level} ROWS UNBOUNDED PRECEDING"
    return f"""(SELECT *, CASE WHEN fills THEN capacity ELSE ((given - sum(CASE WHEN fills THEN capacity ELSE 0 END) OVER ({over})) * w) // (sum(CASE WHEN fills THEN 0 ELSE w END) OVER ({over})) END AS part FROM (
      SELECT *, capacity * (sum(w) OVER ({over}) - sum(w) OVER ({order}) + w) <= w * (given - sum(capacity) OVER ({order}) + capacity) AS fills
      FROM (SELECT *, {weight} AS w FROM {source})))"""


def oracle_sql() -> str:
    """``mix`` with the production parameters, as DuckDB SQL."""
    return rf"""
WITH docs AS (
  SELECT doc_id, 'd' || (coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT), 0) % 4) AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents
), leaves AS (SELECT domain, language, origin, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {MAX_EPOCHS} AS capacity FROM docs GROUP BY ALL
), a AS (SELECT domain, part FROM {_sql_fill(f"(SELECT domain, sum(capacity) AS capacity, (SELECT sum(tokens) * {SHARE[0]} // {SHARE[1]} FROM docs) AS given FROM leaves GROUP BY ALL)", "", "domain")}
), b AS (SELECT domain, language, part FROM {_sql_fill("(SELECT domain, language, sum(capacity) AS capacity, any_value(a.part) AS given FROM leaves JOIN a USING (domain) GROUP BY ALL)", "domain", "language")}
), c AS (SELECT domain, language, origin, tokens AS held, part::BIGINT AS budget, CASE WHEN tokens > 0 THEN part // tokens ELSE 0 END AS epochs
         FROM {_sql_fill("(SELECT leaves.*, b.part AS given FROM leaves JOIN b USING (domain, language))", "domain, language", "origin")}
), placed AS (
  SELECT doc_id, domain, language, origin, tokens, budget, epochs,
         sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY md5(concat_ws(':', '{SEED}', (epochs + 1)::BIGINT, doc_id)), doc_id, tokens ROWS UNBOUNDED PRECEDING) <= budget - epochs * held AS taken
  FROM docs JOIN c USING (domain, language, origin) WHERE tokens > 0
)
SELECT doc_id, domain, language, origin, tokens, budget, unnest(range(1, (epochs + taken::INT + 1)::BIGINT)) AS epoch FROM placed
"""
