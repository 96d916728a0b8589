"""Domain rules in any number: an index that names meet by equality, and an automaton for rules that fit in memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the pieces of plain rules by which names find them.
GRAM = 4
#: Characters of all rules of an automaton (some 50 bytes each) that is broadcast at most.
MOST_CHARS = 4_000_000


def _pieces(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters."""
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda at: F.substring(text, at, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def plain_keys(rules: DataFrame) -> DataFrame:
    """``value, rule, key`` of plain rules: of each one's pieces that which fewest rules hold, of a shorter rule all of it."""
    lowered = rules.select("value", F.lower("value").alias("rule"))
    short = lowered.where(F.length("rule") < GRAM).withColumn("key", F.col("rule"))
    pieces = lowered.where(F.length("rule") >= GRAM).withColumn("key", F.explode(F.array_distinct(_pieces(F.col("rule"), GRAM))))
    held = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    rarest = pieces.join(held, "key").groupBy("value", "rule").agg(F.min_by("key", F.struct("held", "key")).alias("key"))
    return short.unionByName(rarest)


def suffixes(name: Column) -> Column:
    """A name, and what is left of it after each of its dots."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda at: F.array_join(F.slice(labels, at, F.size(labels)), "."))


def rule_hits(names: DataFrame, rules: DataFrame) -> DataFrame:
    """``name, value``: each distinct lower-case name of ``names(name)`` with each rule of ``rules(value)`` that it meets.

    A plain rule is met by any name that contains it, ``*.x`` by x and what ends in .x; rules with other stars by none. Star rules are keyed by
    what follows the star, which is one of the name's suffixes. Plain rules are keyed by their rarest piece of ``GRAM``
    characters, which is one of the name's pieces, and then compared. Both sides may be of any size: they are
    joined by equality, which Spark broadcasts or splits as it sees fit. Empty and null names meet nothing.
    """
    names, rules = names.select(F.lower("name").alias("name")).where("name <> ''").distinct(), rules.select("value").where(F.col("value").isNotNull()).distinct()
    starred = rules.where(F.startswith("value", F.lit("*."))).select("value", F.lower(F.substring("value", 3, 1_000_000)).alias("key"))
    by_suffix = names.select("name", F.explode(suffixes(F.col("name"))).alias("key")).join(starred, "key").select("name", "value")
    name = F.col("name")
    keys = F.array_distinct(F.concat(F.array(F.lit("")), *(_pieces(name, size) for size in range(1, GRAM + 1))))
    found = names.select("name", F.explode(keys).alias("key")).join(plain_keys(rules.where(~F.contains("value", F.lit("*")))), "key").where(F.contains("name", F.col("rule")))
    return by_suffix.unionByName(found.select("name", "value"))


class DomainMatcher:
    """Whether names meet any of the rules: one automaton for all plain rules, a set for those with a star."""

    def __init__(self, domains: Iterable[str], patterns: Iterable[str]):
        self.plain = sorted({d.lower() for d in domains})
        self.suffixes = frozenset(p[2:].lower() for p in patterns if p.startswith("*."))
        self.automaton = ahocorasick.Automaton()
        for rule in filter(None, self.plain):
            self.automaton.add_word(rule, rule)
        if len(self.automaton):
            self.automaton.make_automaton()

    def hit(self, name: str | None) -> bool:
        if not name:
            return False
        name = name.lower()
        if "" in self.plain[:1] or len(self.automaton) and next(self.automaton.iter(name), None) is not None:
            return True
        at = 0
        while self.suffixes and at >= 0:
            if name[at:] in self.suffixes:
                return True
            at = name.find(".", at) + 1 or -1
        return False


#: The rules last used in this Python worker, and their matcher.
_built: list = [None, None]


def matched(spark: SparkSession, domains: Iterable[str], patterns: Iterable[str], name: Column) -> Column:
    """Whether a name meets a rule, by an automaton in each Python worker; equal names of a batch are looked up once. Raises for rules of more than ``MOST_CHARS``, for which there is ``rule_hits``."""
    domains, patterns = sorted(domains), sorted(patterns)
    size = sum(map(len, domains)) + sum(map(len, patterns))
    if size > MOST_CHARS:
        raise ValueError(f"{size} characters of domain rules are too many for an automaton; join them with rule_hits")
    shared = spark.sparkContext.broadcast((domains, patterns))

    @F.arrow_udf("boolean")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if _built[0] is not shared.value:
            _built[:] = [shared.value, DomainMatcher(*shared.value)]
        for column in columns:
            coded = column.dictionary_encode()
            hits = pa.array([_built[1].hit(x) for x in coded.dictionary.to_pylist()], pa.bool_())
            yield hits.take(coded.indices).fill_null(False)

    return run(name)
