"""Domain rules by index and by automaton against comparing each name with each rule."""

import random

import pytest
from pyspark.sql import functions as F

from netquarry.operators import rule_index, rules
from netquarry.operators.rules import RuleSet


def meets(name, rule):
    name, rule = name.lower(), rule.lower()
    if rule.startswith("*."):
        return bool(name) and (name.endswith(rule[1:]) or name == rule[2:])
    return bool(name) and "*" not in rule and rule in name


def drawn(rng, names, n):
    made = {"", "*.", "a*b", "*a", "*.com", ".", "É", "*.ü.de", "x"}
    while len(made) < n:
        name = rng.choice(names)
        a = rng.randrange(len(name) + 1)
        made.add(rng.choice((name[a : a + rng.randint(1, 9)], "*." + name[a:], name[a:].upper(), f"{name[a:]}{rng.randint(0, 9)}")))
    return sorted(made)


def random_names(rng, n):
    return ["".join(rng.choice("abcx.é") for _ in range(rng.randint(1, 14))) for _ in range(n)] + ["www.x.com", "COM", "ü.de", "a.ü.de", "aü.de", "b.", "..", "zzz"]


def test_index_and_automaton_meet_what_comparing_does(spark, monkeypatch):
    rng = random.Random(5)
    names = random_names(rng, 150)
    table = drawn(rng, names, 300)
    df = spark.createDataFrame([(n,) for n in [*names, *names[:20], "", None]], "name string")
    hits = rule_index.rule_hits(df, spark.createDataFrame([(r,) for r in [*table, table[3], None]], "value string"))
    assert sorted(map(tuple, hits.collect())) == sorted((n, r) for n in {x.lower() for x in names} for r in table if meets(n, r))
    for some in (table, [r for r in table if r], ["*.com", "*.x"], ["zz"]):
        chosen = RuleSet.of(domains=some)
        for most in (0,) if len(some) > 64 else (0, 64):  # one by one only what a plan can hold
            monkeypatch.setattr(rules, "MOST_LITERALS", most)
            got = {r.name: r.hit for r in df.select("name", chosen.domain_hit(F.col("name")).alias("hit")).collect()}
            assert got == {n: bool(n) and any(meets(n, r) for r in some) for n in [*names, "", None]}


def test_a_hundred_thousand_rules(spark, monkeypatch):
    names = spark.range(3000).select(F.concat(F.lit("host"), F.col("id").cast("string"), F.lit(".net"), (F.col("id") % 7).cast("string"), F.lit(".example.org")).alias("name"))
    table = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("st"), F.col("id").cast("string"), F.lit(".n"))).otherwise(F.concat(F.lit("*.net"), F.col("id").cast("string"), F.lit(".example.org"))).alias("value"))
    hits = rule_index.rule_hits(names, table)
    assert "NestedLoop" not in hits._jdf.queryExecution().executedPlan().toString()
    want = {(f"host{i}.net{i % 7}.example.org", f"st{i}.n") for i in range(0, 3000, 2)} | {(f"host{i}.net{i % 7}.example.org", f"*.net{i % 7}.example.org") for i in range(3000) if i % 7 % 2}
    assert set(map(tuple, hits.collect())) == want
    many = RuleSet.of(domains=[r.value for r in table.collect()])
    assert names.where(many.domain_hit(F.col("name"))).count() == len({n for n, _ in want})
    monkeypatch.setattr(rule_index, "MOST_CHARS", 100)
    with pytest.raises(ValueError):
        many.domain_hit(F.col("name"))
