"""``python -m netquarry.cli IN OUT``: filters a capture by rules and prints what was found."""

from __future__ import annotations

import argparse

from netquarry.operators.rules import RuleSet
from netquarry.plans.analysis import analyze
from netquarry.session import session
from netquarry.sources.exports import console


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="netquarry", description="Filters a packet capture and reports on it.")
    parser.add_argument("input")
    parser.add_argument("output")
    for kind in ("ip", "app", "domain"):
        parser.add_argument(f"--block-{kind}", action="append", default=[])
    parser.add_argument("--rules", help="rules file, read before the other rules")
    parser.add_argument("--lbs", type=int, default=2, help="balancers")
    parser.add_argument("--fps", type=int, default=2, help="workers of each balancer")
    parser.add_argument("--verbose", action="store_true")
    given = parser.parse_args(args)
    rules = RuleSet.load(given.rules) if given.rules else RuleSet()
    for kind, add in (("ip", rules.block_ip), ("app", rules.block_app), ("domain", rules.block_domain)):
        for value in getattr(given, f"block_{kind}"):
            add(value)
    found = analyze(session(), given.input, rules, balancers=given.lbs, workers=given.fps).persist()
    found.write_capture(given.output)
    print(console(found))
    if given.verbose:
        found.details.orderBy("id").show(100, truncate=False)
    found.unpersist()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
