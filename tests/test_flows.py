"""The sorted, streaming state machine against a plain restatement of it."""

import random

from pyspark.sql import functions as F

from netquarry.operators.flows import alive, flow_table, newest, run_flows, sessions, summaries, tuples
from netquarry.operators.rules import RuleSet
from netquarry.operators.views import rows_of_map

COLUMNS = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, packet_no long, ts_sec int, ts_usec int, frame_length int, has_tcp boolean, tcp_flags int, found_by string, found_app string, found_sni string"


def plain(packets, apps, domains):
    """Actions and final (state, app, sni) of one flow."""
    state, app, sni, fin, syn, synack, actions = "NEW", "Unknown", "", False, False, False, []
    for flags, found in packets:
        if flags & 2:
            if flags & 16:
                synack = True
            else:
                syn = True
        if syn and synack and flags & 16 and state == "NEW":
            state = "ESTABLISHED"
        if flags & 1:
            fin = True
        if flags & 4:
            state = "CLOSED"
        if fin and flags & 16:
            state = "CLOSED"
        if state == "BLOCKED":
            actions.append("DROP")
            continue
        if state != "CLASSIFIED" and found:
            (app, sni), state = found, "CLASSIFIED"
        if app in apps or sni and any(d in sni for d in domains):
            state = "BLOCKED"
            actions.append("DROP")
        else:
            actions.append("FORWARD")
    return actions, (state, app, sni)


def test_random_flows(spark):
    rng = random.Random(4)
    findings = [None, None, None, ("YouTube", "youtube.com"), ("HTTPS", ""), ("HTTPS", "bad.com"), ("Zoom", "zoom.us"), ("Unknown", "")]
    flows = [[(rng.choice((2, 18, 16, 24, 17, 4, 16, 24)), rng.choice(findings)) for _ in range(rng.randint(1, 12))] for _ in range(300)]
    rows = [("10.0.0.1", "10.0.0.2", i, 443, 6, k * 1000 + i, k, 0, 60, True, flags, "TLS" if found else None, found and found[0], found and found[1]) for i, flow in enumerate(flows) for k, (flags, found) in enumerate(flow)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    some = (RuleSet.of(apps=("YouTube",), domains=("bad",)), {"YouTube"}), (RuleSet.of(apps=("no such app",), domains=("bad",)), {"Unknown"}), (RuleSet(), set())
    for (rules, apps), span in ((some[0], 1 << 22), (some[0], 3000), (some[1], 1000), (some[2], 5000)):
        run = run_flows(df, rules, span)
        domains = ("bad",) if apps else ()
        actions: dict = {}
        for r in run.orderBy("packet_no").collect():
            actions.setdefault(r.src_port, []).append(r.action)
        ends = {r.src_port: (r.state, r.application, r.sni) for r in flow_table(tuples(summaries(df, rules, span), rules)).collect()}
        for i, flow in enumerate(flows):
            assert (actions[i], ends[i]) == plain(flow, apps, domains), (i, flow)


def test_one_flow_over_eight_ranges_and_small_batches(spark):
    """A flow of most packets: no task gets more than a range of it, and the states that pass from run to run, and from batch to batch, are those of the whole."""
    rng = random.Random(11)
    findings = [None] * 6 + [("YouTube", "youtube.com"), ("HTTPS", "bad.com"), ("Zoom", "zoom.us")]
    packets = [(rng.choice((2, 18, 16, 24, 17, 4, 0, 0, 8)), rng.choice(findings)) for _ in range(4000)]
    rows = [("10.0.0.1", "10.0.0.2", 1, 443, 6, k, k, 0, 60, True, flags, "TLS" if found else None, found and found[0], found and found[1]) for k, (flags, found) in enumerate(packets)]
    rules = RuleSet.of(apps=("YouTube",), domains=("bad",))
    actions, end = plain(packets, {"YouTube"}, ("bad",))
    df = spark.createDataFrame(rows, COLUMNS).repartition(6)
    for most in ("10000", "37"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            found = summaries(df, rules, 500).cache()
            assert found.agg(F.max("packets")).first()[0] <= 500 and found.where("first_packet_no div 500 <> last_no div 500").isEmpty()
            flow = tuples(found, rules).first()
            assert [r.action for r in run_flows(df, rules, 500).orderBy("packet_no").collect()] == actions
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert ((flow.state, flow.application, flow.sni), flow.packets, flow.dropped) == (end, 4000, actions.count("DROP"))


def test_silent_flows_begin_anew(spark):
    """Sessions cut within runs, between runs and between batches are the flows of the packets between silences."""
    rng = random.Random(13)
    findings = [None] * 3 + [("YouTube", "youtube.com"), ("HTTPS", "bad.com"), ("Zoom", "zoom.us")]
    rows, want, now = [], {}, [0] * 5
    for k in range(600):
        i = rng.randrange(5)
        flags, found = rng.choice((2, 18, 16, 24, 17, 4, 0)), rng.choice(findings)
        late = k - now[i] > 9 or not any(key[0] == i for key in want)
        now[i] = k
        first = k if late else max(key[1] for key in want if key[0] == i)
        want.setdefault((i, first), []).append((flags, found))
        rows.append(("10.0.0.1", "10.0.0.2", i, 443, 6, k, k, 0, 60, True, flags, "TLS" if found else None, found and found[0], found and found[1]))
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    for span, most in ((1 << 22, "10000"), (100, "10000"), (50, "7")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            got = {(r.src_port, r.session): ((r.state, r.application, r.sni), r.packets, r.dropped) for r in sessions(df, RuleSet.of(apps=("YouTube",), domains=("bad",)), 9.0, span).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for key, packets in want.items():
            actions, end = plain(packets, {"YouTube"}, ("bad",))
            assert got[key] == (end, len(packets), actions.count("DROP"))
        assert set(got) == set(want) and len(want) > 50


def test_stored_summaries_are_those_of_the_whole(spark, tmp_path):
    """Ranges of packets summed up apart, stored, and put together in any order."""
    rng = random.Random(12)
    rows = [("10.0.0.1", "10.0.0.2", i % 7, 443, 6, i, i, 0, 60 + i % 9, True, rng.choice((2, 18, 16, 24, 17, 4)), *(("TLS", "HTTPS", "bad.com") if rng.random() < 0.1 else (None, None, None))) for i in range(900)]
    rules, df = RuleSet.of(domains=("bad",)), spark.createDataFrame(rows, COLUMNS)
    for low, high in ((600, 900), (0, 250), (250, 600)):
        summaries(df.where(f"packet_no >= {low} AND packet_no < {high}"), rules).write.mode("append").parquet(str(tmp_path / "sums"))
    together = tuples(spark.read.parquet(str(tmp_path / "sums")), rules)
    assert sorted(together.collect(), key=str) == sorted(tuples(summaries(df, rules), rules).select(together.columns).collect(), key=str)


def test_capacity_and_idle_flows(spark):
    rows = [(0, 10.0, 1, "NEW"), (0, 20.0, 2, "CLOSED"), (0, 30.0, 3, "NEW"), (3, 5.0, 4, "NEW")]
    flows = spark.createDataFrame(rows, "worker int, last_ts double, first_packet_no long, state string")
    assert {r.first_packet_no for r in newest(flows, 2).collect()} == {2, 3, 4}
    assert {r.first_packet_no for r in alive(flows, 35.0, 20.0).collect()} == {3}


def test_map_rows(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2},)], "applications map<string, long>")
    assert sorted(map(tuple, rows_of_map(df).collect())) == [("a", 1), ("b", 2)]
