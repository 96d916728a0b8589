import random

import pandas as pd
from pyspark.sql import functions as F

from netquarry.functions.codec import FIVE_TUPLE
from netquarry.operators.decode import ENGINE_PACKETS, decode, report_packets
from netquarry.operators.flows import sessions
from netquarry.operators.inspection import inspected
from netquarry.operators.rules import RuleSet
from netquarry.queries import queries
from netquarry.streaming.captures import FlowState, flow_updates, traffic
from netquarry.synth import client_hello, ipv4, tcp
from tests.test_flows import COLUMNS


def source(spark, tmp_path):
    frames = [ipv4("10.0.0.1", "1.2.3.4", 6, tcp(5, 443, 2)), ipv4("10.0.0.1", "1.2.3.4", 6, tcp(5, 443, 24, client_hello("zoom.us"))), ipv4("10.0.0.1", "1.2.3.4", 6, tcp(5, 443, 17))]
    df = spark.createDataFrame([(i, 100 + i // 2, 0, bytearray(f)) for i, f in enumerate(frames)], "packet_no long, ts_sec int, ts_usec int, data binary")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def finished(df, name, mode):
    """Runs until all files are taken in and what their times set free is given."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(240)


def test_flow_state(spark, tmp_path):
    packets = source(spark, tmp_path)
    spark.createDataFrame([(-1, 9000, 0, bytearray(b""))], packets.schema).write.mode("append").parquet(str(tmp_path / "in"))
    finished(flow_updates(inspected(packets), where=F.expr(ENGINE_PACKETS)), "flows_out", "update")
    row = spark.table("flows_out").orderBy(F.desc("packets")).first()
    assert (row.packets, row.application, row.sni, row.state, row.session, row.first_ts, row.last_ts) == (3, "Zoom", "zoom.us", "CLOSED", 0, 100.0, 101.0)


def test_traffic(spark, tmp_path):
    finished(traffic(report_packets(decode(source(spark, tmp_path)))), "traffic_out", "complete")
    assert sorted(r.packets for r in spark.table("traffic_out").select(F.col("packets")).collect()) == [1, 2]


def test_stream_and_batch_agree(spark, tmp_path):
    """Random flows under rules, silent at times, in micro-batches that are out of order: a session's last row is the batch's."""
    rng = random.Random(8)
    findings = [None, None, None, ("YouTube", "youtube.com"), ("HTTPS", ""), ("HTTPS", "bad.com"), ("Zoom", "zoom.us")]
    rows = []
    for k in range(12):
        for i in range(40):
            if rng.random() < 0.55:
                flags, found = rng.choice((2, 18, 16, 24, 17, 4, 16)), rng.choice(findings)
                rows.append(("10.0.0.7" if i % 9 == 0 else "10.0.0.1", "10.0.0.2", i, 443, 6, k * 100 + i, 1000 + k, i, 60, True, flags, "TLS" if found else None, found and found[0], found and found[1]))
    rules = RuleSet.of(ips=("10.0.0.7",), apps=("YouTube",), domains=("bad",))
    df = spark.createDataFrame(rows, COLUMNS)
    parts: dict[int, list] = {}
    for r in rows:
        parts.setdefault((r[6] - 1000 + rng.randint(0, 3)) // 4, []).append(r)
    parts[99] = [("0.0.0.0", "0.0.0.0", -1, 0, 6, -1, 9999, 0, 0, True, 0, None, None, None)]
    for part in sorted(parts):
        rng.shuffle(parts[part])
        spark.createDataFrame(parts[part], COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    finished(flow_updates(stream, rules, 2.5, "5 seconds", F.col("src_port") >= 0), "verdicts_out", "update")
    last = ("state", "application", "sni", "packets", "bytes", "dropped", "first_ts", "last_ts")
    ends = {}
    for r in spark.table("verdicts_out").orderBy("packets").collect():
        ends[r.src_port, r.session] = tuple(r[c] for c in last)
    want = {(r.src_port, r.session): tuple(r[c] for c in last) for r in sessions(df, rules, 2.5).collect()}
    assert {k: (v, want.get(k)) for k, v in ends.items() if want.get(k) != v} == {} and set(ends) == set(want) and len(want) > 60


class Handle:
    """The state of one bucket in memory, with the calls that were made."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, []

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def get(self):
                handle.calls += 1
                return handle.values.get(name)

            def exists(self):
                handle.calls += 1
                return name in handle.values

            def update(self, value):
                handle.calls += 1
                handle.values[name] = value

            def clear(self):
                handle.calls += 1
                handle.values.pop(name, None)

        return Value()

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.calls += 1
        self.timers.append(timer)


class Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_state_calls_do_not_grow_with_flows():
    """Many flows of a bucket in a micro-batch cost as many calls of the state store as one flow does; they end as they should and are forgotten."""
    handle, state = Handle(), FlowState(100.0, False)
    state.init(handle)
    n = 2_000
    packets = pd.DataFrame([(f"10.0.{i // 256}.{i % 256}", "1.1.1.1", 5, 443, 6, 3 * i + k, 10.0 + 5 * k, 60, flags, False, False, app, app) for i in range(n) for k, (flags, app) in enumerate(((2, None), (24, "Zoom"), (16, None)))], columns=[*FIVE_TUPLE, "packet_no", "ts", "frame_length", "flags", "found_hit", "address_hit", "found_app", "found_sni"])
    assert list(state.handleInputRows((0,), iter([packets[packets.ts < 20]]), Times(12_000))) != [] and handle.calls <= 6
    assert handle.timers == [15_001]
    rows = pd.concat(state.handleInputRows((0,), iter([packets[packets.ts == 20]]), Times(25_000)))
    assert handle.calls <= 12 and len(rows) == n and set(rows.packets) == {3} and set(rows.application) == {"Zoom"} and set(rows.state) == {"CLASSIFIED"} and set(rows.first_ts) == {10.0}
    assert list(state.handleExpiredTimer((0,), Times(200_000), None)) == [] and handle.values == {} and handle.timers == []


def test_no_packet_of_a_long_time_is_late(spark, tmp_path):
    """A table over two years, whose spans are much longer than what the stream waits for, loses no packet."""
    events = spark.range(4_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 16_000).cast("timestamp_ntz").alias("ts"), (F.col("id") % 50).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert queries()["streamed_traffic"](spark, str(tmp_path)).agg(F.sum("packets")).first()[0] == 4_000
