"""The 77-packet sample: sixteen TLS handshakes, two HTTP requests, four DNS queries, five packets of a blocked source."""

import io
import random
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netquarry.operators import report
from netquarry.operators.rules import RuleSet
from netquarry.plans.analysis import Analysis, analyze, analyze_sample
from netquarry.sources import exports, pcap
from netquarry.synth import SAMPLE_CLIENT, client_hello, ipv4, sample_packets, tcp

ME = SAMPLE_CLIENT


RULES = RuleSet.of(ips=("192.168.1.50",), apps=("YouTube", "TikTok"), domains=("facebook",))


def raw(spark, frames, first=1_700_000_000):
    rows = [(i, first + i, 0, len(f), len(f), bytearray(f)) for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, "packet_no long, ts_sec int, ts_usec int, incl_len int, orig_len int, data binary")


@pytest.fixture(scope="module")
def packets(spark):
    return sample_packets(spark).cache()


def test_goldens_without_rules(packets):
    s = Analysis(packets).summary.first()
    assert (s.total_packets, s.total_bytes, s.tcp_packets, s.udp_packets, s.forwarded_packets, s.dropped_packets) == (77, 5738, 73, 4, 77, 0)
    assert (s.largest_packet_size, s.capture_duration, s.bandwidth_bits_per_sec, s.active_connections) == (142, 76.0, 604.0, 43)


def test_goldens_with_rules(packets):
    a = Analysis(packets, RULES)
    s = a.summary.first()
    assert (s.total_packets, s.forwarded_packets, s.dropped_packets, s.active_connections) == (77, 69, 8, 35)
    assert {r.state: r["count"] for r in a.flows.groupBy("state").count().collect()} == {"CLASSIFIED": 19, "NEW": 16, "BLOCKED": 8}
    assert a.acted.where("report_action = 'DROP'").count() == 17
    assert a.details.where("payload_summary LIKE 'SNI: %'").count() == 16
    assert [r.flows for r in a.worker_load.orderBy("worker").collect()] == [24, 0, 0, 19]


def test_graph_and_applications(packets):
    a = Analysis(packets)
    nodes = {r.id: r for r in report.graph_nodes(a.tuples, a.flows).collect()}
    kinds = [n.type for n in nodes.values()]
    assert (kinds.count("client"), kinds.count("server"), kinds.count("domain")) == (2, 20, 18)
    assert (nodes[ME].packets, nodes[ME].bytes) == (72, 5468)
    edges = report.graph_edges(a.tuples, a.flows).collect()
    assert (sum(e.protocol == "TLS/SNI" for e in edges), len(edges)) == (18, 54)
    apps = {r.application: r.flows for r in report.app_distribution(a.flows).collect()}
    assert apps["Unknown"] == 21 and apps["DNS"] == 4 and apps["Twitter/X"] == 3 and apps["HTTPS"] == 2 and "Netflix" not in apps
    assert a.timeline.count() == 77


def test_capture_round_trip(spark, packets, tmp_path):
    a = Analysis(packets, RULES)
    for order in ("little", "big"):
        a.write_capture(str(tmp_path / order), byteorder=order)
        b = analyze(spark, str(tmp_path / order / "*.pcap"))
        assert b.raw.count() == 69
        assert b.summary.first().total_packets == 69
        assert spark.read.format("pcap").load(str(tmp_path / order)).count() == 69


def test_capture_is_cut_by_size_and_keeps_its_order(spark, packets, tmp_path):
    a = Analysis(packets, RULES)
    a.write_capture(str(tmp_path / "cut"), file_bytes=1000)
    files = sorted((tmp_path / "cut").glob("*.pcap"))
    assert len(files) > 3 and max(f.stat().st_size for f in files) <= 1000
    back = [r for f in files for r in pcap.records(io.BytesIO(f.read_bytes()[24:]), pcap.file_header(f.read_bytes()))]
    assert [bytes(r[4]) for r in back] == [bytes(r.data) for r in a.forwarded().orderBy("packet_no").collect()]
    Analysis(packets.limit(0), RULES).write_capture(str(tmp_path / "none"))
    assert analyze(spark, str(tmp_path / "none" / "*.pcap")).raw.count() == 0


def test_malformed_captures():
    header = pcap.file_header(bytes.fromhex("d4c3b2a1020004000000000000000000ffff000001000000"))
    assert header == pcap.Header("<", (2, 4), 65535, 1)
    for bad in ("4d3cb2a1", "0a0d0d0a"):
        with pytest.raises(ValueError):
            pcap.file_header(bytes.fromhex(bad) + bytes(20))
    with pytest.raises(ValueError):
        pcap.file_header(bytes(3))
    good = bytes.fromhex("01000000020000000300000003000000") + b"abc"
    assert len(list(pcap.records(io.BytesIO(good + good[:-1]), header))) == 1
    assert len(list(pcap.records(io.BytesIO(good + bytes.fromhex("0100000002000000ffff010000000000")), header))) == 1


def test_malformed_frames(spark):
    whole = ipv4(ME, "1.2.3.4", 6, tcp(1, 443, 16))
    ihl, offset = bytearray(whole), bytearray(whole)
    ihl[14], offset[46] = 0x44, 0x40
    cases = {
        "short": (whole[:13], (False, False)), "arp": (whole[:12] + b"\x08\x06" + bytes(28), (True, False)), "ipv6": (whole[:12] + b"\x86\xdd" + bytes(40), (True, False)), "cut": (whole[:30], (False, False)), "ihl": (bytes(ihl), (False, False)),
        "offset": (bytes(offset), (False, True)), "udp": (ipv4(ME, "1.2.3.4", 17, b"1234"), (False, True)), "icmp": (ipv4(ME, "1.2.3.4", 1, bytes(8)), (True, True)), "padded": (whole + bytes(6), (True, True)),
    }
    a = Analysis(raw(spark, [f for f, _ in cases.values()]))
    assert [(r.parse_ok, r.has_ip) for r in a.packets.orderBy("packet_no").collect()] == [v for _, v in cases.values()]
    flow = a.flows.first()
    assert (flow.application, flow.bytes) == ("HTTPS", 60)  # padding is payload
    assert a.acted.count() == 2
    assert Analysis(raw(spark, [whole]).limit(0)).summary.first().total_packets == 0


def test_exports(spark, packets, tmp_path):
    a = Analysis(packets, RULES)
    lines = [r.line for r in exports.csv_lines(a.details).orderBy("id").take(1)]
    assert lines == ["0,2023-11-14 22:13:20.000,192.168.1.100,142.250.185.206,TCP,50000,443,54,FORWARD"]
    assert len(exports.CSV_HEADER.split(",")) == 9
    page = exports.html_page(a.summary, a.flow_details)
    assert "<li>Total Packets: 77</li>" in page and page.count("<tr>") == 31
    assert "forwarded" in exports.console(a)
    exports.write_json(a, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "flows")).count() == 43


def test_command_line(spark, packets, tmp_path, capsys):
    from netquarry.cli import main

    Analysis(packets).write_capture(str(tmp_path / "in"))
    assert main([str(tmp_path / "in" / "*.pcap"), str(tmp_path / "out"), "--block-app", "tiktok", "--block-ip", "192.168.1.50"]) == 0
    assert spark.read.format("pcap").load(str(tmp_path / "out")).count() == 77 - 5 - 1
    assert "packets" in capsys.readouterr().out


def test_skewed_flow_keeps_its_order(spark):
    """One flow with most packets, over many partitions."""
    frames = [ipv4(ME, "1.2.3.4", 6, tcp(5, 443, 16)) for _ in range(500)] + [ipv4(ME, "1.2.3.4", 6, tcp(5, 443, 24, client_hello("www.tiktok.com")))] + [ipv4(ME, "1.2.3.4", 6, tcp(5, 443, 16)) for _ in range(500)]
    a = Analysis(raw(spark, frames).repartition(8), RULES)
    assert a.run.where("action = 'DROP'").agg(F.min("packet_no"), F.count("*")).first() == (500, 501)


def test_captures_in_many_files_are_one(spark, packets, tmp_path):
    """The sample cut into three captures: the engine's verdicts and the bytes written are those of the one capture."""
    rows = packets.orderBy("packet_no").collect()
    for name, part in (("a", rows[:30]), ("b", rows[30:71]), ("c", rows[71:])):
        Analysis(spark.createDataFrame(part, packets.schema)).write_capture(str(tmp_path / name))
    a = analyze(spark, str(tmp_path / "[abc]" / "*.pcap"), RULES)
    back = a.raw.orderBy("packet_no").collect()
    assert [(r.packet_no, bytes(r.data)) for r in back] == [(i, bytes(r.data)) for i, r in enumerate(rows)]
    s = a.summary.first()
    assert (s.total_packets, s.forwarded_packets, s.dropped_packets, s.capture_duration) == (77, 69, 8, 76.0)
    one = Analysis(packets, RULES)
    assert a.details.orderBy("id").collect() == one.details.orderBy("id").collect()
    assert [r.timestamp for r in a.timeline.collect()] == list(range(77))
    a.write_capture(str(tmp_path / "out"))
    written = spark.read.format("pcap").load(str(tmp_path / "out")).orderBy("packet_no").collect()
    assert [bytes(r.data) for r in written] == [bytes(r.data) for r in one.forwarded().orderBy("packet_no").collect()]


def capture_bytes(order, records, snaplen=65_535):
    return struct.pack(f"{order}IHHiIII", pcap.MAGIC, 2, 4, 0, 0, snaplen, 1) + b"".join(struct.pack(f"{order}IIII", i, 7, len(r), len(r)) + r for i, r in enumerate(records))


@pytest.mark.parametrize(("order", "sizes"), [("<", (150, 1 << 20)), (">", (777,))])
def test_files_are_read_in_pieces(spark, tmp_path, order, sizes):
    """Payloads that look like records, zeros, records over several pieces, cut ends and empty captures."""
    rng = random.Random(3)
    fake = struct.pack(f"{order}IIII", 1, 2, 40, 40)
    kinds = (lambda: rng.randbytes(rng.randint(0, 90)), lambda: fake * rng.randint(1, 9), lambda: bytes(rng.randint(0, 200)), lambda: fake + bytes(rng.randint(0, 60)), lambda: rng.randbytes(1500))
    files = [[rng.choice(kinds)() for _ in range(rng.randint(1, 80))] for _ in range(4)] + [[]]
    for i, f in enumerate(files):
        (tmp_path / f"{i}.pcap").write_bytes(capture_bytes(order, f) + (fake[:-3] if i == 1 else fake if i == 2 else b""))
    want = [(i, r) for i, r in enumerate(r for f in files for r in f)]
    for size in sizes:
        got = pcap.read_pcap(spark, str(tmp_path / "*.pcap"), piece_bytes=size).orderBy("packet_no").collect()
        assert [(r.packet_no, bytes(r.data)) for r in got] == want


def test_a_file_of_a_thousand_pieces(spark, tmp_path):
    """One file in 1,000 pieces, many of them zeros, in which any place could begin a record; what passes is read by bitmaps."""
    frame = ipv4(ME, "1.2.3.4", 6, tcp(5, 443, 16))
    records = [frame if i % 3 else bytes(100) for i in range(1100)]
    content = capture_bytes("<", records)
    (tmp_path / "one.pcap").write_bytes(content)
    a = analyze(spark, str(tmp_path / "one.pcap"), RULES, piece_bytes=-(-len(content) // 1000))
    assert a.pieces.agg(F.sum("n")).first()[0] == 1100 and a.pieces.count() > 900
    assert [bytes(r.data) for r in a.raw.orderBy("packet_no").collect()] == records
    plan = a.forwarded()._jdf.queryExecution().executedPlan().toString()
    assert all("data#" not in line for line in plan.splitlines() if "Exchange" in line)
    assert [r.packet_no for r in a.forwarded().orderBy("packet_no").collect()] == [i for i in range(1100) if i % 3]


def test_ranges_open_few_pieces(spark, tmp_path):
    """Ranges of numbers and of time read the pieces that hold them; conditions on numbers leave out whole files."""
    frame = ipv4(ME, "1.2.3.4", 6, tcp(5, 443, 16))
    for i in range(4):
        (tmp_path / f"{i}.pcap").write_bytes(capture_bytes("<>"[i % 2], [frame] * 100))
    pieces = pcap.capture_pieces(spark, str(tmp_path / "*.pcap"), piece_bytes=2000)
    assert pieces.count() == 4 * 4 and pieces.where("number < 105 AND number + n > 101").count() == 1
    assert [r.packet_no for r in pcap.packets_between(pieces, 101, 105).orderBy("packet_no").collect()] == [101, 102, 103, 104]
    timed = pcap.with_times(pieces)
    assert sorted(r.packet_no for r in pcap.packets_during(timed, 40, 42).collect()) == [40, 41, 140, 141, 240, 241, 340, 341]
    assert {(r.least_sec, r.most_sec) for r in timed.where("number >= 300").collect()} == {(r.number - 300, r.number + r.n - 301) for r in pieces.where("number >= 300").collect()}
    pcap.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for pushed, files in (("false", 4), ("true", 2)):
            load = lambda: spark.read.format("pcap").option("pushdown", pushed).load(str(tmp_path))  # noqa: B023, E731
            some = load().where(f"packet_no >= {2 * pcap.FILE_STEP + 98} AND packet_no < {3 * pcap.FILE_STEP + 2}")
            assert some.count() == 4 and some.rdd.getNumPartitions() == files
            assert load().where(f"packet_no = {pcap.FILE_STEP}").count() == 1 and load().count() == 400
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_export_by_format_and_hook(spark, packets, tmp_path):
    a = Analysis(packets, RULES).persist()
    for fmt in ("json", "csv", "html"):
        exports.export(a, fmt, str(tmp_path / fmt))
    assert spark.read.text(str(tmp_path / "csv")).count() == 77
    assert "Active Flows: 43" in "".join(r.value for r in spark.read.text(str(tmp_path / "html")).collect())
    with pytest.raises(ValueError):
        exports.export(a, "xml", str(tmp_path / "xml"))
    seen = {}
    a.each_batch(lambda df, action: seen.update({action: df.count()}))
    assert seen == {"FORWARD": 69, "DROP": 8}
    text = exports.console(a)
    lines = text.split("\n")
    listed = {"packets": "77", "bytes": "5738", "TCP": "73", "UDP": "4", "forwarded": "69", "dropped": "8 (10.39%)", "blocked_ips": "1", "blocked_apps": "2", "blocked_domains": "1", "blocked_ports": "0", "flows": "43", "classified": "22 (51.2%)", "unidentified": "21 (48.8%)", "active connections": "43", "connections seen": "43", "blocked": "8"}
    assert [f"{k:<24}{v}" for k, v in listed.items() if f"{k:<24}{v}" not in lines] == []
    assert {"Engine", "Applications", "Connections", f"{'Unknown':<20}{21:>8} {48.8:5.1f}% {'#' * 9:<20}", f"{'www.youtube.com':<40}{1:>8}"} <= set(lines)
    assert [x for x in lines if x.startswith("worker 1 ")] == [f"{'worker 1':<24}0 packets, 0 forwarded, 0 dropped, 0 flows"]
    a.unpersist()


def test_sample_of_the_package(spark):
    s = analyze_sample(spark, RULES).summary
    assert (s.first().forwarded_packets, s.first().dropped_packets) == (69, 8)
    assert tuple(report.shown(s).first()) == (89.6, 10.39, 76.0)


def test_chains_of_a_piece_are_held_block_by_block(tmp_path):
    """what is held of a piece doesn't grow with it, and the chains are those over the whole piece."""
    frame, most, places = ipv4(ME, "1.2.3.4", 6, tcp(5, 443, 16)), {}, np.arange(100_000, 100_000 + pcap.MOST_BYTES + pcap.RECORD_HEADER)
    for size in (2, 16):
        content = capture_bytes("<", [frame, bytes(3000), frame * 9] * (size * 280))
        path, header = str(tmp_path / f"{size}.pcap"), pcap.file_header(content)
        (tmp_path / f"{size}.pcap").write_bytes(content)
        piece = pa.record_batch({"source_file": [path], "size": [len(content)], "begin": [100_000], "end": [len(content)]})
        tracemalloc.start()
        found = next(pcap._candidates(iter([piece])))
        most[size] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        whole = pcap.chains(np.frombuffer(content[100_000:], np.uint8), 100_000, len(content), len(content), header, places) if size == 2 else {}
        got = dict(zip(found["entry"].to_pylist(), zip(found["leaves"].to_pylist(), found["n"].to_pylist(), strict=True), strict=True))
        assert got == whole or size > 2
    assert most[16] < 1.5 * most[2]


def test_what_passes_is_read_in_as_many_tasks_as_it_was_in(spark, tmp_path):
    """bitmaps are small, so that Spark would take those of a whole capture into one task."""
    frame = ipv4(ME, "1.2.3.4", 6, tcp(5, 443, 16))
    (tmp_path / "one.pcap").write_bytes(capture_bytes("<", [frame] * 1000))
    a = analyze(spark, str(tmp_path / "one.pcap"), RULES, piece_bytes=2000)
    passing = a.forwarded()
    assert len({r.task for r in passing.select(F.spark_partition_id().alias("task")).collect()}) == spark.sparkContext.defaultParallelism
    a.write_capture(str(tmp_path / "out"))
    back = pcap.read_pcap(spark, str(tmp_path / "out" / "*.pcap")).orderBy("packet_no").collect()
    assert [(r.packet_no, r.ts_sec, bytes(r.data)) for r in back] == [(i, i, frame) for i in range(1000)]


def test_records_of_a_piece_are_read_a_window_at_a_time(tmp_path):
    """what is held of a piece doesn't grow with it; all its records are read, those of a bitmap across windows too."""
    frame, most = ipv4(ME, "1.2.3.4", 6, tcp(5, 443, 16)), {}
    for megabytes in (12, 48):
        n = megabytes * 14_000
        content = capture_bytes("<", [frame]) + capture_bytes("<", [frame])[pcap.FILE_HEADER :] * (n - 1)
        (tmp_path / "one.pcap").write_bytes(content)
        piece = {"source_file": str(tmp_path / "one.pcap"), "entry": pcap.FILE_HEADER, "leaves": len(content), "n": n, "number": 5}
        tracemalloc.start()
        assert [sum(b.num_rows for b in pcap._read_pieces(iter([pa.RecordBatch.from_pylist([piece])])))] == [n]
        most[megabytes] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        odd = [{"bucket": b + 1, "bits": b"\xaa" * (pcap.BUCKET // 8)} for b in range((n + 5) // pcap.BUCKET + 1)]
        passing = pa.RecordBatch.from_pylist([piece | {"passing": odd}])
        assert [x for b in pcap._read_pieces(iter([passing])) for x in b["packet_no"].to_pylist()] == list(range(5, n + 5, 2))
    assert most[48] < 1.5 * most[12]
