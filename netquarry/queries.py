"""Queries over the driver's tables: events become frames, which are decoded and analysed; pages give host names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions import codec
from netquarry.functions.classify import app_named, app_of
from netquarry.operators import flows as flow_ops
from netquarry.operators import inspection, report, views
from netquarry.operators.decode import ENGINE_PACKETS, engine_packets, headers, report_packets
from netquarry.operators.rule_index import rule_hits
from netquarry.operators.rules import RuleSet
from netquarry.plans.analysis import Analysis, analyze
from netquarry.sources import exports, pcap
from netquarry.sources.files import scratch
from netquarry.streaming.captures import FLOW_SCHEMA, flow_updates, traffic
from netquarry.synth import HOSTS, frames

#: Rules of the queries; of those by port only where a query says so.
IPS, APPS, DOMAINS = ("10.0.0.7", "10.0.0.42"), ("YouTube", "tiktok"), ("facebook", "*.spotify.com")
#: The time at which flows count as idle, and the flows that each worker keeps, in the two queries on that.
NOW, CAPACITY = 1_706_500_000.0, 50
#: Seconds of silence after which a flow begins anew, in the queries on that.
IDLE = 86_400
HOST = r"^[a-z]+://([^/:?#]+)"


def rules() -> RuleSet:
    return RuleSet.of(ips=IPS, apps=APPS, domains=DOMAINS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each event. Events come in few row groups and frames are made in Python, so they are dealt to all cores first."""
    return frames(events(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism))


def write_packets(spark: SparkSession, sf_dir: str, path: str, **options) -> None:
    """The packets as captures. Events are put in order before frames are made from them, so no frame is shuffled."""
    pcap.register(spark)
    ordered = events(spark, sf_dir).repartitionByRange(spark.sparkContext.defaultParallelism, "event_id").sortWithinPartitions("event_id")
    frames(ordered).write.format("pcap").options(**options).mode("overwrite").save(path)


def analysis(spark: SparkSession, sf_dir: str, with_rules: bool = True) -> Analysis:
    return Analysis(packets(spark, sf_dir), rules() if with_rules else RuleSet())


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", HOST, 1).alias("host"))


def mixed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page hosts and, in turn, the known hosts, some in capitals."""
    known = F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    return hosts(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("host")).when(F.col("page_id") % 3 == 1, known).otherwise(F.upper(known)).alias("host"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def timeline(spark, sf_dir):
    return analysis(spark, sf_dir).timeline


@query
def engine_totals(spark, sf_dir):
    return report.engine_totals(analysis(spark, sf_dir).tuples)


@query
def summary_stats(spark, sf_dir):
    return analysis(spark, sf_dir).summary


@query
def decode_ethernet(spark, sf_dir):
    return analysis(spark, sf_dir).packets.select("packet_no", "src_mac", "dst_mac", "ether_type")


@query
def decode_ipv4(spark, sf_dir):
    return analysis(spark, sf_dir).packets.where("has_ip").select("packet_no", "ip_version", "ttl", "protocol", "src_ip", "dst_ip")


@query
def decode_tcp(spark, sf_dir):
    return analysis(spark, sf_dir).packets.where("has_tcp").select("packet_no", "src_port", "dst_port", "seq_number", "ack_number", "tcp_flags")


@query
def decode_udp(spark, sf_dir):
    return analysis(spark, sf_dir).packets.where("has_udp").select("packet_no", "src_port", "dst_port", "payload_length")


@query
def payload_stats(spark, sf_dir):
    packets = report_packets(analysis(spark, sf_dir).packets)
    return packets.groupBy("protocol", "dst_port").agg(F.count(F.lit(1)).alias("packets"), F.count_if(F.col("payload_length") > 0).alias("with_payload"), F.sum("payload_length").cast("long").alias("payload_bytes"), F.max("payload_offset").alias("last_offset"))


@query
def parse_outcomes(spark, sf_dir):
    return analysis(spark, sf_dir).packets.groupBy("parse_ok", "has_ip", "has_tcp", "has_udp").agg(F.count(F.lit(1)).alias("packets"))


def report_totals(spark, sf_dir):
    return report_packets(analysis(spark, sf_dir).packets).groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("frame_length").cast("long").alias("bytes"))


@query
def protocol_names(spark, sf_dir):
    return report_packets(analysis(spark, sf_dir).packets).groupBy(codec.protocol_name(F.col("protocol")).alias("protocol")).agg(F.count(F.lit(1)).alias("packets"))


@query
def tcp_flag_names(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", codec.flag_names(F.col("event_id") % 256).alias("flags"))


@query
def ip_codec(spark, sf_dir):
    ip = F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("7"), (F.col("event_id") * 3 % 256).cast("string"))
    return events(spark, sf_dir).select("event_id", codec.ip_number(ip).alias("number"), codec.ip_text(codec.ip_number(ip)).alias("ip"), codec.swap16((F.col("event_id") % 65536).cast("int")).cast("long").alias("swapped16"), codec.swap32(F.col("event_id") * 65537).alias("swapped32"))


@query
def flow_labels(spark, sf_dir):
    flows = analysis(spark, sf_dir).flows
    return flows.select(codec.flow_label(*(F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol"))).alias("label"))


@query
def tuple_hash(spark, sf_dir):
    return flow_ops.with_hash(engine_packets(analysis(spark, sf_dir).inspected)).select("packet_no", "hash")


@query
def worker_assignment(spark, sf_dir):
    flows = flow_ops.with_hash(engine_packets(analysis(spark, sf_dir).inspected).select(*codec.FIVE_TUPLE).distinct())
    return flows.select("src_ip", "src_port", "dst_ip", "dst_port", codec.worker_of(F.col("hash")).alias("worker"), codec.worker_of(F.col("hash"), 3, 4).alias("worker_of_12"))


@query
def tls_client_hello(spark, sf_dir):
    return report_packets(analysis(spark, sf_dir).packets).where(inspection.is_client_hello(F.col("payload"))).groupBy("dst_port").agg(F.count(F.lit(1)).alias("hellos"))


@query
def tls_sni(spark, sf_dir):
    packets = report_packets(analysis(spark, sf_dir).packets).withColumn("sni", inspection.tls_server_name(F.col("payload")))
    return packets.where(F.col("sni").isNotNull()).select("packet_no", "sni")


@query
def http_methods(spark, sf_dir):
    return report_packets(analysis(spark, sf_dir).packets).where(inspection.is_http_request(F.col("payload"))).select("packet_no", F.decode(F.substring("payload", 1, 4), "ISO-8859-1").alias("method"))


@query
def http_host(spark, sf_dir):
    return report_packets(analysis(spark, sf_dir).packets).select("packet_no", inspection.http_host(F.col("payload")).alias("host")).where(F.col("host").isNotNull())


@query
def dns_queries(spark, sf_dir):
    return report_packets(analysis(spark, sf_dir).packets).where("dst_port = 53").select("packet_no", inspection.dns_name(F.col("payload")).alias("name"))


@query
def quic_sni(spark, sf_dir):
    wrapped = F.concat(F.unhex(F.lit("c0000000")), F.lit(b"\x00"), F.col("payload"), F.lit(b"\x00" * 60))
    return report_packets(analysis(spark, sf_dir).packets).where("tcp_flags = 24 AND dst_port = 443").select("packet_no", inspection.quic_server_name(wrapped).alias("sni")).where("sni IS NOT NULL")


@query
def app_classify(spark, sf_dir):
    return mixed_hosts(spark, sf_dir).select("page_id", "host", app_of(F.col("host")).alias("app"))


@query
def app_names(spark, sf_dir):
    from netquarry.functions.classify import APP_NAMES

    name = F.element_at(F.array(*(F.lit(x) for x in (*APP_NAMES, "no such app"))), (F.col("page_id") % (len(APP_NAMES) + 1) + 1).cast("int"))
    return hosts(spark, sf_dir).select("page_id", app_named(F.when(F.col("page_id") % 2 == 0, F.upper(name)).otherwise(name)).alias("app"))


@query
def domain_rules(spark, sf_dir):
    some = RuleSet.of(domains=("Facebook", "*.example.com", "a*b.com", "*.TIKTOK.com", "zoom"))
    return mixed_hosts(spark, sf_dir).select("page_id", "host", some.domain_hit(F.col("host")).alias("blocked"))


@query
def block_reasons(spark, sf_dir):
    some = RuleSet.of(IPS, APPS, DOMAINS, ports=(80,))
    run = analysis(spark, sf_dir, with_rules=False).run
    reason = some.reason(F.col("src_ip"), F.col("dst_port"), F.col("app"), F.col("sni"))
    return run.select("packet_no", reason.alias("reason")).where("reason IS NOT NULL").select("packet_no", "reason.type", "reason.detail")


def drawn_rules(spark, sf_dir) -> DataFrame:
    """Rules as a table: the clients with most errors, the hosts of most pages, the applications, and the ports that events go to."""
    client = F.concat(F.lit("10.0."), (F.floor(F.col("user_id") / 256) % 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    worst = events(spark, sf_dir).where("event_type = 'error'").groupBy(client.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(20)
    most = hosts(spark, sf_dir).groupBy(F.col("host").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(10)
    ports = events(spark, sf_dir).select(F.when(F.col("event_type") == "signup", "53").when(F.col("event_type") == "click", "80").otherwise("443").alias("value")).distinct()
    apps = rules().table(spark).where("kind = 'APP'")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "value")
    return named(worst, "IP").unionByName(named(most, "DOMAIN")).unionByName(named(ports, "PORT")).unionByName(apps)


@query
def rule_stats(spark, sf_dir):
    some = RuleSet.from_table(drawn_rules(spark, sf_dir))
    some.unblock_port(53)
    return spark.createDataFrame([tuple(some.stats().values())], ", ".join(f"{k} long" for k in some.stats()))


@query
def rules_file_parse(spark, sf_dir):
    """Rules written to a file and read back."""
    path = f"{scratch(spark, 'rules')}/rules.txt"
    RuleSet.from_table(drawn_rules(spark, sf_dir)).save(path)
    return RuleSet.load(path).table(spark)


@query
def rule_edits(spark, sf_dir):
    """Rules taken back and added one by one, written to a file and read back."""
    drawn = drawn_rules(spark, sf_dir)
    some = RuleSet.from_table(drawn)
    for ip in some.blocked_ips():
        if int(ip.rpartition(".")[2]) % 2 == 0:
            some.unblock_ip(ip)
    for host in some.blocked_domains():
        if len(host) % 2 == 0:
            some.unblock_domain(host)
    some.block_domain("*.example.org")
    some.unblock_app("youtube")
    some.block_app("NETFLIX")
    some.unblock_port(53)
    some.block_port(8080)
    path = f"{scratch(spark, 'rules')}/edited.txt"
    some.save(path)
    return RuleSet.load(path).table(spark)


@query
def ip_rule_semi_join(spark, sf_dir):
    """Packets of blocked sources, the rules being a table."""
    blocked = rules().table(spark).where("kind = 'IP'").select(F.col("value").alias("src_ip"))
    return report_packets(analysis(spark, sf_dir).packets).join(blocked, "src_ip", "left_semi").select("packet_no", "src_ip")


@query
def domain_rule_theta_join(spark, sf_dir):
    """Hosts with each rule that they meet, the rules being a table."""
    table = RuleSet.of(domains=("facebook", "zoom", "example", "*.spotify.com")).table(spark).where("kind = 'DOMAIN'")
    return _met(mixed_hosts(spark, sf_dir), table)


def _met(names: DataFrame, rules: DataFrame) -> DataFrame:
    hits = rule_hits(names.select(F.col("host").alias("name")), rules).withColumnRenamed("value", "rule")
    return names.withColumn("name", F.lower("host")).join(hits, "name").select("page_id", "rule")


def word_rules(spark, sf_dir) -> DataFrame:
    """Domain rules drawn from pages: each word of their HTML, and the parents of their hosts with a star. About 40 rules a page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    words = pages.select(F.explode(F.regexp_extract_all(F.lower("html"), F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("value"))
    parents = hosts(spark, sf_dir).where("page_id % 3 = 0").select(F.concat(F.lit("*"), F.regexp_replace("host", r"^[^.]*", "")).alias("value"))
    return words.unionByName(parents).distinct()


@query
def rule_index_join(spark, sf_dir):
    """Hosts with each of very many rules that they meet: how many, and the longest."""
    met = _met(mixed_hosts(spark, sf_dir).where("host <> ''"), word_rules(spark, sf_dir))
    return met.groupBy("page_id").agg(F.count(F.lit(1)).alias("rules"), F.min_by("rule", F.struct(-F.length("rule"), F.col("rule"))).alias("longest"))


@query
def payload_inspection(spark, sf_dir):
    return engine_packets(analysis(spark, sf_dir).inspected).where("found_by IS NOT NULL").select("packet_no", "found_by", "found_app", "found_sni")


@query
def engine_actions(spark, sf_dir):
    return analysis(spark, sf_dir).run.select("packet_no", "action", "seg", "app", "sni")


@query
def flow_states(spark, sf_dir):
    return analysis(spark, sf_dir).all_flows.groupBy("state").agg(F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"))


@query
def flow_table(spark, sf_dir):
    return analysis(spark, sf_dir).all_flows


@query
def flow_details(spark, sf_dir):
    return analysis(spark, sf_dir).flow_details


@query
def app_distribution(spark, sf_dir):
    return report.app_distribution(analysis(spark, sf_dir).flows)


@query
def domain_details(spark, sf_dir):
    return report.domains(analysis(spark, sf_dir).flows)


@query
def graph_nodes(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return report.graph_nodes(a.tuples, a.flows)


@query
def graph_edges(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return report.graph_edges(a.tuples, a.flows)


@query
def edge_endpoints(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return views.edge_endpoints(report.graph_edges(a.tuples, a.flows), report.graph_nodes(a.tuples, a.flows))


@query
def node_edges(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return views.edges_of(report.graph_edges(a.tuples, a.flows), "198.51.100.1")


@query
def report_actions(spark, sf_dir):
    return analysis(spark, sf_dir).acted.select("packet_no", "report_action", "flow_app", "flow_sni")


@query
def packet_details(spark, sf_dir):
    return analysis(spark, sf_dir).details.drop("layer_details")


@query
def layer_details(spark, sf_dir):
    return analysis(spark, sf_dir).details.select("id", F.concat_ws(" | ", "layer_details").alias("layers"))


@query
def worker_load(spark, sf_dir):
    return analysis(spark, sf_dir).worker_load


@query
def tracker_stats(spark, sf_dir):
    return report.tracker_stats(analysis(spark, sf_dir).all_flows)


@query
def inspection_counters(spark, sf_dir):
    return report.inspection_counters(analysis(spark, sf_dir).run)


@query
def protocol_breakdown(spark, sf_dir):
    return report.protocol_breakdown(analysis(spark, sf_dir).reported)


@query
def classification_report(spark, sf_dir):
    return report.classification(analysis(spark, sf_dir).flows)


@query
def top_domains(spark, sf_dir):
    return report.top_domains(analysis(spark, sf_dir).flows)


@query
def flow_capacity_topk(spark, sf_dir):
    return flow_ops.newest(analysis(spark, sf_dir).all_flows, CAPACITY).select(*codec.FIVE_TUPLE, "worker", "first_packet_no")


@query
def active_flows(spark, sf_dir):
    return flow_ops.alive(analysis(spark, sf_dir).all_flows, NOW, 86_400.0).select(*codec.FIVE_TUPLE, "state")


@query
def ui_packet_filter(spark, sf_dir):
    return views.packet_search(analysis(spark, sf_dir).details, "Google", "tcp", "FORWARD").select("id", "src_ip", "dst_ip", "payload_summary")


@query
def ui_flow_filter_sort(spark, sf_dir):
    return views.flow_search(analysis(spark, sf_dir).flow_details, "APPLE", "bytes").select("id", "bytes", "application")


@query
def ui_domain_top5(spark, sf_dir):
    return views.domain_search(report.domains(analysis(spark, sf_dir).flows), "COM").select("domain", "count")


@query
def export_csv(spark, sf_dir):
    return exports.csv_lines(analysis(spark, sf_dir).details)


@query
def export_json(spark, sf_dir):
    return exports.json_rows(report.app_distribution(analysis(spark, sf_dir).flows))


@query
def export_top30(spark, sf_dir):
    return exports.first_flows(analysis(spark, sf_dir).flow_details).select("client", "server", "packets", "application", "status")


@query
def simple_scan(spark, sf_dir):
    """Packets in all, and server names found on TCP to port 443."""
    packets = analysis(spark, sf_dir).packets
    name = inspection.tls_server_name(F.col("payload"), F.col("parse_ok") & F.col("has_tcp") & (F.col("dst_port") == 443))
    return packets.select(name.alias("sni")).agg(F.count(F.lit(1)).alias("packets"), F.count("sni").alias("names"))


def _digest() -> list:
    """A digest of all bytes and times that doesn't depend on the order."""
    return [F.count(F.lit(1)).alias("packets"), F.sum(F.length("data")).cast("long").alias("bytes"), F.bit_xor(F.xxhash64("ts_sec", "ts_usec", "data")).alias("digest")]


@query
def record_headers(spark, sf_dir):
    """The header of each packet's record in both byte orders, as hexadecimal digits: the lengths are both that of the bytes kept."""
    digits = lambda c: F.lpad(F.lower(F.hex(F.col(c).cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")
    turned = lambda c: F.concat(*(F.substring(digits(c), at, 2) for at in (7, 5, 3, 1)))
    header = lambda number: F.concat(*map(number, ("ts_sec", "ts_usec", "incl_len", "incl_len")))
    return packets(spark, sf_dir).select("packet_no", header(turned).alias("little"), header(digits).alias("big"))


@query
def pcap_roundtrip(spark, sf_dir):
    """Frames written as captures and read again by the data source; ``same`` says whether all bytes and times came back."""
    path, sent = scratch(spark, "captures"), packets(spark, sf_dir)
    write_packets(spark, sf_dir, path)
    back = spark.read.format("pcap").load(path).groupBy("incl_len").agg(*_digest(), F.sum("ts_sec").alias("seconds"), F.sum("ts_usec").alias("micros"))
    sent = sent.groupBy("incl_len").agg(*_digest()).select("incl_len", F.col("digest").alias("sent"))
    return back.join(sent, "incl_len", "left").select("incl_len", "packets", "bytes", "seconds", "micros", F.coalesce(F.col("digest") == F.col("sent"), F.lit(False)).alias("same"))


@query
def filtered_capture(spark, sf_dir):
    """What passes the rules of a capture, read back from the captures it was written to; ``same`` says whether they hold just the bytes that passed."""
    path = scratch(spark, "captures")
    write_packets(spark, sf_dir, f"{path}/in")
    a = analyze(spark, f"{path}/in/*.pcap", rules())
    a.write_capture(f"{path}/out", byteorder="big")
    back = pcap.read_pcap(spark, f"{path}/out/*.pcap").agg(*_digest(), F.sum("ts_sec").alias("seconds"))
    passed = analysis(spark, sf_dir).forwarded().agg(*_digest()).select(F.col("digest").alias("passed"))
    return back.crossJoin(passed).select("packets", "bytes", "seconds", (F.col("digest") == F.col("passed")).alias("same"))


@query
def capture_set(spark, sf_dir):
    """Many captures taken as one: written, read in pieces, analysed, filtered, and read back."""
    path = scratch(spark, "captures")
    write_packets(spark, sf_dir, f"{path}/in", filebytes=1 << 18)
    a = analyze(spark, f"{path}/in/*.pcap", rules(), piece_bytes=1 << 17)
    a.write_capture(f"{path}/out")
    totals = report.engine_totals(a.tuples).select("total_packets", "forwarded_packets", "dropped_packets")
    back = pcap.read_pcap(spark, f"{path}/out/*.pcap").agg(*_digest()).select(F.col("packets").alias("written_packets"), F.col("bytes").alias("written_bytes"), "digest")
    passed = analysis(spark, sf_dir).forwarded().agg(F.bit_xor(F.xxhash64("ts_sec", "ts_usec", "data")).alias("passed"))
    return totals.crossJoin(back).crossJoin(passed).select(*totals.columns, "written_packets", "written_bytes", (F.col("digest") == F.col("passed")).alias("same"))


@query
def first_packets(spark, sf_dir):
    """The first 100 packets of a set of captures, read from the pieces that hold them."""
    path = scratch(spark, "captures")
    write_packets(spark, sf_dir, path, filebytes=1 << 18)
    pieces = pcap.capture_pieces(spark, f"{path}/*.pcap", piece_bytes=1 << 17)
    return pcap.packets_between(pieces, 0, 100).select("packet_no", "ts_sec", "ts_usec", "incl_len")


#: Seconds by which streamed packets may be out of order.
LATE = 7 * 86_400


#: Spans of the streamed packets, and packets of a file of theirs.
SPANS, FILE_PACKETS = 6, 1_000_000


def stream(spark, sf_dir, path: str) -> DataFrame:
    """The packets as a stream of spans of time, out of order where spans meet but by less than LATE; at last a frame without an address, whose time passes all that still waits.

    Frames are made once, by all cores. Each micro-batch takes a span's files, of which there are as many as its packets ask for.
    """
    sent = packets(spark, sf_dir)
    made = f"{path}/made"
    sent.write.parquet(made)
    made = spark.read.schema(sent.schema).parquet(made)
    bounds = made.agg(F.min("ts_sec").alias("low"), F.max("ts_sec").alias("high")).first()
    low, span = (bounds.low, (bounds.high - bounds.low + 1) / SPANS) if bounds.low is not None else (0, 1)
    delay = F.pmod(F.xxhash64("packet_no"), F.lit(100)) / 100 * min(0.5, 0.9 * LATE / span)
    made = made.withColumn("part", F.floor((F.col("ts_sec") - low) / span + delay).cast("int"))
    counts = {r.part: r.n for r in made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    files = -(-max(counts.values(), default=0) // FILE_PACKETS)
    files = files if files and min(counts.values()) >= 1_000 * files else 1  # none is left empty
    for i in sorted(counts):
        made.where(F.col("part") == i).drop("part").repartition(files, "packet_no").write.mode("append").parquet(f"{path}/in")
    end = spark.range(1).select(*(F.lit(value).cast(f.dataType).alias(f.name) for f, value in ((f, {"packet_no": -1, "ts_sec": (bounds.high or 0) + LATE + IDLE + 60, "ts_usec": 0, "data": b""}.get(f.name)) for f in sent.schema)))
    end.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")


def _ended(rows: DataFrame, mode: str, path: str, schema: str) -> DataFrame:
    """What a stream has written once it has taken all its files."""
    rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/out/batch={i}")).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(schema).parquet(f"{path}/out")


@query
def streamed_traffic(spark, sf_dir):
    """Packets and bytes of each second, in append mode: each second is given when it is over."""
    path = scratch(spark, "stream")
    seen = headers(stream(spark, sf_dir, path))
    counted = F.col("parse_ok") & F.col("has_ip")
    seconds = traffic(seen.withColumns({"frame_length": F.when(counted, F.col("frame_length"))}), f"{LATE} seconds")
    found = seconds.select(F.unix_seconds("window.start").alias("second"), "packets", "bytes")
    return _ended(found, "append", path, "second long, packets long, bytes long").select("second", "packets", "bytes").where("packets > 0")


@query
def streamed_sessions(spark, sf_dir):
    """Flows cut where they are silent, from packets that come out of order: the last row of each session."""
    path, setting = scratch(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen = inspection.inspected(stream(spark, sf_dir, path))
        rows = flow_updates(seen, rules(), IDLE, f"{LATE} seconds", F.expr(ENGINE_PACKETS))
        found = _ended(rows, "update", path, FLOW_SCHEMA)
    finally:
        spark.conf.set(setting, before)
    last = found.groupBy(*codec.FIVE_TUPLE, "session").agg(F.max_by(F.struct("state", "application", "sni", "packets", "bytes", "dropped", "first_ts", "last_ts"), "packets").alias("last"))
    return last.select(*codec.FIVE_TUPLE, "session", "last.*")


@query
def summary_shown(spark, sf_dir):
    return report.shown(analysis(spark, sf_dir).summary)


SESSION = ("session", "state", "application", "sni", "packets", "bytes", "dropped", "first_ts", "last_ts")


@query
def idle_sessions(spark, sf_dir):
    """Flows cut where they are silent for more than a day."""
    found = flow_ops.sessions(engine_packets(analysis(spark, sf_dir).inspected), rules(), IDLE)
    return found.select(*codec.FIVE_TUPLE, *SESSION)


def stored_parts(spark, sf_dir) -> Analysis:
    """The packets in three ranges, each summed up and stored by itself, as captures that come one after another are."""
    path, sent = scratch(spark, "summaries"), packets(spark, sf_dir)
    low, high = events(spark, sf_dir).agg(F.min("event_id"), F.max("event_id")).first()
    for i in range(3):
        at = [low + (high + 1 - low) * k // 3 for k in (i, i + 1)] if low is not None else [0, 0]
        Analysis(sent.where(F.col("packet_no").between(at[0], at[1] - 1)), rules()).summaries.write.mode("append").parquet(path)
    return Analysis.from_summaries(spark.read.parquet(path), rules())


@query
def stored_flow_table(spark, sf_dir):
    """The flow table made of stored parts."""
    return stored_parts(spark, sf_dir).all_flows


@query
def stored_graph_edges(spark, sf_dir):
    """The graph's edges made of stored parts."""
    a = stored_parts(spark, sf_dir)
    return report.graph_edges(a.tuples, a.flows)


@query
def stored_summary(spark, sf_dir):
    """Engine totals and times made of stored parts."""
    return stored_parts(spark, sf_dir).summary


QUERIES["report_packets"] = report_totals


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
