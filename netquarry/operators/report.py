"""The tables of an analysis: packets, flows, domains, applications, timeline, graph and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netquarry.functions.codec import FIVE_TUPLE, epoch, flag_names, protocol_name, utc_millis
from netquarry.operators.flows import engine
from netquarry.operators.rules import RuleSet


def verdicts(tuples: DataFrame, rules: RuleSet, include_closed: bool = False, exact: bool = False) -> DataFrame:
    """One row for each five-tuple: ``flow_app, flow_sni`` of the flow that a lookup finds, and ``first_hit`` (number, time), the packet from which its pair of endpoints is dropped; ``first`` is the tuple's own.

    A lookup goes through the workers in order and in each tries the tuple and then its reverse, so the other
    direction's flow can be found first. With ``exact`` only the tuple itself counts. Closed flows aren't found unless they are included.

    Rules look at the tuple and at its flow's final attributes, so all packets of a tuple are hit or none is, and once one is, both
    directions stay blocked: the first packets of two tuples decide. Both directions meet in one window of at most two rows.
    """
    forth, back = F.concat_ws("|", "src_ip", "src_port"), F.concat_ws("|", "dst_ip", "dst_port")
    seen = engine() if include_closed else engine() & (F.col("state") != "CLOSED")
    first = F.struct(F.col("first_packet_no").alias("number"), F.col("first_ts").alias("ts")).alias("first")
    found = tuples.select(*FIVE_TUPLE, first, (forth <= back).alias("up"), F.least(forth, back).alias("low"), F.greatest(forth, back).alias("high"), F.when(seen, F.struct("worker", F.col("application").alias("app"), "sni")).alias("flow"))
    pair = Window.partitionBy("protocol", "low", "high")
    found = found.withColumns({"other": F.when(F.col("up"), F.max(F.when(~F.col("up"), F.col("flow"))).over(pair)).otherwise(F.max(F.when(F.col("up"), F.col("flow"))).over(pair))})
    mine = F.lit(True) if exact else F.col("flow").isNotNull() & (F.col("other").isNull() | (F.col("flow.worker") <= F.col("other.worker")))
    found = found.withColumn("met", F.when(mine, F.col("flow")).otherwise(F.col("other"))).withColumns({"flow_app": F.col("met.app"), "flow_sni": F.col("met.sni")})
    hit = rules.address_hit(F.col("src_ip"), F.col("dst_port")) | rules.flow_hit(F.coalesce("flow_app", F.lit("Unknown")), F.coalesce("flow_sni", F.lit("")))
    return found.withColumn("first_hit", F.min(F.when(hit, F.col("first"))).over(pair)).select(*FIVE_TUPLE, "flow_app", "flow_sni", "first_hit", "first").where(" AND ".join(f"{c} IS NOT NULL" for c in FIVE_TUPLE))


def act(reported: DataFrame, judged: DataFrame) -> DataFrame:
    """Report packets with ``flow_app``, ``flow_sni`` and ``report_action``: one join by the tuple, which AQE may broadcast or split."""
    return reported.join(judged, list(FIVE_TUPLE), "left").withColumn("report_action", F.when(F.col("packet_no") >= F.col("first_hit.number"), "DROP").otherwise("FORWARD")).drop("first_hit", "first")


def packet_details(acted: DataFrame) -> DataFrame:
    ts = epoch(F.col("ts_sec"), F.col("ts_usec"))
    summary = F.when(F.col("payload_length") <= 0, "No payload").when(F.coalesce("flow_sni", F.lit("")) != "", F.concat(F.lit("SNI: "), F.col("flow_sni"))).otherwise(F.concat(F.lit("Payload size: "), F.col("payload_length").cast("string"), F.lit(" bytes")))
    return acted.select(
        F.col("packet_no").alias("id"), utc_millis(ts).alias("timestamp"), ts.alias("timestamp_epoch"), "src_ip", "dst_ip", protocol_name(F.col("protocol")).alias("protocol"), "src_port", "dst_port",
        flag_names(F.col("tcp_flags")).alias("tcp_flags"), F.col("frame_length").alias("length"), "ttl", summary.alias("payload_summary"), F.col("report_action").alias("action"), layers().alias("layer_details"),
    )


def layers() -> Column:
    # The texts of the layers.
    return F.array_compact(F.array(
        F.concat(F.lit("Ethernet Layer: Src="), F.col("src_mac"), F.lit(", Dst="), F.col("dst_mac"), F.lit(", Type=0x"), F.lpad(F.hex("ether_type"), 4, "0")),
        F.format_string("IPv4 Layer: Src=%s, Dst=%s, TTL=%d, Protocol=%d", "src_ip", "dst_ip", "ttl", "protocol"),
        F.when(F.col("has_tcp"), F.format_string("TCP Layer: SrcPort=%d, DstPort=%d, Seq=%d, Ack=%d, Flags=[%s]", "src_port", "dst_port", "seq_number", "ack_number", flag_names(F.col("tcp_flags"))))
        .when(F.col("has_udp"), F.format_string("UDP Layer: SrcPort=%d, DstPort=%d, Length=%d", "src_port", "dst_port", F.col("payload_length") + 8)),
    ))


def flow_details(flows: DataFrame) -> DataFrame:
    """Durations are those of the capture. Listed by worker and first packet when ordered."""
    return flows.select(
        F.concat("src_ip", F.lit(":"), F.col("src_port").cast("string"), F.lit("_"), "dst_ip", F.lit(":"), F.col("dst_port").cast("string")).alias("id"), F.col("src_ip").alias("client"), F.col("dst_ip").alias("server"),
        F.when(F.col("protocol") == 6, "TCP").otherwise("UDP").alias("protocol"), (F.col("last_ts") - F.col("first_ts")).alias("duration"), "packets", "bytes", "application", F.col("state").alias("status"), "worker", "first_packet_no",
    )


def domains(flows: DataFrame) -> DataFrame:
    """One row for each flow with a name."""
    return flows.where("sni <> ''").select(F.col("sni").alias("domain"), F.col("application").alias("app"), F.col("packets").alias("count"), "worker", "first_packet_no")


def app_distribution(flows: DataFrame) -> DataFrame:
    return flows.groupBy("application").agg(F.count(F.lit(1)).alias("flows"))


def timeline(reported: DataFrame, judged: DataFrame) -> DataFrame:
    """Packets, bytes and report drops in each second after the first packet of the capture, in order; seconds without packets have no row.

    The first packet is taken from ``judged``, all of whose columns are named so that both uses of it share their shuffles.
    """
    acted, ts = act(reported, judged), epoch(F.col("ts_sec"), F.col("ts_usec"))
    first = judged.agg(F.min(F.struct("first", *(c for c in judged.columns if c != "first")))["first"]["ts"].alias("first_ts"))
    second = (ts - F.col("first_ts")).cast("long")
    counted = acted.select("ts_sec", "ts_usec", "frame_length", "report_action").crossJoin(F.broadcast(first)).withColumn("second", second)
    counted = counted.groupBy("second").agg(F.count(F.lit(1)).alias("packets"), F.sum("frame_length").cast("long").alias("bytes"), F.count_if(F.col("report_action") == "DROP").alias("dropped"))
    return counted.orderBy("second").select(F.col("second").cast("double").alias("timestamp"), F.format_string("+%ds", "second").alias("time_label"), "packets", "bytes", "dropped")


def graph_nodes(tuples: DataFrame, flows: DataFrame) -> DataFrame:
    """Addresses and names with what they sent and received; the type is that of the first appearance, source before target. Built from the tuples' counts."""
    seen = tuples.select("packets", "bytes", F.expr("stack(2, src_ip, first_packet_no * 2, dst_ip, first_packet_no * 2 + 1) AS (id, seen_at)"))
    named = flows.where("sni <> ''").groupBy(F.col("sni").alias("id")).agg(F.count(F.lit(1)).alias("packets")).select("packets", F.lit(0).cast("long").alias("bytes"), "id", F.lit(None).cast("long").alias("seen_at"))
    nodes = seen.unionByName(named).groupBy("id").agg(F.min("seen_at").alias("seen_at"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    kind = F.when(F.col("seen_at").isNull(), "domain").when(F.col("seen_at") % 2 == 0, "client").otherwise("server")
    return nodes.select("id", F.col("id").alias("label"), kind.alias("type"), "packets", "bytes")


def graph_edges(tuples: DataFrame, flows: DataFrame) -> DataFrame:
    """Address pairs, and a server's names where that pair isn't an address pair; names carry no counts."""
    pairs = tuples.groupBy(F.col("src_ip").alias("source"), F.col("dst_ip").alias("target")).agg(F.min_by("protocol", "first_packet_no").alias("number"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    pairs = pairs.select("source", "target", protocol_name(F.col("number")).alias("protocol"), "packets", "bytes")
    names = flows.where("sni <> ''").select(F.col("dst_ip").alias("source"), F.col("sni").alias("target")).distinct()
    names = names.join(pairs, ["source", "target"], "left_anti").withColumns({"protocol": F.lit("TLS/SNI"), "packets": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long")})
    return pairs.unionByName(names)


def _engine_counts() -> list[Column]:
    total = lambda what: F.coalesce(F.sum(F.when(engine(), what)), F.lit(0)).cast("long")
    packets = F.col("packets")
    return [
        total(packets).alias("total_packets"), total(F.col("bytes")).alias("total_bytes"), total(F.when(F.col("protocol") == 6, packets)).alias("tcp_packets"), total(F.when(F.col("protocol") == 17, packets)).alias("udp_packets"),
        total(packets - F.col("dropped")).alias("forwarded_packets"), total(F.col("dropped")).alias("dropped_packets"),
    ]


def engine_totals(tuples: DataFrame) -> DataFrame:
    return tuples.agg(*_engine_counts())


def summary(tuples: DataFrame, rules: RuleSet) -> DataFrame:
    """One row: engine totals and active flows, with sizes and times of all report packets."""
    times = F.coalesce(F.max_by("last_ts", "last_no") - F.min_by("first_ts", "first_packet_no"), F.lit(0.0)).alias("capture_duration")
    active = F.count_if(engine() & ~F.col("state").isin("CLOSED", "BLOCKED")).alias("active_connections")
    t, d = F.col("total_packets"), F.col("capture_duration")
    stats = rules.stats()
    return tuples.agg(*_engine_counts(), active, F.coalesce(F.max("largest"), F.lit(0)).alias("largest_packet_size"), times).select(
        "total_packets", "total_bytes", "tcp_packets", "udp_packets", "forwarded_packets", "dropped_packets", F.when(t > 0, 100.0 * F.col("dropped_packets") / t).otherwise(0.0).alias("drop_rate"), F.when(t > 0, F.col("total_bytes") / t).otherwise(0.0).alias("average_packet_size"),
        "largest_packet_size", "capture_duration", F.when(d > 0, 8.0 * F.col("total_bytes") / d).otherwise(0.0).alias("bandwidth_bits_per_sec"), "active_connections",
        F.lit(stats["blocked_ips"]).alias("blocked_ips"), F.lit(stats["blocked_apps"]).alias("blocked_apps"), F.lit(stats["blocked_domains"]).alias("blocked_domains"),
    )


def shown(summary: DataFrame) -> DataFrame:
    """A summary's shares as a dashboard shows them: the forward rate to one digit, the drop rate and the duration to two."""
    t = F.col("total_packets")
    return summary.select(
        F.round(F.when(t > 0, 100.0 * F.col("forwarded_packets") / t).otherwise(0.0), 1).alias("forward_rate"), F.round("drop_rate", 2).alias("drop_rate"), F.round("capture_duration", 2).alias("duration"),
    )


def top_domains(flows: DataFrame, n: int = 20) -> DataFrame:
    counted = flows.where("sni <> ''").groupBy("sni").agg(F.count(F.lit(1)).alias("flows")).orderBy(F.desc("flows"), "sni").limit(n)
    return counted.select(F.col("sni").alias("domain"), F.when(F.length("sni") > 35, F.concat(F.left("sni", F.lit(32)), F.lit("..."))).otherwise(F.col("sni")).alias("shown"), "flows")


def classification(flows: DataFrame) -> DataFrame:
    """Applications by flows, with their share and its bar, and how many flows are classified at all."""
    total = flows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("application") != "Unknown").alias("classified"))
    pct = 100.0 * F.col("flows") / F.col("total")
    return app_distribution(flows).crossJoin(F.broadcast(total)).select("application", "flows", pct.alias("percent"), F.rpad(F.repeat(F.lit("#"), (pct / 5).cast("int")), 20, " ").alias("bar"), "classified", (F.col("total") - F.col("classified")).alias("unidentified")).orderBy(F.desc("flows"), "application")


def tracker_stats(flows: DataFrame) -> DataFrame:
    return flows.agg(
        F.count_if(F.col("state") != "CLOSED").alias("active_connections"), F.count(F.lit(1)).alias("total_connections_seen"), F.coalesce(F.sum("classified_events"), F.lit(0)).cast("long").alias("classified"), F.coalesce(F.sum("blocked_events"), F.lit(0)).cast("long").alias("blocked"),
    )


def inspection_counters(run: DataFrame) -> DataFrame:
    """Names taken from TLS, and findings that tell an application, over the findings that classified a flow."""
    counted = run.where("classified")
    hit = ((F.col("found_by") == "TLS") & ~F.col("found_app").isin("Unknown", "HTTPS")) | ((F.col("found_by") == "HTTP") & ~F.col("found_app").isin("Unknown", "HTTP"))
    return counted.agg(F.count_if(F.col("found_by") == "TLS").alias("sni_extractions"), F.count_if(hit).alias("classification_hits"))


def worker_load(tuples: DataFrame, balancers: int = 2, workers: int = 2) -> DataFrame:
    """Packets and flows by the worker that a five-tuple's hash names; those that no hash reaches have none."""
    loads = tuples.where(engine()).groupBy("worker").agg(F.sum("packets").alias("processed"), F.sum(F.col("packets") - F.col("dropped")).alias("forwarded"), F.count(F.lit(1)).alias("flows"))
    every = tuples.sparkSession.range(balancers * workers).select(F.col("id").cast("int").alias("worker"))
    return every.join(loads, "worker", "left").na.fill(0).withColumn("dropped", F.col("processed") - F.col("forwarded"))


def protocol_breakdown(reported: DataFrame) -> DataFrame:
    """Packets by protocol, and by the ports of DNS and TLS on either side."""
    on = lambda port: (F.col("src_port") == port) | (F.col("dst_port") == port)
    counted = reported.agg(F.count_if("has_tcp").alias("TCP"), F.count_if("has_udp").alias("UDP"), F.count_if(on(53)).alias("DNS"), F.count_if(on(443)).alias("TLS"))
    return counted.unpivot([], ["TCP", "UDP", "DNS", "TLS"], "name", "packets")
