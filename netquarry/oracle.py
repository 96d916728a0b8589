"""DuckDB SQL for the queries, stated from the event table's columns instead of the frames."""

from __future__ import annotations

from netquarry.functions.classify import APP_NAMES, APP_PATTERNS
from netquarry.queries import APPS, CAPACITY, DOMAINS, HOST, IDLE, IPS, NOW
from netquarry.synth import HOSTS

KEY = "src_ip, dst_ip, src_port, dst_port, protocol"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def app_sql(host: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f"contains(lower({host}), '{p}')" for p in patterns)} THEN '{app}'" for app, patterns in APP_PATTERNS)
    return f"CASE WHEN coalesce({host}, '') = '' THEN 'Unknown' {whens} ELSE 'HTTPS' END"


def domain_sql(host: str, rules=DOMAINS) -> str:
    hits = [f"ends_with(lower({host}), '{r[1:].lower()}') OR lower({host}) = '{r[2:].lower()}'" if r.startswith("*.") else "false" if "*" in r else f"contains(lower({host}), '{r.lower()}')" for r in rules]
    return f"({host} <> '' AND ({' OR '.join(hits)}))"


def _hash() -> str:
    number = lambda ip: "(" + " + ".join(f"(split_part({ip}, '.', {i + 1})::BIGINT << {8 * i})" for i in range(4)) + ")"
    h = "0::BIGINT"
    steps = []
    for i, v in enumerate((number("src_ip"), number("dst_ip"), "src_port::BIGINT", "dst_port::BIGINT", "protocol::BIGINT")):
        steps.append((i, f"xor({h}, {v} + 2654435769 + ({h} << 6) + ({h} >> 2))"))
        h = f"h{i}"
    source = "{source}"
    sql = source
    for i, step in steps:
        sql = f"(SELECT *, {step} AS h{i} FROM {sql})"
    return sql


def _hex(number: str, little: bool) -> str:
    """The eight hexadecimal digits of a 32-bit number, its lowest byte first if ``little``."""
    digits = f"lower(printf('%08X', {number}))"
    return "(" + " || ".join(f"substr({digits}, {i}, 2)" for i in ((7, 5, 3, 1) if little else (1, 3, 5, 7))) + ")"


def hashed(source: str) -> str:
    """``source`` with h4, the hash of its five-tuple."""
    return _hash().format(source=source)


WORKER = "((h4 % 2) * 2 + h4 % 2)::INT"
FLAGS = ((2, "SYN"), (16, "ACK"), (1, "FIN"), (4, "RST"), (8, "PSH"), (32, "URG"))


def flags_sql(flags: str) -> str:
    named = ", ".join(f"CASE WHEN ({flags}) & {bit} <> 0 THEN '{name}' END" for bit, name in FLAGS)
    return f"coalesce(nullif(concat_ws(' ', {named}), ''), 'none')"


PROTOCOL = "CASE protocol WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'Unknown(' || protocol || ')' END"

BASE = f"""
WITH ev AS (
  SELECT event_id AS e, user_id AS u, event_type AS ty, epoch_us(ts) AS us, {_list(HOSTS)}[((user_id * 5 + event_id % 3) % {len(HOSTS)}) + 1] AS host, ((user_id * 5 + event_id % 3) % {len(HOSTS)}) + 1 AS host_no,
         CAST(floor(coalesce(value, 0)) AS BIGINT) % 40 AS pad FROM events
), kinds AS (
  SELECT *, CASE WHEN ty = 'signup' AND e % 13 = 0 THEN 'arp' WHEN ty = 'error' AND e % 7 = 0 THEN 'icmp' WHEN ty = 'view' AND e % 97 = 0 AND e % 5 <> 1 THEN 'cut' WHEN ty = 'signup' THEN 'udp' ELSE 'tcp' END AS kind,
         CASE WHEN ty = 'error' THEN CASE WHEN e % 2 = 0 THEN 4 ELSE 17 END ELSE [2, 18, 16, 24, 17][e % 5 + 1] END AS fl,
         '10.0.' || ((u // 256) % 256) || '.' || (u % 256) AS client, 49152 + u * 7 % 64 AS client_port, CASE WHEN ty = 'signup' THEN '8.8.8.8' ELSE '198.51.100.' || host_no END AS server,
         CASE ty WHEN 'signup' THEN 53 WHEN 'click' THEN 80 ELSE 443 END AS server_port FROM ev
), loads AS (
  SELECT *, CASE WHEN kind = 'udp' THEN 'dns' WHEN kind <> 'tcp' OR fl <> 24 THEN '' WHEN ty = 'click' AND e % 4 = 0 THEN 'post' WHEN ty = 'click' THEN 'http' WHEN ty = 'purchase' AND e % 3 = 0 THEN 'raw' ELSE 'tls' END AS load FROM kinds
), frame AS (
  SELECT *, CASE load WHEN 'dns' THEN 18 + length(host) + pad WHEN 'post' THEN 19 WHEN 'http' THEN 42 + length(host) + pad WHEN 'raw' THEN 60 WHEN 'tls' THEN 70 + length(host) ELSE 0 END::INT AS load_length, kind = 'tcp' AND fl = 18 AND ty <> 'error' AS back FROM loads
), packets AS (
  SELECT e AS packet_no, us, (us // 1000000)::INT AS ts_sec, (us % 1000000)::INT AS ts_usec, ((us // 1000000) + (us % 1000000) / 1000000.0::DOUBLE)::DOUBLE AS ts, e, u, ty, host, load, pad, kind,
         kind <> 'cut' AS parse_ok, kind IN ('tcp', 'udp', 'icmp') AS has_ip, kind = 'tcp' AS has_tcp, kind = 'udp' AS has_udp, CASE WHEN back THEN server ELSE client END AS src_ip, CASE WHEN back THEN client ELSE server END AS dst_ip,
         CASE WHEN kind = 'icmp' THEN 0 WHEN back THEN server_port ELSE client_port END::INT AS src_port, CASE WHEN kind = 'icmp' THEN 0 WHEN back THEN client_port ELSE server_port END::INT AS dst_port,
         CASE kind WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'icmp' THEN 1 END::INT AS protocol, (32 + u % 64)::INT AS ttl, CASE WHEN kind = 'tcp' THEN fl ELSE 0 END::INT AS tcp_flags,
         CASE kind WHEN 'arp' THEN 28 WHEN 'icmp' THEN 8 ELSE load_length END::INT AS payload_length, CASE kind WHEN 'tcp' THEN 54 WHEN 'udp' THEN 42 WHEN 'icmp' THEN 34 ELSE 14 END::INT AS payload_offset,
         CASE kind WHEN 'arp' THEN 42 WHEN 'icmp' THEN 42 WHEN 'cut' THEN 30 WHEN 'udp' THEN 42 + load_length ELSE 54 + load_length END::INT AS frame_length FROM frame
), report AS (SELECT * FROM packets WHERE parse_ok AND has_ip
), found AS (
  SELECT *, CASE load WHEN 'tls' THEN 'TLS' WHEN 'http' THEN 'HTTP' WHEN 'dns' THEN 'DNS' WHEN 'post' THEN 'port 80' WHEN 'raw' THEN 'port 443' END AS found_by,
         CASE WHEN load IN ('tls', 'http') THEN host WHEN load <> '' THEN '' END AS found_sni, CASE load WHEN 'tls' THEN {app_sql("host")} WHEN 'http' THEN {app_sql("host")} WHEN 'dns' THEN 'DNS' WHEN 'post' THEN 'HTTP' WHEN 'raw' THEN 'HTTPS' END AS found_app
  FROM report WHERE has_tcp OR has_udp
)"""


def _run(ips=IPS, apps=APPS, domains=DOMAINS) -> str:
    """The flows' state machine in closed form. A flow's packets fall into segments, each started by a close. What is carried into a segment is the first
    blocked finding since the last segment that began with a finding, or else the last finding."""
    known = [next((n for n in APP_NAMES if n.lower() == a.lower()), "Unknown") for a in apps]
    address = f"src_ip IN ({', '.join(f"'{i}'" for i in ips)})" if ips else "false"
    bad = (f"coalesce(f.found_app IN ({', '.join(f"'{a}'" for a in known)}) OR {domain_sql('f.found_sni', domains)}, false)") if apps or domains else "false"
    return f""", marks AS (
  SELECT *, max((tcp_flags & 1)) OVER w AS fin, max(CASE WHEN (tcp_flags & 18) = 2 THEN 1 ELSE 0 END) OVER w AS syn, max(CASE WHEN (tcp_flags & 18) = 18 THEN 1 ELSE 0 END) OVER w AS synack, {address} AS address
  FROM found WINDOW w AS (PARTITION BY {KEY} ORDER BY packet_no ROWS UNBOUNDED PRECEDING)
), segs AS (SELECT *, (sum(CASE WHEN (tcp_flags & 4) <> 0 OR (fin = 1 AND (tcp_flags & 16) <> 0) THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY packet_no ROWS UNBOUNDED PRECEDING))::INT AS seg FROM marks
), firsts AS (
  SELECT {KEY}, seg, any_value(address) AS address, min(packet_no) AS a, min(packet_no) FILTER (found_by IS NOT NULL) AS f, arg_min(found_app, packet_no) FILTER (found_by IS NOT NULL) AS found_app, arg_min(found_sni, packet_no) FILTER (found_by IS NOT NULL) AS found_sni
  FROM segs GROUP BY {KEY}, seg
), offered AS (
  SELECT f.*, coalesce(f = a, false) AS fresh, {bad} AS bad, sum(CASE WHEN f = a THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY seg ROWS UNBOUNDED PRECEDING) AS chain, CASE WHEN f IS NOT NULL AND (f = a OR NOT address) THEN 1 END AS gives FROM firsts f
), carried AS (
  SELECT *, first_value(CASE WHEN gives = 1 AND bad THEN {{'app': found_app, 'sni': found_sni}} END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS stuck,
         last_value(CASE WHEN gives = 1 THEN {{'app': found_app, 'sni': found_sni}} END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS latest,
         NOT fresh AND coalesce(max(CASE WHEN gives = 1 AND bad THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS blocked_before
  FROM offered WINDOW w AS (PARTITION BY {KEY}, chain ORDER BY seg)
), segments AS (
  SELECT *, coalesce(stuck.app, latest.app, 'Unknown') AS app, coalesce(stuck.sni, latest.sni, '') AS sni, f IS NOT NULL AND (fresh OR NOT (address OR blocked_before)) AS classified,
         CASE WHEN address OR blocked_before OR (f IS NOT NULL AND bad) THEN 'BLOCKED' WHEN f IS NOT NULL THEN 'CLASSIFIED' WHEN seg > 0 THEN 'CLOSED' ELSE 'OPEN' END AS seg_state FROM carried
), run AS (
  SELECT p.*, CASE WHEN s.address OR s.blocked_before OR (s.f IS NOT NULL AND p.packet_no >= s.f AND s.bad) THEN 'DROP' ELSE 'FORWARD' END AS action, s.classified AND p.packet_no = s.f AS classified,
         s.app AS seg_app, s.sni AS seg_sni, s.f AS f, lag(s.app) OVER fl AS x, s.fresh, s.blocked_before FROM segs p JOIN segments s USING ({KEY}, seg) WINDOW fl AS (PARTITION BY {KEY} ORDER BY p.packet_no)
), established AS (SELECT DISTINCT {KEY}, true AS shaken FROM segs WHERE seg = 0 AND syn = 1 AND synack = 1 AND (tcp_flags & 16) <> 0
), totals AS (
  SELECT {KEY}, count(*) AS packets, sum(frame_length)::BIGINT AS bytes, min(packet_no) AS first_packet_no, arg_min(ts, packet_no) AS first_ts, arg_max(ts, packet_no) AS last_ts FROM found GROUP BY {KEY}
), ends AS (
  SELECT {KEY}, arg_max(seg_state, seg) AS seg_state, arg_max(app, seg) AS application, arg_max(sni, seg) AS sni, count(*) FILTER (classified) AS classified_events, count(*) FILTER (seg_state = 'BLOCKED') AS blocked_events FROM segments GROUP BY {KEY}
), all_flows AS (
  SELECT {KEY}, CASE WHEN seg_state <> 'OPEN' THEN seg_state WHEN coalesce(shaken, false) THEN 'ESTABLISHED' ELSE 'NEW' END AS state, application, sni, packets, bytes, first_packet_no, first_ts, last_ts, classified_events, blocked_events, {WORKER} AS worker
  FROM {hashed(f"(SELECT * FROM totals JOIN ends USING ({KEY}) LEFT JOIN established USING ({KEY}))")}
), flows AS (SELECT * FROM all_flows WHERE state <> 'CLOSED'
), resolved AS (
  SELECT p.*, least(CASE WHEN o.worker IS NOT NULL THEN {{'w': o.worker, 't': 0, 'app': o.application, 'sni': o.sni}} END, CASE WHEN r.worker IS NOT NULL THEN {{'w': r.worker, 't': 1, 'app': r.application, 'sni': r.sni}} END) AS flow
  FROM report p LEFT JOIN flows o ON (o.src_ip, o.dst_ip, o.src_port, o.dst_port, o.protocol) = (p.src_ip, p.dst_ip, p.src_port, p.dst_port, p.protocol)
  LEFT JOIN flows r ON (r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol) = (p.dst_ip, p.src_ip, p.dst_port, p.src_port, p.protocol)
), hits AS (
  SELECT *, flow.app AS found_app2, flow.sni AS found_sni2, {address} OR {bad.replace("f.found_app", "flow.app").replace("f.found_sni", "flow.sni")} AS hit,
         CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_ip || ':' || src_port || dst_ip || ':' || dst_port ELSE dst_ip || ':' || dst_port || src_ip || ':' || src_port END AS pair FROM resolved
), acted AS (
  SELECT *, CASE WHEN max(hit::INT) OVER (PARTITION BY protocol, pair ORDER BY packet_no ROWS UNBOUNDED PRECEDING) = 1 THEN 'DROP' ELSE 'FORWARD' END AS report_action FROM hits
), details AS (
  SELECT packet_no AS id, strftime(make_timestamp((trunc(ts * 1000)::BIGINT) * 1000), '%Y-%m-%d %H:%M:%S.') || lpad(((trunc(ts * 1000)::BIGINT) % 1000)::VARCHAR, 3, '0') AS timestamp, ts AS timestamp_epoch, src_ip, dst_ip, {PROTOCOL} AS protocol, src_port, dst_port,
         {flags_sql("tcp_flags")} AS tcp_flags, frame_length AS length, ttl, CASE WHEN payload_length <= 0 THEN 'No payload' WHEN coalesce(found_sni2, '') <> '' THEN 'SNI: ' || found_sni2 ELSE 'Payload size: ' || payload_length || ' bytes' END AS payload_summary, report_action AS action FROM acted
), nodes AS (
  SELECT id, id AS label, arg_min(type, (phase, packet_no, side)) AS type, count(*) AS packets, sum(bytes)::BIGINT AS bytes FROM (
    SELECT src_ip AS id, 'client' AS type, 0 AS phase, packet_no, 0 AS side, frame_length AS bytes FROM acted UNION ALL SELECT dst_ip, 'server', 0, packet_no, 1, frame_length FROM acted
    UNION ALL SELECT sni, 'domain', 1, first_packet_no, 0, 0 FROM flows WHERE sni <> '') GROUP BY id
), pairs AS (SELECT src_ip AS source, dst_ip AS target, arg_min({PROTOCOL}, packet_no) AS protocol, count(*) AS packets, sum(frame_length)::BIGINT AS bytes FROM acted GROUP BY 1, 2
), edges AS (
  SELECT * FROM pairs UNION ALL SELECT DISTINCT dst_ip, sni, 'TLS/SNI', 0, 0 FROM flows WHERE sni <> '' AND NOT EXISTS (SELECT 1 FROM pairs WHERE source = flows.dst_ip AND target = flows.sni)
), flow_details AS (
  SELECT src_ip || ':' || src_port || '_' || dst_ip || ':' || dst_port AS id, src_ip AS client, dst_ip AS server, CASE WHEN protocol = 6 THEN 'TCP' ELSE 'UDP' END AS protocol, last_ts - first_ts AS duration, packets, bytes, application, state AS status, worker, first_packet_no FROM flows
)"""


def _mac(ip: str) -> str:
    return "'02:00:' || " + " || ':' || ".join(f"lpad(lower(to_hex(split_part({ip}, '.', {i})::INT)), 2, '0')" for i in range(1, 5))


def mixed() -> str:
    return f"(SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '{HOST}', 1) WHEN 1 THEN {_list(HOSTS)}[page_id % {len(HOSTS)} + 1] ELSE upper({_list(HOSTS)}[page_id % {len(HOSTS)} + 1]) END AS host FROM pages)"


def sessions_sql() -> str:
    """The flows' state machine over sessions: five-tuples cut where they are silent."""
    cut = f""", cut AS (SELECT *, max(begun) OVER (PARTITION BY {KEY} ORDER BY packet_no ROWS UNBOUNDED PRECEDING) AS session FROM (
      SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY {KEY} ORDER BY packet_no) > {IDLE}, true) THEN packet_no END AS begun FROM found))"""
    run = _run().replace("FROM found", "FROM cut").replace(KEY, f"{KEY}, session")
    return BASE + cut + run + f""", drops AS (SELECT {KEY}, session, count(*) FILTER (action = 'DROP') AS dropped FROM run GROUP BY ALL)
      SELECT {KEY}, session, state, application, sni, packets, bytes, dropped, first_ts, last_ts FROM all_flows JOIN drops USING ({KEY}, session)"""


def oracle_sql() -> dict[str, str]:
    run, free = BASE + _run(), BASE + _run((), (), ())
    header = ("ts_sec", "ts_usec", "frame_length", "frame_length")
    known = [next((n for n in APP_NAMES if n.lower() == a.lower()), "Unknown") for a in APPS]
    names = [*APP_NAMES, "no such app"]
    lower_names = " ".join(f"WHEN '{n.lower()}' THEN '{n}'" for n in APP_NAMES)
    drawn = f"""WITH rules AS (
      SELECT 'IP' AS kind, value FROM (SELECT '10.0.' || ((user_id // 256) % 256) || '.' || (user_id % 256) AS value, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, value LIMIT 20)
      UNION ALL SELECT 'DOMAIN', value FROM (SELECT regexp_extract(url, '{HOST}', 1) AS value, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, value LIMIT 10)
      UNION ALL SELECT DISTINCT 'PORT', CASE event_type WHEN 'signup' THEN '53' WHEN 'click' THEN '80' ELSE '443' END FROM events
      UNION ALL SELECT 'APP', a FROM (VALUES {", ".join(f"('{a}')" for a in known)}) AS v(a))"""
    octets = ("event_id % 256", "user_id % 256", "7", "event_id * 3 % 256")
    own = {
        "timeline": run + " SELECT s::DOUBLE AS timestamp, '+' || s || 's' AS time_label, count(*) AS packets, sum(frame_length)::BIGINT AS bytes, count(*) FILTER (report_action = 'DROP') AS dropped FROM (SELECT *, trunc(ts - (SELECT arg_min(ts, packet_no) FROM acted))::BIGINT AS s FROM acted) GROUP BY s",
        "engine_totals": run + " SELECT count(*) AS total_packets, coalesce(sum(frame_length), 0)::BIGINT AS total_bytes, count(*) FILTER (has_tcp) AS tcp_packets, count(*) FILTER (has_udp) AS udp_packets, count(*) FILTER (action = 'FORWARD') AS forwarded_packets, count(*) FILTER (action = 'DROP') AS dropped_packets FROM run",
        "summary_stats": run + f""", t AS (SELECT count(*) AS n, sum(frame_length)::BIGINT AS b, count(*) FILTER (has_tcp) AS tcp, count(*) FILTER (has_udp) AS udp, count(*) FILTER (action = 'FORWARD') AS fw, count(*) FILTER (action = 'DROP') AS dr FROM run),
          r AS (SELECT max(frame_length) AS largest, arg_max(ts, packet_no) - arg_min(ts, packet_no) AS d FROM acted)
          SELECT n AS total_packets, b AS total_bytes, tcp AS tcp_packets, udp AS udp_packets, fw AS forwarded_packets, dr AS dropped_packets, 100.0::DOUBLE * dr / n AS drop_rate, b::DOUBLE / n AS average_packet_size, largest AS largest_packet_size, d AS capture_duration,
          8.0::DOUBLE * b / d AS bandwidth_bits_per_sec, (SELECT count(*) FROM flows WHERE state <> 'BLOCKED') AS active_connections, {len(IPS)}::INT AS blocked_ips, {len(APPS)}::INT AS blocked_apps, {len(DOMAINS)}::INT AS blocked_domains FROM t, r""",
        "decode_ethernet": BASE + f" SELECT packet_no, {_mac('src_ip')} AS src_mac, {_mac('dst_ip')} AS dst_mac, CASE WHEN kind = 'arp' THEN 2054 ELSE 2048 END::INT AS ether_type FROM packets",
        "decode_ipv4": BASE + " SELECT packet_no, 4::INT AS ip_version, ttl, protocol, src_ip, dst_ip FROM packets WHERE has_ip",
        "decode_tcp": BASE + " SELECT packet_no, src_port, dst_port, e AS seq_number, e * 2 AS ack_number, tcp_flags FROM packets WHERE has_tcp",
        "decode_udp": BASE + " SELECT packet_no, src_port, dst_port, payload_length FROM packets WHERE has_udp",
        "payload_stats": BASE + " SELECT protocol, dst_port, count(*) AS packets, count(*) FILTER (payload_length > 0) AS with_payload, sum(payload_length)::BIGINT AS payload_bytes, max(payload_offset) AS last_offset FROM report GROUP BY 1, 2",
        "parse_outcomes": BASE + " SELECT parse_ok, has_ip, has_tcp, has_udp, count(*) AS packets FROM packets GROUP BY ALL",
        "report_packets": BASE + " SELECT protocol, count(*) AS packets, sum(frame_length)::BIGINT AS bytes FROM report GROUP BY 1",
        "protocol_names": BASE + f" SELECT {PROTOCOL} AS protocol, count(*) AS packets FROM report GROUP BY 1",
        "tcp_flag_names": f"SELECT event_id, {flags_sql('event_id % 256')} AS flags FROM events",
        "ip_codec": f"SELECT event_id, {' + '.join(f'({o})::BIGINT * {256**i}' for i, o in enumerate(octets))} AS number, concat_ws('.', {', '.join(octets)}) AS ip, ((event_id % 256) * 256 + (event_id // 256) % 256) AS swapped16, "
        "((x % 256) * 16777216 + ((x // 256) % 256) * 65536 + ((x // 65536) % 256) * 256 + (x // 16777216) % 256) AS swapped32 FROM (SELECT *, event_id * 65537 AS x FROM events)",
        "flow_labels": run + " SELECT src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port || ' (' || CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE '?' END || ')' AS label FROM flows",
        "tuple_hash": BASE + f" SELECT packet_no, h4 AS hash FROM {hashed('found')}",
        "worker_assignment": BASE + f" SELECT src_ip, src_port, dst_ip, dst_port, {WORKER} AS worker, ((h4 % 3) * 4 + h4 % 4)::INT AS worker_of_12 FROM {hashed(f'(SELECT DISTINCT {KEY} FROM found)')}",
        "tls_client_hello": BASE + " SELECT dst_port, count(*) AS hellos FROM report WHERE load = 'tls' GROUP BY 1",
        "tls_sni": BASE + " SELECT packet_no, host AS sni FROM report WHERE load = 'tls'",
        "http_methods": BASE + " SELECT packet_no, CASE load WHEN 'http' THEN 'GET ' ELSE 'POST' END AS method FROM report WHERE load IN ('http', 'post')",
        "http_host": BASE + " SELECT packet_no, host FROM report WHERE load = 'http'",
        "dns_queries": BASE + " SELECT packet_no, host AS name FROM report WHERE load = 'dns'",
        "quic_sni": BASE + " SELECT packet_no, host AS sni FROM report WHERE load = 'tls'",
        "app_classify": f"SELECT page_id, host, {app_sql('host')} AS app FROM {mixed()}",
        "app_names": f"SELECT page_id, CASE lower({_list(names)}[page_id % {len(names)} + 1]) {lower_names} ELSE 'Unknown' END AS app FROM pages",
        "domain_rules": f"SELECT page_id, host, {domain_sql('host', ('Facebook', '*.example.com', 'a*b.com', '*.TIKTOK.com', 'zoom'))} AS blocked FROM {mixed()}",
        "block_reasons": free + f""" SELECT packet_no, type, detail FROM (SELECT packet_no, CASE WHEN src_ip IN ({', '.join(f"'{i}'" for i in IPS)}) THEN 'IP' WHEN dst_port = 80 THEN 'PORT' WHEN app IN ({', '.join(f"'{a}'" for a in known)}) THEN 'APP' WHEN {domain_sql('sni')} THEN 'DOMAIN' END AS type,
          CASE type WHEN 'IP' THEN src_ip WHEN 'PORT' THEN '80' WHEN 'APP' THEN app ELSE sni END AS detail FROM now) WHERE type IS NOT NULL""",
        "rule_stats": drawn + " SELECT count(*) FILTER (kind = 'IP') AS blocked_ips, count(*) FILTER (kind = 'APP') AS blocked_apps, count(*) FILTER (kind = 'DOMAIN') AS blocked_domains, count(*) FILTER (kind = 'PORT' AND value <> '53') AS blocked_ports FROM rules",
        "rules_file_parse": drawn + " SELECT kind, value FROM rules",
        "rule_edits": drawn + """ SELECT kind, value FROM rules WHERE CASE kind WHEN 'IP' THEN split_part(value, '.', 4)::INT % 2 = 1 WHEN 'DOMAIN' THEN length(value) % 2 = 1 WHEN 'APP' THEN value <> 'YouTube' ELSE value <> '53' END
          UNION SELECT * FROM (VALUES ('DOMAIN', '*.example.org'), ('APP', 'Netflix'), ('PORT', '8080'))""",
        "ip_rule_semi_join": BASE + f" SELECT packet_no, src_ip FROM report WHERE src_ip IN ({', '.join(f"'{i}'" for i in IPS)})",
        "domain_rule_theta_join": f"SELECT page_id, rule FROM {mixed()}, (VALUES ('facebook'), ('zoom'), ('example'), ('*.spotify.com')) AS r(rule) WHERE CASE WHEN starts_with(rule, '*.') THEN ends_with(lower(host), substr(rule, 2)) OR lower(host) = substr(rule, 3) ELSE contains(lower(host), rule) END",
        "rule_index_join": f"""WITH rules AS (SELECT DISTINCT rule FROM (SELECT unnest(regexp_extract_all(lower(html), '[a-z0-9]{{3,}}')) AS rule FROM pages UNION ALL SELECT '*' || regexp_replace(regexp_extract(url, '{HOST}', 1), '^[^.]*', '') FROM pages WHERE page_id % 3 = 0)
          ), names AS (SELECT DISTINCT lower(host) AS name FROM {mixed()} WHERE host <> ''), met AS (SELECT name, rule FROM names, rules WHERE CASE WHEN starts_with(rule, '*.') THEN ends_with(name, substr(rule, 2)) OR name = substr(rule, 3) ELSE NOT contains(rule, '*') AND contains(name, rule) END
          ) SELECT page_id, count(*) AS rules, arg_min(rule, (-length(rule), rule)) AS longest FROM {mixed()} JOIN met ON name = lower(host) GROUP BY page_id""",
        "idle_sessions": sessions_sql(),
        "streamed_sessions": sessions_sql(),
        "payload_inspection": BASE + " SELECT packet_no, found_by, found_app, found_sni FROM found WHERE found_by IS NOT NULL",
        "engine_actions": run + " SELECT packet_no, action, seg, app, sni FROM now",
        "flow_states": run + " SELECT state, count(*) AS flows, sum(packets)::BIGINT AS packets FROM all_flows GROUP BY 1",
        "flow_table": run + " SELECT * FROM all_flows",
        "flow_details": run + " SELECT * FROM flow_details",
        "app_distribution": run + " SELECT application, count(*) AS flows FROM flows GROUP BY 1",
        "domain_details": run + " SELECT sni AS domain, application AS app, packets AS count, worker, first_packet_no FROM flows WHERE sni <> ''",
        "graph_nodes": run + " SELECT * FROM nodes",
        "graph_edges": run + " SELECT * FROM edges",
        "edge_endpoints": run + " SELECT e.*, a.type AS source_type, b.type AS target_type FROM edges e JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target",
        "node_edges": run + " SELECT * FROM edges WHERE source = '198.51.100.1' OR target = '198.51.100.1'",
        "report_actions": run + " SELECT packet_no, report_action, flow.app AS flow_app, flow.sni AS flow_sni FROM acted",
        "packet_details": run + " SELECT * FROM details",
        "layer_details": run + f""" SELECT packet_no AS id, concat_ws(' | ', 'Ethernet Layer: Src=' || {_mac('src_ip')} || ', Dst=' || {_mac('dst_ip')} || ', Type=0x0800', 'IPv4 Layer: Src=' || src_ip || ', Dst=' || dst_ip || ', TTL=' || ttl || ', Protocol=' || protocol,
          CASE WHEN has_tcp THEN 'TCP Layer: SrcPort=' || src_port || ', DstPort=' || dst_port || ', Seq=' || e || ', Ack=' || e * 2 || ', Flags=[' || {flags_sql('tcp_flags')} || ']' WHEN has_udp THEN 'UDP Layer: SrcPort=' || src_port || ', DstPort=' || dst_port || ', Length=' || payload_length + 8 END) AS layers FROM acted""",
        "worker_load": run + f""", l AS (SELECT {WORKER} AS worker, * FROM {hashed('run')}) SELECT w::INT AS worker, count(packet_no) AS processed, count(*) FILTER (action = 'FORWARD') AS forwarded, count(DISTINCT CASE WHEN packet_no IS NOT NULL THEN ({KEY}) END) AS flows, count(*) FILTER (action = 'DROP') AS dropped
          FROM range(4) AS r(w) LEFT JOIN l ON l.worker = w GROUP BY w""",
        "tracker_stats": run + " SELECT count(*) FILTER (state <> 'CLOSED') AS active_connections, count(*) AS total_connections_seen, sum(classified_events)::BIGINT AS classified, sum(blocked_events)::BIGINT AS blocked FROM all_flows",
        "inspection_counters": run + " SELECT count(*) FILTER (found_by = 'TLS') AS sni_extractions, count(*) FILTER ((found_by = 'TLS' AND found_app NOT IN ('Unknown', 'HTTPS')) OR (found_by = 'HTTP' AND found_app NOT IN ('Unknown', 'HTTP'))) AS classification_hits FROM run WHERE classified",
        "protocol_breakdown": run + " SELECT 'TCP' AS name, count(*) FILTER (has_tcp) AS packets FROM acted UNION ALL SELECT 'UDP', count(*) FILTER (has_udp) FROM acted UNION ALL SELECT 'DNS', count(*) FILTER (src_port = 53 OR dst_port = 53) FROM acted UNION ALL SELECT 'TLS', count(*) FILTER (src_port = 443 OR dst_port = 443) FROM acted",
        "classification_report": run + " SELECT application, n AS flows, 100.0::DOUBLE * n / total AS percent, rpad(repeat('#', trunc(100.0::DOUBLE * n / total / 5)::INT), 20, ' ') AS bar, classified, total - classified AS unidentified FROM (SELECT application, count(*) AS n FROM flows GROUP BY 1), (SELECT count(*) AS total, count(*) FILTER (application <> 'Unknown') AS classified FROM flows)",
        "top_domains": run + " SELECT sni AS domain, CASE WHEN length(sni) > 35 THEN left(sni, 32) || '...' ELSE sni END AS shown, count(*) AS flows FROM flows WHERE sni <> '' GROUP BY sni ORDER BY flows DESC, sni LIMIT 20",
        "flow_capacity_topk": run + f" SELECT {KEY}, worker, first_packet_no FROM all_flows QUALIFY row_number() OVER (PARTITION BY worker ORDER BY last_ts DESC, first_packet_no DESC) <= {CAPACITY}",
        "active_flows": run + f" SELECT {KEY}, state FROM all_flows WHERE state <> 'CLOSED' AND {NOW}::DOUBLE - last_ts <= 86400",
        "ui_packet_filter": run + " SELECT id, src_ip, dst_ip, payload_summary FROM details WHERE (contains(src_ip, 'Google') OR contains(dst_ip, 'Google') OR contains(lower(payload_summary), 'google')) AND protocol = 'TCP' AND action = 'FORWARD' ORDER BY id LIMIT 100",
        "ui_flow_filter_sort": run + " SELECT id, bytes, application FROM flow_details WHERE contains(lower(application), 'apple') OR contains(client, 'APPLE') OR contains(server, 'APPLE')",
        "ui_domain_top5": run + " SELECT sni AS domain, packets AS count FROM flows WHERE sni <> '' AND contains(lower(sni), 'com') ORDER BY worker, first_packet_no LIMIT 5",
        "export_csv": run + " SELECT id, concat_ws(',', id, timestamp, src_ip, dst_ip, protocol, src_port, dst_port, length, action) AS line FROM details",
        "export_json": run + """ SELECT '{"application":"' || application || '","flows":' || count(*) || '}' AS json FROM flows GROUP BY application""",
        "export_top30": run + " SELECT client, server, packets, application, status FROM flow_details ORDER BY worker, first_packet_no LIMIT 30",
        "simple_scan": BASE + " SELECT count(*) AS packets, count(*) FILTER (load = 'tls') AS names FROM packets",
        "record_headers": BASE + f" SELECT packet_no, {' || '.join(_hex(v, True) for v in header)} AS little, {' || '.join(_hex(v, False) for v in header)} AS big FROM packets",
        "streamed_traffic": BASE + " SELECT ts_sec::BIGINT AS second, count(*) AS packets, sum(frame_length)::BIGINT AS bytes FROM report GROUP BY 1",
        "pcap_roundtrip": BASE + " SELECT frame_length AS incl_len, count(*) AS packets, sum(frame_length)::BIGINT AS bytes, sum(ts_sec)::BIGINT AS seconds, sum(ts_usec)::BIGINT AS micros, true AS same FROM packets GROUP BY 1",
        "filtered_capture": run + " SELECT count(*) AS packets, sum(frame_length)::BIGINT AS bytes, sum(ts_sec)::BIGINT AS seconds, true AS same FROM run WHERE action = 'FORWARD'",
        "first_packets": BASE + " SELECT row_number() OVER (ORDER BY packet_no) - 1 AS packet_no, ts_sec, ts_usec, frame_length AS incl_len FROM packets ORDER BY 1 LIMIT 100",
        "capture_set": run + " SELECT count(*) AS total_packets, count(*) FILTER (action = 'FORWARD') AS forwarded_packets, count(*) FILTER (action = 'DROP') AS dropped_packets, count(*) FILTER (action = 'FORWARD') AS written_packets, sum(frame_length) FILTER (action = 'FORWARD')::BIGINT AS written_bytes, true AS same FROM run",
        "summary_shown": run + " SELECT round(100.0::DOUBLE * count(*) FILTER (action = 'FORWARD') / count(*), 1) AS forward_rate, round(100.0::DOUBLE * count(*) FILTER (action = 'DROP') / count(*), 2) AS drop_rate, (SELECT round(arg_max(ts, packet_no) - arg_min(ts, packet_no), 2) FROM acted) AS duration FROM run",
    }
    own |= {f"stored_{name}": own[of] for name, of in (("flow_table", "flow_table"), ("graph_edges", "graph_edges"), ("summary", "summary_stats"))}
    # what a flow carries after each packet: its segment's finding from there on, before that what came with it
    now = f""", befores AS (SELECT {KEY}, seg, lag(app) OVER w AS app0, lag(sni) OVER w AS sni0 FROM segments WINDOW w AS (PARTITION BY {KEY} ORDER BY seg)
    ), now AS (SELECT r.*, CASE WHEN f IS NOT NULL AND packet_no >= f THEN seg_app ELSE coalesce(app0, 'Unknown') END AS app, CASE WHEN f IS NOT NULL AND packet_no >= f THEN seg_sni ELSE coalesce(sni0, '') END AS sni FROM run r JOIN befores USING ({KEY}, seg))"""
    return {name: sql.replace(" SELECT packet_no, action, seg, app, sni FROM now", now + " SELECT packet_no, action, seg, app, sni FROM now").replace(" SELECT packet_no, type, detail FROM (SELECT", now + " SELECT packet_no, type, detail FROM (SELECT") for name, sql in own.items()}
