"""Reports as JSON, CSV, HTML and console text."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.operators import report

# The CSV header.
CSV_HEADER = "Packet ID,Timestamp,Source IP,Destination IP,Protocol,Source Port,Destination Port,Length,Action"


def csv_lines(details: DataFrame) -> DataFrame:
    """A line for each packet, without quoting."""
    return details.select("id", F.concat_ws(",", *(F.col(c).cast("string") for c in ("id", "timestamp", "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "length", "action"))).alias("line"))


def json_rows(table: DataFrame) -> DataFrame:
    return table.select(F.to_json(F.struct(*table.columns)).alias("json"))


def write_json(analysis, path: str) -> None:
    """Each table of an analysis in a folder of its own below ``path``."""
    for name, table in analysis.tables().items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def write_csv(details: DataFrame, path: str) -> None:
    csv_lines(details).orderBy("id").select("line").write.mode("overwrite").text(path)


def first_flows(flow_details: DataFrame, n: int = 30) -> DataFrame:
    return flow_details.orderBy("worker", "first_packet_no").limit(n)


# The labels of the HTML page.
HTML_TOTALS = (("Total Packets", "total_packets"), ("Total Bytes", "total_bytes"), ("Forwarded", "forwarded_packets"), ("Dropped/Blocked", "dropped_packets"))
HTML_COLUMNS = ("Client", "Server", "Protocol", "Duration (s)", "Packets", "App", "Status")


def html_page(summary: DataFrame, flow_details: DataFrame) -> str:
    """A page with the totals and the first 30 flows."""
    s, flows = summary.first(), flow_details.count()
    items = (*((label, s[name]) for label, name in HTML_TOTALS), ("Active Flows", flows))
    rows = [(f.client, f.server, f.protocol, f"{f.duration:.2f}", f.packets, f.application, f.status) for f in first_flows(flow_details).collect()]
    cells = lambda values, tag: "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values)
    return "\n".join([
        "<!DOCTYPE html>", "<html><head><title>Packet report</title></head><body>", "<h1>Packet report</h1>", "<ul>", *(f"<li>{k}: {v}</li>" for k, v in items), "</ul>",
        "<table>", f"<tr>{cells(HTML_COLUMNS, 'th')}</tr>", *(f"<tr>{cells(r, 'td')}</tr>" for r in rows), "</table></body></html>",
    ])


def export(analysis, fmt: str, path: str) -> None:
    """Writes an analysis to ``path`` as ``json`` (a folder for each table), ``csv`` (a line a packet) or ``html`` (one page). Raises ValueError for other formats."""
    if fmt == "json":
        write_json(analysis, path)
    elif fmt == "csv":
        write_csv(analysis.details, path)
    elif fmt == "html":
        page = html_page(analysis.summary, analysis.flow_details)
        analysis.raw.sparkSession.createDataFrame([(page,)], "page string").coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: json, csv or html")


def _listed(pairs) -> list[str]:
    return [f"{k:<24}{v}" for k, v in pairs]


def engine_report(analysis) -> list[str]:
    """Totals, rules, and what each worker forwards and drops."""
    s = analysis.summary.first()
    lines = _listed((("packets", s.total_packets), ("bytes", s.total_bytes), ("TCP", s.tcp_packets), ("UDP", s.udp_packets), ("forwarded", s.forwarded_packets), ("dropped", f"{s.dropped_packets} ({s.drop_rate:.2f}%)")))
    lines += _listed(analysis.rules.stats().items())
    return lines + [f"worker {r.worker:<17}{r.processed} packets, {r.forwarded} forwarded, {r.dropped} dropped, {r.flows} flows" for r in analysis.worker_load.orderBy("worker").collect()]


def classification_report(analysis) -> list[str]:
    """How many flows are classified, and the applications with their shares."""
    rows = report.classification(analysis.flows).collect()
    total = sum(r.flows for r in rows)
    share = lambda n: f"{n} ({100 * n / total if total else 0:.1f}%)"
    classified = rows[0].classified if rows else 0
    return _listed((("flows", total), ("classified", share(classified)), ("unidentified", share(total - classified)))) + [f"{r.application:<20}{r.flows:>8} {r.percent:5.1f}% {r.bar}" for r in rows]


def connection_report(analysis) -> list[str]:
    """Active and seen flows, and the names that most of them carry."""
    t = report.tracker_stats(analysis.all_flows).first()
    lines = _listed((("active connections", t.active_connections), ("connections seen", t.total_connections_seen), ("classified", t.classified), ("blocked", t.blocked)))
    return lines + [f"{r.shown:<40}{r.flows:>8}" for r in report.top_domains(analysis.flows).collect()]


def console(analysis) -> str:
    """The three reports as plain text."""
    parts = (("Engine", engine_report), ("Applications", classification_report), ("Connections", connection_report))
    return "\n\n".join("\n".join([title, "-" * len(title), *made(analysis)]) for title, made in parts)


def json_text(rows: DataFrame) -> str:
    """A small table as one JSON array."""
    return json.dumps([json.loads(r.json) for r in json_rows(rows).toLocalIterator()])
