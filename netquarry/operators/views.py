"""Searches, sorts and limits over an analysis' tables, as a dashboard asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packet_search(details: DataFrame, text: str = "", protocol: str = "all", action: str = "all", limit: int = 100) -> DataFrame:
    """The first packets whose address holds ``text`` or whose summary does in any case."""
    hit = F.contains("src_ip", F.lit(text)) | F.contains("dst_ip", F.lit(text)) | F.contains(F.lower("payload_summary"), F.lit(text.lower()))
    if protocol != "all":
        hit = hit & (F.lower("protocol") == protocol.lower())
    if action != "all":
        hit = hit & (F.col("action") == action)
    return details.where(hit).orderBy("id").limit(limit)


def flow_search(details: DataFrame, text: str = "", sort: str = "packets", descending: bool = True) -> DataFrame:
    """Flows whose client or server holds ``text``, or whose application does in any case, by packets, bytes or duration."""
    hit = F.contains("client", F.lit(text)) | F.contains("server", F.lit(text)) | F.contains(F.lower("application"), F.lit(text.lower()))
    return details.where(hit).orderBy(F.desc(sort) if descending else F.asc(sort), "worker", "first_packet_no")


def domain_search(domains: DataFrame, text: str = "", limit: int = 5) -> DataFrame:
    """The first names, in the flows' order, that hold ``text`` in any case."""
    return domains.where(F.contains(F.lower("domain"), F.lit(text.lower()))).orderBy("worker", "first_packet_no").limit(limit)


def edges_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("source") == node) | (F.col("target") == node))


def edge_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the types of their ends."""
    kind = nodes.select("id", "type")
    return edges.join(kind.select(F.col("id").alias("source"), F.col("type").alias("source_type")), "source").join(kind.select(F.col("id").alias("target"), F.col("type").alias("target_type")), "target")


def rows_of_map(applications: DataFrame) -> DataFrame:
    """The application map of a JSON report as rows."""
    return applications.select(F.explode("applications").alias("name", "value"))
