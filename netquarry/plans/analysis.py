"""An analysis of captured packets as lazy tables over one decoded, inspected table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.codec import be
from netquarry.operators import flows as flow_ops
from netquarry.operators import report
from netquarry.operators.decode import decode, engine_packets, headers, report_packets
from netquarry.operators.inspection import inspected
from netquarry.operators.rules import RuleSet
from netquarry.sources import pcap
from netquarry.sources.files import cut
from netquarry.synth import sample_packets

#: Bitmaps (4 KB each, for 32,768 packets) that are broadcast at most.
MOST_BITMAPS = 16_384


@dataclass
class Analysis:
    """Tables of one set of raw packets under one set of rules; nothing runs before a table is used.

    ``packet_no`` of ``raw`` is unique over all its captures and gives their order.
    """

    raw: DataFrame
    rules: RuleSet = field(default_factory=RuleSet)
    balancers: int = 2
    workers: int = 2
    include_closed: bool = False
    exact: bool = False
    pieces: DataFrame | None = None  # of the captures that ``raw`` is read from

    @cached_property
    def packets(self) -> DataFrame:
        """All packets with their bytes and payloads."""
        return decode(self.raw)

    @cached_property
    def inspected(self) -> DataFrame:
        """All packets as decoded and inspected in one pass, without their bytes, which no shuffle carries."""
        return inspected(self.raw)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Analysis:
        """Keeps the decoded packets (about a tenth of the bytes) and the flows' tables once they are made, so that the next tables don't read the captures again."""
        self.reported = report_packets(self.inspected.persist(level))
        self.tuples.persist(level)
        return self

    @classmethod
    def from_summaries(cls, summaries: DataFrame, rules: RuleSet | None = None, **options) -> Analysis:
        """An analysis of packets that were summed up before, range by range, under the same rules: totals, flows, names and the graph, but no table of packets."""
        made = cls(None, rules or RuleSet(), **options)
        made.summaries = summaries
        return made

    def unpersist(self) -> None:
        self.inspected.unpersist()
        self.tuples.unpersist()

    @cached_property
    def reported(self) -> DataFrame:
        """Report packets as decoded, for the tables that need packets but no names."""
        return report_packets(headers(self.raw))

    @cached_property
    def run(self) -> DataFrame:
        """Accepted packets with the engine's action."""
        return flow_ops.run_flows(engine_packets(self.inspected), self.rules)

    @cached_property
    def tuples(self) -> DataFrame:
        """A row for each five-tuple of the report's packets: what all tables of flows and addresses are made of."""
        return flow_ops.tuples(self.summaries, self.rules, self.balancers, self.workers)

    @cached_property
    def summaries(self) -> DataFrame:
        """The flows' runs, which can be stored by range of packets; ``from_summaries`` makes the flows' tables of them."""
        return flow_ops.summaries(report_packets(self.inspected), self.rules)

    @cached_property
    def all_flows(self) -> DataFrame:
        return flow_ops.flow_table(self.tuples)

    @cached_property
    def flows(self) -> DataFrame:
        return flow_ops.visible(self.all_flows, self.include_closed)

    @cached_property
    def judged(self) -> DataFrame:
        return report.verdicts(self.tuples, self.rules, self.include_closed, self.exact)

    @cached_property
    def acted(self) -> DataFrame:
        """Report packets with their flow's attributes and the report's action."""
        return report.act(self.reported, self.judged)

    @cached_property
    def summary(self) -> DataFrame:
        return report.summary(self.tuples, self.rules)

    @property
    def timeline(self) -> DataFrame:
        return report.timeline(self.reported, self.judged)

    @property
    def details(self) -> DataFrame:
        return report.packet_details(report.act(report_packets(headers(self.raw, ())), self.judged))

    @property
    def flow_details(self) -> DataFrame:
        return report.flow_details(self.flows)

    @property
    def worker_load(self) -> DataFrame:
        return report.worker_load(self.tuples, self.balancers, self.workers)

    def with_action(self, action: str = "FORWARD") -> DataFrame:
        """Raw packets to which the engine gave ``action``, as they lie in their captures.

        The verdicts become bitmaps by packet number, a bit a packet. Of captures each piece gets its bitmaps and is read again by them, in order,
        so no frame is shuffled. Other packets meet the bitmaps in a join by bucket: these are broadcast if they are few.
        """
        bitmaps = pcap.passing_bitmaps(self.run.where(F.col("action") == action).select("packet_no"))
        if self.pieces is not None:
            return pcap.read_pieces(pcap.dealt_in_order(pcap.with_bitmaps(self.pieces, bitmaps), self.pieces))
        bitmaps = cut(bitmaps)
        if bitmaps.limit(MOST_BITMAPS + 1).count() <= MOST_BITMAPS:
            bitmaps = F.broadcast(bitmaps)
        at = F.col("packet_no") + 1
        place = F.bitmap_bit_position(at)
        passes = F.getbit(be(F.col("bits"), F.floor(place / 8), 1), place % 8) == 1
        return self.raw.withColumn("bucket", F.bitmap_bucket_number(at)).join(bitmaps, "bucket").where(passes).select(*self.raw.columns)

    def forwarded(self) -> DataFrame:
        """Raw packets that the engine lets pass."""
        return self.with_action()

    def write_capture(self, path: str, byteorder: str = "little", snaplen: int = 65_535, file_bytes: int = pcap.FILE_BYTES) -> None:
        """The passing packets as captures in the folder ``path``: one for each task at least and as many as their size asks for, file order being packet order. Captures are filtered piece by piece; packets from elsewhere are sorted first."""
        pcap.register(self.raw.sparkSession)
        passing = self.forwarded()
        if self.pieces is None:
            passing = passing.repartitionByRange("packet_no").sortWithinPartitions("packet_no")
        passing.write.format("pcap").option("byteorder", byteorder).option("snaplen", snaplen).option("filebytes", file_bytes).mode("overwrite").save(path)

    def each_batch(self, output: Callable[[DataFrame, str], None]) -> None:
        """Gives the raw packets of each action to ``output(packets, action)``, as a hook for sinks of one's own."""
        for action in ("FORWARD", "DROP"):
            output(self.with_action(action), action)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "stats": self.summary, "packets": self.details, "flows": self.flow_details, "applications": report.app_distribution(self.flows), "domains": report.domains(self.flows),
            "timeline": self.timeline, "nodes": report.graph_nodes(self.tuples, self.flows), "edges": report.graph_edges(self.tuples, self.flows),
        }


def analyze(spark: SparkSession, path: str, rules: RuleSet | None = None, **options) -> Analysis:
    """An analysis of the captures at ``path`` (one file, a glob or a folder), taken as one capture in the order of their names."""
    pieces = pcap.capture_pieces(spark, path, **({"piece_bytes": options.pop("piece_bytes")} if "piece_bytes" in options else {}))
    return Analysis(pcap.read_pieces(pcap.dealt(pieces)), rules or RuleSet(), pieces=pieces, **options)


def analyze_sample(spark: SparkSession, rules: RuleSet | None = None, **options) -> Analysis:
    """An analysis of the package's own sample of 77 packets."""
    return Analysis(sample_packets(spark), rules or RuleSet(), **options)
