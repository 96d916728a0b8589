"""Directional flows: their state machines over many tasks, their table, and what is kept of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from netquarry.functions.codec import FIVE_TUPLE, epoch, hash_step, ip_number, worker_of
from netquarry.operators import machine
from netquarry.operators.rules import RuleSet

#: Packets of the capture in a chunk; a flow's packets in one chunk are sorted by one task.
SPAN = 1 << 22


def engine() -> Column:
    """Of parsed packets and their tuples those that the engine looks at: TCP and UDP."""
    return F.col("protocol").isin(6, 17)


def _judged(inspected: DataFrame, rules: RuleSet) -> DataFrame:
    """Packets with what the state machine reads of the flags and the rules."""
    return inspected.withColumns({
        "flags": F.when(F.col("has_tcp"), F.col("tcp_flags")).otherwise(0).cast("int"), "address_hit": rules.address_hit(F.col("src_ip"), F.col("dst_port")),
        "found_hit": F.when(F.col("found_app").isNull(), False).otherwise(rules.flow_hit(F.col("found_app"), F.coalesce("found_sni", F.lit("")))),
    })


def _dealt(packets: DataFrame, span: int, *order: str) -> DataFrame:
    """Packets by flow and chunk, so that a flow of any size lies over many tasks, sorted by flow and number."""
    return packets.withColumn("chunk", F.floor(F.col("packet_no") / span)).repartition(*FIVE_TUPLE, "chunk").sortWithinPartitions(*FIVE_TUPLE, "packet_no", *order)


def summaries(inspected: DataFrame, rules: RuleSet | None = None, span: int = SPAN, idle: float | None = None) -> DataFrame:
    """A row for each run of a flow's packets (those of one chunk, or fewer): counts, times, and the run as a function on the flow's few states (``machine``).

    A flow is an exact five-tuple, its packets in the order of ``packet_no``. Flags come first (RST closes, and so does every ACK once
    FIN was seen); a blocked flow drops; the first finding of a payload classifies a flow that isn't; then the rules
    decide by the packet's addresses and what the flow carries. A close undoes classification and block, not what is carried.

    Packets meet by flow and chunk, so the largest task has a chunk's packets. Summaries of ranges of packets that don't interleave can be
    stored and put together later, in any number; they hold under the rules that they were made with. A flow that is silent for more
    than ``idle`` seconds begins anew.
    """
    narrow = _judged(inspected, rules or RuleSet()).select(*FIVE_TUPLE, "packet_no", epoch(F.col("ts_sec"), F.col("ts_usec")).alias("ts"), "frame_length", "flags", "found_app", "found_sni", "found_hit", "address_hit")
    return _dealt(narrow, span).mapInArrow(machine.summed_up(idle), machine.SUMMARY)


def _by_flow(found: DataFrame, rules: RuleSet | None) -> tuple[DataFrame, int]:
    """Summaries by flow and in order, and the mode in which flows begin."""
    begin = machine.SPOILED if "Unknown" in (rules or RuleSet()).apps else machine.OPEN
    return found.repartition(*FIVE_TUPLE).sortWithinPartitions(*FIVE_TUPLE, "first_packet_no"), begin


def runs(found: DataFrame, rules: RuleSet | None = None, idle: float | None = None) -> DataFrame:
    """``summaries`` with the state in which each run begins, and so what the engine drops of it and what it carries. Only the summaries meet by flow, where they are composed."""
    met, begin = _by_flow(found, rules)
    return met.mapInArrow(machine.resolved(begin, idle), machine.RUN)


def tuples(found: DataFrame, rules: RuleSet | None = None, balancers: int = 2, workers: int = 2, idle: float | None = None) -> DataFrame:
    """One row for each five-tuple of ``summaries`` (and session, where there is a limit to silence), those of other protocols than TCP and UDP too: its flow's final state and its counts."""
    met, begin = _by_flow(found, rules)
    made = met.mapInArrow(machine.totals(begin, idle), machine.TOTAL)
    shaken = F.col("ack_at") >= F.greatest("syn_at", "synack_at")
    state = F.when(F.col("mode") == machine.BLOCKED, "BLOCKED").when(F.col("mode") == machine.CLASSIFIED, "CLASSIFIED").when(F.col("closes") > 0, "CLOSED").when(shaken, "ESTABLISHED").otherwise("NEW")
    made = made.select(
        *FIVE_TUPLE, "session", "packets", "bytes", "dropped", F.col("classified").alias("classified_events"), F.col("blocked").alias("blocked_events"), F.col("largest").cast("int").alias("largest"), "first_packet_no", "last_no", "first_ts", "last_ts",
        state.alias("state"), F.coalesce("app", F.lit("Unknown")).alias("application"), F.coalesce("sni", F.lit("")).alias("sni"),
    )
    return with_worker(made, balancers, workers)


def sessions(inspected: DataFrame, rules: RuleSet | None = None, idle: float = 300.0, span: int = SPAN) -> DataFrame:
    """The flows that a capture's own time ends: one row for each five-tuple and ``session``, the number of the packet with which it began after more than ``idle`` seconds of silence.

    A silent flow is forgotten with its state, block and name, as a sweep of idle flows would do while packets still come. Silences are found within
    runs where the packets are, and between runs where these are put together.
    """
    return tuples(summaries(inspected, rules, span, idle), rules, idle=idle)


def flow_table(found: DataFrame) -> DataFrame:
    """The flows of ``tuples``. Counts of a flow all go out, as its key is directional."""
    return found.where(engine()).select(*FIVE_TUPLE, "state", "application", "sni", "packets", "bytes", "first_packet_no", "first_ts", "last_ts", "classified_events", "blocked_events", "worker")


def run_flows(inspected: DataFrame, rules: RuleSet | None = None, span: int = SPAN) -> DataFrame:
    """Adds ``action, seg, app, sni, classified``: each accepted packet's fate, and what its flow carries after it.

    The states in which runs begin are sent to the runs' packets, which are then gone through from there.
    """
    rules = rules or RuleSet()
    entries = runs(summaries(inspected, rules, span), rules).select(*FIVE_TUPLE, F.col("first_packet_no").alias("packet_no"), "entry", "entry_seg", "entry_app", "entry_sni")
    both = _judged(inspected, rules).unionByName(entries, allowMissingColumns=True).withColumn("is_packet", F.col("entry").isNull())
    keep = [c for c in inspected.columns if c not in ("action", "seg", "app", "sni", "classified")]
    schema = T.StructType([*(inspected.schema[c] for c in keep), *T.StructType.fromDDL(machine.REPLAYED).fields])
    return _dealt(both, span, "is_packet").mapInArrow(machine.replayed(keep), schema)


def with_hash(rows: DataFrame, name: str = "hash") -> DataFrame:
    """Adds the 64-bit hash of the directional five-tuple, a step at a time, so that the expression stays small."""
    parts = (ip_number(F.col("src_ip")), ip_number(F.col("dst_ip")), F.col("src_port").bitwiseAND(0xFFFF).cast("long"), F.col("dst_port").bitwiseAND(0xFFFF).cast("long"), F.col("protocol").bitwiseAND(0xFF).cast("long"))
    folded = F.aggregate(F.array(*parts), F.lit(0).cast("long"), hash_step)
    return rows.withColumn(name, folded)


def with_worker(rows: DataFrame, balancers: int = 2, workers: int = 2) -> DataFrame:
    return with_hash(rows, "tuple_hash").withColumn("worker", worker_of(F.col("tuple_hash"), balancers, workers)).drop("tuple_hash")


def visible(flows: DataFrame, include_closed: bool = False) -> DataFrame:
    """The flows that reports see: closed ones are swept before a report is made."""
    return flows if include_closed else flows.where("state <> 'CLOSED'")


def newest(flows: DataFrame, capacity: int) -> DataFrame:
    """Of each worker the ``capacity`` flows seen last; the oldest go first."""
    return flows.withColumn("age", F.row_number().over(Window.partitionBy("worker").orderBy(F.desc("last_ts"), F.desc("first_packet_no")))).where(F.col("age") <= capacity).drop("age")


def alive(flows: DataFrame, now: float, timeout: float = 300.0) -> DataFrame:
    """Flows that are neither closed nor idle for longer than ``timeout`` seconds at ``now``."""
    return flows.where((F.col("state") != "CLOSED") & (F.lit(now) - F.col("last_ts") <= timeout))
