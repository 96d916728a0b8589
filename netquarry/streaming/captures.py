"""Streams of packets: flow state in event time, and one-second windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netquarry.functions.codec import FIVE_TUPLE, epoch
from netquarry.operators import machine
from netquarry.operators.rules import RuleSet

FLOW_SCHEMA = f"{machine.TUPLE}, session bigint, packets bigint, bytes bigint, dropped bigint, first_ts double, last_ts double, forwarded bigint, application string, sni string, state string"
#: Parts into which flows are dealt by a hash: the packets of a part that a micro-batch brings are taken at once.
BUCKETS = 128
_WAITING = f"{machine.TUPLE}, packet_no bigint, ts double, frame_length bigint, flags int, found_hit boolean, address_hit boolean, found_app string, found_sni string"
_PACKET = machine.arrow_schema(_WAITING)
#: What is known of a flow between packets: its session's counts so far, and whether a FIN was seen in it.
_FLOW = machine.arrow_schema(f"{machine.TOTAL}, fin boolean")


def _stored(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _loaded(state, schema: pa.Schema) -> pa.Table:
    found = state.get()
    return pa.ipc.open_stream(bytes(found[0])).read_all() if found else schema.empty_table()


def _batch(rows: pa.Table) -> pa.RecordBatch:
    return rows.combine_chunks().to_batches()[0]


def advanced(flows: pa.Table, packets: pa.Table, begin: int, idle: float) -> tuple[pa.Table, pa.Table]:
    """All flows after some more packets, and a row for each session that these advance.

    packets: at least one, by flow and in order. They are summed up as runs and composed after the flows' states, as the batch does it.
    """
    new = next(machine.summed_up(idle)(iter([_batch(packets.append_column("chunk", pa.array(np.zeros(len(packets), np.int64))))])))
    before = machine.as_runs(flows).append_column("old", pa.array(np.ones(len(flows), bool))) if len(flows) else None
    now = pa.Table.from_batches([new]).append_column("old", pa.array(np.zeros(new.num_rows, bool)))
    runs = now if before is None else pa.concat_tables([before, now.select(before.column_names)])
    order = [(c, "ascending") for c in FIVE_TUPLE]
    # a session so far stands before the packets that come after it, whatever their numbers
    runs = _batch(runs.append_column("at", pc.if_else(runs["old"], pa.scalar(-1, pa.int64()), runs["first_packet_no"])).sort_by([*order, ("old", "descending"), ("at", "ascending")]))
    run = next(machine.resolved(begin, idle)(iter([runs])))
    total, starts = machine.added_up(run)
    old = run.column("old").to_numpy(zero_copy_only=False)
    after = pa.Table.from_batches([total]).append_column("fin", pa.array(np.logical_or.reduceat(run.column("fin").to_numpy(zero_copy_only=False), starts)))
    if before is not None:  # what was counted before
        rank = np.cumsum(old) - 1
        known, flows = np.flatnonzero(old[starts]), flows.sort_by(order)
        for c in machine.COUNTED:
            sums = after[c].to_numpy().copy()
            sums[known] += flows[c].to_numpy()[rank[starts[known]]]
            after = after.set_column(after.schema.get_field_index(c), c, pa.array(sums))
    ends = np.r_[starts[1:], len(old)]
    touched = ~(old[starts] & (ends - starts == 1))
    last = machine.changes([total.column(c) for c in FIVE_TUPLE])
    after = after.select(_FLOW.names)
    return after.filter(pa.array(np.r_[last[1:], True])), after.filter(pa.array(touched))


class FlowState(StatefulProcessor):
    """Counts, classification and block of the flows of a bucket so far, as the batch has them.

    Packets wait until the watermark has passed them and are then taken in the order of their numbers, whatever batches they came in.
    A flow that is silent for more than ``idle`` seconds of the packets' time begins anew, and is forgotten once the watermark has passed that.
    The state of a bucket is that of its flows and packets, as Arrow tables, so a micro-batch costs a few calls a bucket and none a flow.
    """

    def __init__(self, idle: float, unknown_bad: bool):
        self.idle, self.begin = idle, machine.SPOILED if unknown_bad else machine.OPEN

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flows, self.waiting = handle.getValueState("flows", "rows binary"), handle.getValueState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        return self._taken([pa.Table.from_pandas(df[_PACKET.names], _PACKET, preserve_index=False) for df in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._taken([], timerValues.getCurrentWatermarkInMs())

    def _taken(self, new: list[pa.Table], watermark: int) -> Iterator[pd.DataFrame]:
        flows, rows, touched = _loaded(self.flows, _FLOW), pa.concat_tables([_loaded(self.waiting, _PACKET), *new]), None
        if len(rows):
            rows = rows.sort_by([(c, "ascending") for c in (*FIVE_TUPLE, "packet_no")]).combine_chunks()
            since = machine.begun(machine.changes([rows[c].combine_chunks() for c in FIVE_TUPLE]))
            not_yet = rows["ts"].to_numpy() * 1000 >= watermark
            waits = np.maximum.accumulate(np.where(not_yet, np.arange(len(rows)), -1)) >= since  # a packet waits for those before it
            ready, rows = rows.filter(pa.array(~waits)), rows.filter(pa.array(waits))
            if len(ready):
                flows, touched = advanced(flows, ready, self.begin, self.idle)
        flows = flows.filter(pa.array((flows["last_ts"].to_numpy() + self.idle) * 1000 >= watermark)) if len(flows) else flows
        due = [int(rows["ts"].to_numpy()[machine.changes([rows[c].combine_chunks() for c in FIVE_TUPLE])].min() * 1000) + 1] if len(rows) else []
        due += [int((pc.min(flows["last_ts"]).as_py() + self.idle) * 1000) + 2] if len(flows) else []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for state, kept in ((self.flows, flows), (self.waiting, rows)):
            if len(kept):
                state.update((_stored(kept.combine_chunks()),))
            else:
                state.clear()
        if due:
            self.handle.registerTimer(max(min(due), watermark + 1))
        if touched is not None and len(touched):
            yield self._rows(touched)

    def _rows(self, found: pa.Table) -> pd.DataFrame:
        f = found.to_pandas()
        shaken = f.ack_at >= np.maximum(f.syn_at, f.synack_at)
        f["state"] = np.select([f["mode"] == machine.BLOCKED, f["mode"] == machine.CLASSIFIED, f.closes > 0, shaken], ["BLOCKED", "CLASSIFIED", "CLOSED", "ESTABLISHED"], "NEW").astype(object)
        f["application"], f["sni"], f["forwarded"] = f.app.where(f.app.notna(), "Unknown"), f.sni.where(f.sni.notna(), ""), f.packets - f.dropped
        return f[[c.split()[0] for c in FLOW_SCHEMA.split(", ")]]

    def close(self) -> None:
        pass


def _timed(packets: DataFrame, late: str) -> DataFrame:
    return packets.withColumn("at", F.timestamp_micros(F.col("ts_sec") * F.lit(1_000_000).cast("long") + F.col("ts_usec"))).withWatermark("at", late)


def flow_updates(inspected: DataFrame, rules: RuleSet | None = None, idle: float = 300.0, late: str = "10 seconds", where: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A row for each flow and session that the stream's packets advance, with the engine's verdicts under ``rules``. Needs the RocksDB state store.

    Packets may come up to ``late`` out of the order of their times; within that the last row of a session is the batch's, see ``flows.sessions``.
    ``where`` picks the packets that count after all of them have moved the watermark. Flows are dealt to ``buckets`` by a hash; a stream keeps that number.
    """
    rules = rules or RuleSet()
    wanted = _timed(inspected, late)
    if where is not None:
        wanted = wanted.where(F.when(F.col("at").isNotNull(), where))  # names the time, so that it isn't done before the watermark
    wanted = wanted.select(
        *FIVE_TUPLE, F.pmod(F.xxhash64(*FIVE_TUPLE), F.lit(buckets)).cast("int").alias("bucket"), "at", "packet_no", epoch(F.col("ts_sec"), F.col("ts_usec")).alias("ts"), F.col("frame_length").cast("long").alias("frame_length"), F.when(F.col("has_tcp"), F.col("tcp_flags")).otherwise(0).cast("int").alias("flags"),
        F.when(F.col("found_app").isNull(), False).otherwise(rules.flow_hit(F.col("found_app"), F.coalesce("found_sni", F.lit("")))).alias("found_hit"), rules.address_hit(F.col("src_ip"), F.col("dst_port")).alias("address_hit"), "found_app", "found_sni",
    )
    return wanted.groupBy("bucket").transformWithStateInPandas(FlowState(idle, "Unknown" in rules.apps), FLOW_SCHEMA, "Update", "EventTime")


def traffic(packets: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Packets and bytes of each second. In append mode a second is given once the watermark has passed it and then leaves the state; packets that are later than ``late`` and than that don't count."""
    return _timed(packets, late).groupBy(F.window("at", "1 second")).agg(F.count("frame_length").alias("packets"), F.sum("frame_length").alias("bytes"))
