"""The flow state machine as functions on its few modes, so that runs of a flow's packets can be summed up apart and put together.

Between packets a flow is OPEN (nothing found since it began or closed), CLASSIFIED or BLOCKED; SPOILED is an open flow whose
carried finding a rule hits. A packet is a function on these four modes: a byte, two bits for each image. A
run of packets is a byte too, composed by table lookup. Closes depend on whether a FIN came before, so a run has one byte for each case,
and what it counts and carries is known for each of the eight states in which it can begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from netquarry.functions.codec import ACK, FIN, FIVE_TUPLE, RST, SYN

OPEN, CLASSIFIED, BLOCKED, SPOILED = range(4)
STATES = 8  # a mode, and 4 more once a FIN was seen
NEVER = np.iinfo(np.int64).max


def moved(mode: int, close: bool, found: bool, hit: bool, address: bool) -> int:
    """The mode after a packet: flags first, then its finding if the flow has none, then the rules."""
    if close:
        mode = OPEN if mode in (OPEN, CLASSIFIED) else SPOILED
    if mode in (OPEN, SPOILED) and found:
        mode = BLOCKED if hit else CLASSIFIED
    return BLOCKED if address or mode == SPOILED else mode


def _packed(images) -> int:
    return sum(image << 2 * mode for mode, image in enumerate(images))


def image(function: np.ndarray, mode) -> np.ndarray:
    return function >> np.asarray(mode, np.uint8) * np.uint8(2) & np.uint8(3)


STEP = np.array([_packed(moved(m, bool(i & 1), bool(i & 2), bool(i & 4), bool(i & 8)) for m in range(4)) for i in range(16)], np.uint8)
CONSTANT = np.array([_packed([m] * 4) for m in range(4)], np.uint8)
_ALL = np.arange(256, dtype=np.uint8)
#: COMPOSE[g, f]: first f, then g.
COMPOSE = sum(image(_ALL[:, None], image(_ALL, m)) << np.uint8(2 * m) for m in range(4)).astype(np.uint8)


def composed(functions: np.ndarray, age: np.ndarray) -> np.ndarray:
    """Of each row the composition of its group's functions up to it, by doubling; ``age`` is a row's place in its group."""
    out, step, most = functions.copy(), 1, int(age.max(initial=0))
    while step <= most:
        at = np.flatnonzero(age >= step)
        out[at] = COMPOSE[out[at], out[at - step]]
        step *= 2
    return out


def changes(columns: list[pa.Array]) -> np.ndarray:
    """True at each row that differs from the one before it, and at the first. Nulls are equal."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.not_equal(a, b)
        if c.null_count:
            differ = pc.or_(differ.fill_null(False), pc.xor(a.is_null(), b.is_null()))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return new


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def begun(new: np.ndarray) -> np.ndarray:
    """The first row of each row's group."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, size = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


NAMES = "array<struct<no: bigint, app: string, sni: string>>"
_COUNTS = "packets bigint, bytes bigint, largest int, first_packet_no bigint, last_no bigint, first_ts double, last_ts double, fin boolean, syn_at bigint, synack_at bigint, ack_at bigint"
TUPLE = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int"
SUMMARY = f"{TUPLE}, {_COUNTS}, machine binary, names {NAMES}"
#: Bytes of ``machine``: packets dropped, classified and blocked anew and closes for each state, the place of what is carried among the names, and the two functions.
_MACHINE = np.dtype([("counts", "<i4", (STATES, 4)), ("carried", "i1", STATES), ("functions", "u1", 2)])


def summed_up(idle: float | None = None):
    """A row for each run of sorted packets that belong to one flow and stand in one batch; a silence of more than ``idle`` seconds ends a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _summed_up(batch, idle)

    return run


def _summed_up(batch: pa.RecordBatch, idle: float | None) -> pa.RecordBatch:
    n, at = batch.num_rows, np.arange(batch.num_rows)
    new = changes([batch.column(c) for c in (*FIVE_TUPLE, "chunk")])
    if idle is not None:
        new[1:] |= np.diff(_numpy(batch, "ts")) > idle
    starts, since = np.flatnonzero(new), begun(new)
    ends = np.r_[starts[1:], n] - 1
    flags, number, size = _numpy(batch, "flags"), _numpy(batch, "packet_no"), _numpy(batch, "frame_length")
    found, hit, address = batch.column("found_app").is_valid().to_numpy(zero_copy_only=False), _numpy(batch, "found_hit"), _numpy(batch, "address_hit")
    fin, ack, rst = flags & FIN != 0, flags & ACK != 0, flags & RST != 0
    finned = np.maximum.accumulate(np.where(fin, at, -1)) >= since
    machine, carried = np.zeros(len(starts), _MACHINE), np.empty((len(starts), STATES), np.int64)
    for case, close in enumerate((rst | ack & finned, rst | ack)):
        after = composed(STEP[close | found << 1 | hit << 2 | address << 3], at - since)
        machine["functions"][:, case] = after[ends]
        before = np.r_[after[:1], after[:-1]]
        before[starts] = _packed(range(4))
        for mode in range(4):
            was, dropped = image(before, mode), image(after, mode) == BLOCKED
            classified = found & (close | (was == OPEN) | (was == SPOILED))
            for i, what in enumerate((dropped, classified, dropped & (close | (was != BLOCKED)), close)):
                machine["counts"][:, 4 * case + mode, i] = np.add.reduceat(what, starts, dtype=np.int32)
            carried[:, 4 * case + mode] = np.maximum.reduceat(np.where(classified, at, -1), starts)
    ordered = np.sort(carried, axis=1)
    distinct = (ordered >= 0) & np.c_[np.ones(len(starts), bool), ordered[:, 1:] != ordered[:, :-1]]
    machine["carried"] = np.where(carried < 0, -1, (distinct[:, None, :] & (ordered[:, None, :] < carried[:, :, None])).sum(axis=2))
    flat = pa.array(ordered[distinct])
    names = pa.StructArray.from_arrays([batch.column(c).take(flat) for c in ("packet_no", "found_app", "found_sni")], ["no", "app", "sni"])
    first = lambda what: np.minimum.reduceat(np.where(what, number, NEVER), starts)
    ts, syn = _numpy(batch, "ts"), flags & SYN != 0
    made = {
        **{c: batch.column(c).take(pa.array(starts)) for c in FIVE_TUPLE}, "packets": pa.array(ends - starts + 1), "bytes": pa.array(np.add.reduceat(size, starts, dtype=np.int64)), "largest": pa.array(np.maximum.reduceat(size, starts), pa.int32()),
        "first_packet_no": pa.array(number[starts]), "last_no": pa.array(number[ends]), "first_ts": pa.array(ts[starts]), "last_ts": pa.array(ts[ends]), "fin": pa.array(np.logical_or.reduceat(fin, starts)),
        "syn_at": pa.array(first(syn & ~ack)), "synack_at": pa.array(first(syn & ack)), "ack_at": pa.array(np.maximum.reduceat(np.where(ack, number, -1), starts)),
        "machine": _binary(machine.view(np.uint8).reshape(len(starts), -1)), "names": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(distinct.sum(axis=1))], pa.int32()), names),
    }
    return pa.record_batch(made)


RUN = f"{TUPLE}, {_COUNTS}, dropped bigint, classified bigint, blocked bigint, closes bigint, mode int, carried_no bigint, app string, sni string, session bigint, entry int, entry_seg bigint, entry_app string, entry_sni string"


def resolved(begin: int, idle: float | None = None):
    """Runs with the state in which each begins, and so what it counts and carries. Runs of a flow follow each other; only a state is kept between batches.

    begin: the mode in which flows begin; idle: the seconds of silence after which a flow begins anew. ``session`` is the number of its first packet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None  # the flow that the last batch ended with, its state, closes, what it carries, last time and session
        for batch in batches:
            if not batch.num_rows:
                continue
            n, at = batch.num_rows, np.arange(batch.num_rows)
            new, machine = changes([batch.column(c) for c in FIVE_TUPLE]), np.frombuffer(b"".join(batch.column("machine").to_pylist()), _MACHINE)
            goes_on = kept is not None and kept[0] == _key(batch, 0)
            if idle is not None:
                first_ts, last_ts = _numpy(batch, "first_ts"), _numpy(batch, "last_ts")
                new[1:] |= first_ts[1:] - last_ts[:-1] > idle
                goes_on = goes_on and first_ts[0] - kept[4] <= idle
            since = begun(new)
            fin = _numpy(batch, "fin")
            states = np.stack([image(machine["functions"][:, s >> 2], s & 3) + 4 * (fin | (s > 3)) for s in range(STATES)], axis=1).astype(np.uint8)
            after, age, step = states, at - since, 1
            while step <= age.max():
                some = np.flatnonzero(age >= step)
                after = after.copy()
                after[some] = np.take_along_axis(after[some], after[some - step], axis=1)
                step *= 2
            initial = np.full(n, begin)
            if goes_on:
                initial[since == 0] = kept[1]
            entry = np.where(new, initial, after[at - 1, initial])
            counts = machine["counts"][at, entry].astype(np.int64)
            place = machine["carried"][at, entry].astype(np.int64)
            names, offsets = batch.column("names").flatten(), batch.column("names").offsets.to_numpy()
            carries = place >= 0
            picked = names.take(pa.array(np.where(carries, offsets[:-1] - offsets[0] + place, 0), mask=~carries))
            # what is carried in and the closes before: from the last run of the flow that carries, or from the last batch
            last = np.maximum.accumulate(np.where(carries, at, -1))
            before = np.r_[-1, last[:-1]]
            from_here, from_kept = (before >= since) & ~new, goes_on & (since == 0) & ~((before >= 0) & ~new)
            closes = np.cumsum(counts[:, 3])
            entry_seg = closes - counts[:, 3] - (closes - counts[:, 3])[since] + (np.where(since == 0, kept[2], 0) if goes_on else 0)
            texts = {}
            for i, c in enumerate(("app", "sni")):
                values = pc.if_else(pa.array(carries), picked.field(c), pa.scalar(None, pa.string()))
                come = values.take(pa.array(before, mask=~from_here))
                texts[c], texts[f"entry_{c}"] = values, pc.if_else(pa.array(from_kept), pa.scalar(kept[3][i] if goes_on else None, pa.string()), come)
            end = machine["functions"][at, entry >> 2]
            mode = image(end, entry & 3)
            number = pc.if_else(pa.array(carries), picked.field("no"), pa.scalar(None, pa.int64()))
            carried_out = [texts[c][n - 1].as_py() if carries[-1] else texts[f"entry_{c}"][n - 1].as_py() for c in ("app", "sni")]
            session = _numpy(batch, "first_packet_no")[since]
            if goes_on:
                session = np.where(since == 0, kept[5], session)
            kept = (_key(batch, n - 1), int(mode[-1]) + 4 * bool(fin[-1] or entry[-1] > 3), int(entry_seg[-1] + counts[-1, 3]), carried_out, batch.column("last_ts")[n - 1].as_py(), int(session[-1]))
            made = {f.name: batch.column(f.name) for f in batch.schema if f.name not in ("machine", "names")}
            made |= {name: pa.array(counts[:, i]) for i, name in enumerate(("dropped", "classified", "blocked", "closes"))}
            made |= {"mode": pa.array(mode, pa.int32()), "carried_no": number, "app": texts["app"], "sni": texts["sni"], "session": pa.array(session, pa.int64()), "entry": pa.array(entry, pa.int32()), "entry_seg": pa.array(entry_seg, pa.int64()), "entry_app": texts["entry_app"], "entry_sni": texts["entry_sni"]}
            yield pa.record_batch(made)

    return run


_SUMS, _LEAST, _MOST = ("packets", "bytes", "dropped", "classified", "blocked", "closes"), ("first_packet_no", "syn_at", "synack_at"), ("largest", "ack_at")
_LAST, _NAMES = ("last_no", "last_ts", "mode"), ("app", "sni")
TOTAL = f"{TUPLE}, session bigint, packets bigint, bytes bigint, dropped bigint, classified bigint, blocked bigint, closes bigint, first_packet_no bigint, syn_at bigint, synack_at bigint, largest bigint, ack_at bigint, last_no bigint, last_ts double, mode int, first_ts double, app string, sni string"
#: Counts of a total that its runs' functions give.
COUNTED = ("dropped", "classified", "blocked", "closes")


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


_TOTAL = arrow_schema(TOTAL)


def totals(begin: int, idle: float | None = None):
    """A row for each flow, or session of one: what its runs add up to. As these follow each other, one unfinished row is all that is kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: pa.RecordBatch | None = None
        for batch in resolved(begin, idle)(batches):
            rows, _ = added_up(batch)
            if open_row is not None:
                same = all(open_row.column(c)[0] == rows.column(c)[0] for c in (*FIVE_TUPLE, "session"))
                if same:
                    head, _ = added_up(pa.Table.from_batches([open_row, rows.slice(0, 1)]).combine_chunks().to_batches()[0])
                    rows = pa.Table.from_batches([head, rows.slice(1)]).combine_chunks().to_batches()[0]
                else:
                    yield open_row
            if rows.num_rows > 1:
                yield rows.slice(0, rows.num_rows - 1)
            open_row = rows.slice(rows.num_rows - 1)
        if open_row is not None:
            yield open_row

    return run


def added_up(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Runs, or sums of runs, added up by flow and session; and where each of these begins."""
    starts = np.flatnonzero(changes([batch.column(c) for c in (*FIVE_TUPLE, "session")]))
    ends = np.r_[starts[1:], batch.num_rows] - 1
    first, last = pa.array(starts), pa.array(ends)
    made = {c: batch.column(c).take(first) for c in (*FIVE_TUPLE, "session", "first_ts")} | {c: batch.column(c).take(last) for c in _LAST}
    for names, add in ((_SUMS, np.add), (_LEAST, np.minimum), (_MOST, np.maximum)):
        made |= {c: pa.array(add.reduceat(_numpy(batch, c), starts), pa.int64()) for c in names}
    for c in _NAMES:
        entry = f"entry_{c}"
        made[c] = (pc.coalesce(batch.column(c), batch.column(entry)) if entry in batch.schema.names else batch.column(c)).take(last)
    return pa.record_batch([made[f.name].cast(f.type) for f in _TOTAL], schema=_TOTAL), starts


def as_runs(flows: pa.Table) -> pa.Table:
    """The totals (with ``fin``) of unfinished sessions as runs that end in their states whatever they begin in; of COUNTED they count nothing."""
    n, carries = len(flows), flows["app"].combine_chunks().is_valid()
    machine = np.zeros(n, _MACHINE)
    machine["functions"] = CONSTANT[flows["mode"].to_numpy()][:, None]
    machine["carried"] = np.where(carries.to_numpy(zero_copy_only=False), 0, -1)[:, None]
    some = flows.filter(carries)
    names = pa.StructArray.from_arrays([some[c].combine_chunks() for c in ("last_no", "app", "sni")], ["no", "app", "sni"])
    offsets = pa.array(np.r_[0, np.cumsum(carries.to_numpy(zero_copy_only=False))], pa.int32())
    same = {c: flows[c] for c in (*FIVE_TUPLE, "packets", "bytes", "last_no", "first_ts", "last_ts", "fin", "syn_at", "synack_at", "ack_at")}
    return pa.table(same | {"largest": flows["largest"].cast(pa.int32()), "first_packet_no": flows["session"], "machine": _binary(machine.view(np.uint8).reshape(n, -1)), "names": pa.ListArray.from_arrays(offsets, names)})


def _key(batch: pa.RecordBatch, row: int) -> tuple:
    return tuple(batch.column(c)[row].as_py() for c in FIVE_TUPLE)


#: What ``replayed`` adds to a packet.
REPLAYED = "action string, seg int, app string, sni string, classified boolean"


def replayed(keep: list[str]):
    """Each packet's fate. Rows with an ``entry`` come before the packet where a run begins and hold its state; only a state is kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (OPEN, 0, None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows + 1  # and the last batch's state before all
            at, started = np.arange(n), np.r_[True, batch.column("entry").is_valid().to_numpy(zero_copy_only=False)]
            entry = np.r_[kept[0], batch.column("entry").fill_null(0).to_numpy()]
            flags = np.r_[0, batch.column("flags").fill_null(0).to_numpy()]
            is_true = lambda name: np.r_[False, batch.column(name).fill_null(False).to_numpy(zero_copy_only=False)]
            found, hit, address = np.r_[False, batch.column("found_app").is_valid().to_numpy(zero_copy_only=False)], is_true("found_hit"), is_true("address_hit")
            since = begun(started)
            finned = (np.maximum.accumulate(np.where(flags & FIN != 0, at, -1)) >= since) | (entry[since] > 3)
            close = ~started & ((flags & RST != 0) | (flags & ACK != 0) & finned)
            mode = image(composed(np.where(started, CONSTANT[entry & 3], STEP[close | found << 1 | hit << 2 | address << 3]), at - since), 0)
            was = np.r_[mode[:1], mode[:-1]]
            classified = ~started & found & (close | (was == OPEN) | (was == SPOILED))
            first_seg = np.r_[kept[1], batch.column("entry_seg").fill_null(0).to_numpy()]
            closed = np.cumsum(close)
            seg = first_seg[since] + closed - closed[since]
            origin = pa.array(np.maximum.accumulate(np.where(started | classified, at, 0)))
            text = lambda c, first: pa.concat_arrays([pa.array([first], pa.string()), pc.if_else(pa.array(started[1:]), batch.column(f"entry_{c}"), batch.column(f"found_{c}"))]).take(origin)
            app, sni = text("app", kept[2]), text("sni", kept[3])
            kept = (int(mode[-1]) + 4 * bool(finned[-1]), int(seg[-1]), app[n - 1].as_py(), sni[n - 1].as_py())
            rows = pa.array(np.flatnonzero(~started[1:]))
            own = pa.array(np.flatnonzero(~started))
            made = {c: batch.column(c).take(rows) for c in keep}
            made["action"] = pc.if_else(pa.array(mode == BLOCKED), "DROP", "FORWARD").take(own)
            made |= {"seg": pa.array(seg, pa.int32()).take(own), "app": app.take(own).fill_null("Unknown"), "sni": sni.take(own).fill_null(""), "classified": pa.array(classified).take(own)}
            yield pa.record_batch(made)

    return run
