"""Ethernet, IPv4, TCP and UDP headers: read once for each Arrow batch, by numpy over the frames' joined bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ETHERNET, IPV4, TCP, UDP = 14, 0x0800, 6, 17

#: The decoded fields, in the order in which ``Frames.columns`` gives them.
FIELDS = (
    "frame_length int, ether_type int, ip_version int, has_ip boolean, protocol int, ttl int, has_tcp boolean, has_udp boolean, parse_ok boolean, src_mac string, dst_mac string, "
    "src_ip string, dst_ip string, src_port int, dst_port int, seq_number bigint, ack_number bigint, tcp_flags int, payload_offset int, payload_length int"
)
PAYLOAD = "payload binary"
#: The fields that flows and most reports are made of.
NARROW = ("frame_length", "has_ip", "parse_ok", "protocol", "has_tcp", "has_udp", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "payload_length")
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
KINDS = {name: _ARROW[kind] for name, kind in (f.split() for f in FIELDS.split(", "))}


def _named(values: np.ndarray, where: np.ndarray, text) -> pa.Array:
    """Numbers as text, each distinct one written once; null outside ``where``."""
    distinct, at = np.unique(values[where], return_inverse=True)
    index = np.zeros(len(values), np.int32)
    index[where] = at
    names = pa.array([text(int(v)) for v in distinct] or [""], pa.string())
    return pa.DictionaryArray.from_arrays(pa.array(index, mask=~where), names).dictionary_decode()


def mac_text(number: int) -> str:
    return ":".join(f"{number >> s & 255:02x}" for s in range(40, -1, -8))


def ip_text(number: int) -> str:
    return ".".join(str(number >> s & 255) for s in range(24, -1, -8))


@dataclass
class Frames:
    """A batch of frames as one run of bytes, each frame with its start and length. A null frame has no bytes."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Frames:
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2] if len(column) else None
        return cls(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets))

    def number(self, at, size: int, where: np.ndarray) -> np.ndarray:
        """Unsigned big-endian integers at an offset of each frame; 0 outside ``where``."""
        out = np.zeros(len(self.start), np.int64)
        first = (self.start + at)[where]
        value = np.zeros(len(first), np.int64)
        for i in range(size):
            value = value << 8 | self.data[first + i]
        out[where] = value
        return out

    def payloads(self, offset: np.ndarray, length: np.ndarray) -> Frames:
        """What is left of each frame from ``offset`` on, still in the same bytes."""
        return Frames(self.data, self.start + offset, length)

    def array(self) -> pa.Array:
        """The frames as a binary column of their own."""
        ends = np.cumsum(self.size)
        picked = self.data[np.repeat(self.start - (ends - self.size), self.size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return pa.Array.from_buffers(pa.large_binary(), len(self.size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(picked.tobytes())]).cast(pa.binary())

    def columns(self, wanted: tuple[str, ...] = ()) -> tuple[dict[str, pa.Array], Frames]:
        """The decoded fields (all, or those ``wanted``), and the payloads."""
        n = self.size
        eth = n >= ETHERNET
        ether = self.number(12, 2, eth)
        is_ipv4 = eth & (ether == IPV4)
        long_enough = is_ipv4 & (n >= ETHERNET + 20)
        first = self.number(ETHERNET, 1, long_enough)
        l4 = (first & 15) * 4 + ETHERNET
        has_ip = long_enough & (first >> 4 == 4) & (l4 >= ETHERNET + 20) & (l4 <= n)
        protocol = self.number(23, 1, has_ip)
        tcp_head = has_ip & (protocol == TCP) & (n >= l4 + 20)
        tcp_size = (self.number(l4 + 12, 1, tcp_head) >> 4) * 4
        has_tcp = tcp_head & (tcp_size >= 20) & (l4 + tcp_size <= n)
        has_udp = has_ip & (protocol == UDP) & (n >= l4 + 8)
        transport = has_tcp | has_udp
        offset = np.where(has_tcp, l4 + tcp_size, np.where(has_udp, l4 + 8, np.where(has_ip, l4, ETHERNET)))
        length = np.maximum(n - offset, 0)
        made = {
            "frame_length": lambda: n, "ether_type": lambda: (ether, ~eth), "ip_version": lambda: (first >> 4, ~long_enough), "has_ip": lambda: has_ip, "protocol": lambda: (protocol, ~has_ip), "ttl": lambda: (self.number(22, 1, has_ip), ~has_ip),
            "has_tcp": lambda: has_tcp, "has_udp": lambda: has_udp, "parse_ok": lambda: eth & (~is_ipv4 | (has_ip & (transport | ~np.isin(protocol, (TCP, UDP))))),
            "src_mac": lambda: _named(self.number(6, 6, eth), eth, mac_text), "dst_mac": lambda: _named(self.number(0, 6, eth), eth, mac_text), "src_ip": lambda: _named(self.number(26, 4, has_ip), has_ip, ip_text), "dst_ip": lambda: _named(self.number(30, 4, has_ip), has_ip, ip_text),
            "src_port": lambda: self.number(l4, 2, transport), "dst_port": lambda: self.number(l4 + 2, 2, transport), "seq_number": lambda: self.number(l4 + 4, 4, has_tcp), "ack_number": lambda: self.number(l4 + 8, 4, has_tcp), "tcp_flags": lambda: self.number(l4 + 13, 1, has_tcp),
            "payload_offset": lambda: offset, "payload_length": lambda: length,
        }
        values = {k: made[k]() for k in wanted or made}
        arrays = {k: v if isinstance(v, pa.Array) else pa.array(v[0], KINDS[k], mask=v[1]) if isinstance(v, tuple) else pa.array(v, KINDS[k]) for k, v in values.items()}
        return arrays, self.payloads(np.minimum(offset, n), length)


def with_fields(raw: DataFrame, fields: str, made, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``raw`` (all columns, or ``keep``) with ``fields`` that ``made`` computes from the frames of each batch. Columns of ``raw`` with their names are replaced."""
    added = T.StructType.fromDDL(fields)
    names = [f.name for f in added.fields]
    kept = [c for c in (raw.columns if keep is None else keep) if c not in names and c != "data"]
    with_data = keep is None
    wanted = raw.select(*(f"`{c}`" for c in kept), "data")
    schema = T.StructType([*(f for f in wanted.schema.fields if with_data or f.name != "data"), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = made(Frames.of(batch.column(len(kept))))
            old = batch.columns if with_data else batch.columns[:-1]
            yield pa.record_batch([*old, *(new[n] for n in names)], names=[*kept, *(["data"] if with_data else []), *names])

    return wanted.mapInArrow(run, schema)


def decode(raw: DataFrame) -> DataFrame:
    """Adds the decoded fields and the payload to raw packets with ``data``.

    ``parse_ok`` is false for frames whose headers are cut or wrong; other ether types parse but have no IP.
    The payload runs to the frame's end, padding included. UDP's length field isn't used. Null data is a frame of no bytes.
    """

    def made(frames: Frames) -> dict[str, pa.Array]:
        fields, payloads = frames.columns()
        return fields | {"payload": payloads.array()}

    return with_fields(raw, f"{FIELDS}, {PAYLOAD}", made)


def ddl(names: tuple[str, ...]) -> str:
    """Some of the fields as a schema."""
    return ", ".join(f for f in FIELDS.split(", ") if f.split()[0] in names)


def headers(raw: DataFrame, wanted: tuple[str, ...] = NARROW) -> DataFrame:
    """Numbers and times of raw packets with some decoded fields (all, if none are named), without bytes."""
    keep = tuple(c for c in raw.columns if c in ("packet_no", "ts_sec", "ts_usec"))
    return with_fields(raw, ddl(wanted or tuple(KINDS)), lambda frames: frames.columns(wanted)[0], keep)


#: What the engine accepts: parsed TCP and UDP over IPv4.
ENGINE_PACKETS = "parse_ok AND has_ip AND (has_tcp OR has_udp)"


def engine_packets(packets: DataFrame) -> DataFrame:
    return packets.where(ENGINE_PACKETS)


def report_packets(packets: DataFrame) -> DataFrame:
    """What the report tables hold: all parsed IPv4, ICMP and others included."""
    return packets.where("parse_ok AND has_ip")
