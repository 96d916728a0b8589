"""Deterministic Ethernet frames from an event table, so that queries run over ordinary tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hosts of the servers 198.51.100.1 and on: each application's, two that other patterns shadow, and unknown ones.
HOSTS = (
    "www.google.com", "www.youtube.com", "www.facebook.com", "www.instagram.com", "web.whatsapp.com", "twitter.com", "www.netflix.com", "www.amazon.com",
    "www.microsoft.com", "www.apple.com", "web.telegram.org", "www.tiktok.com", "open.spotify.com", "zoom.us", "discord.com", "github.com",
    "www.cloudflare.com", "example.com", "httpbin.org", "api.nflxvideo.net", "outlook.office.net", "cdn.scdn.co", "a-very-long-label-for-one-host.example.org", "intranet",
)
RESOLVER = "8.8.8.8"


def client_hello(host: str) -> bytes:
    """A TLS record with one cipher, the server name, and the versions."""
    name, n = host.encode(), len(host)
    extensions = struct.pack("!HHHBH", 0, n + 5, n + 3, 0, n) + name + bytes.fromhex("002b00050403040303")
    body = b"\x03\x03" + bytes(33) + bytes.fromhex("000213010100") + struct.pack("!H", len(extensions)) + extensions
    return b"\x16\x03\x01" + struct.pack("!H", len(body) + 4) + b"\x01" + len(body).to_bytes(3, "big") + body


def dns_query(host: str) -> bytes:
    labels = b"".join(bytes([len(label)]) + label.encode() for label in host.split("."))
    return bytes.fromhex("123401000001000000000000") + labels + bytes.fromhex("0000010001")


def ip_bytes(ip: str) -> bytes:
    return bytes(map(int, ip.split(".")))


def ethernet(source: str, target: str, kind: int, rest: bytes) -> bytes:
    return b"\x02\x00" + ip_bytes(target) + b"\x02\x00" + ip_bytes(source) + struct.pack("!H", kind) + rest


def ipv4(source: str, target: str, protocol: int, l4: bytes, ttl: int = 64, ident: int = 0) -> bytes:
    header = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(l4), ident, 0x4000, ttl, protocol, 0)
    return ethernet(source, target, 0x0800, header + ip_bytes(source) + ip_bytes(target) + l4)


def tcp(source_port: int, target_port: int, flags: int, payload: bytes = b"", seq: int = 0, ack: int = 0) -> bytes:
    return struct.pack("!HHIIBBHHH", source_port, target_port, seq, ack, 0x50, flags, 0xFFFF, 0, 0) + payload


def udp(source_port: int, target_port: int, payload: bytes) -> bytes:
    return struct.pack("!HHHH", source_port, target_port, len(payload) + 8, 0) + payload


def frame(e: int, u: int, kind: str, value: float | None) -> bytes:
    """The frame of an event: views and purchases are TLS to port 443, clicks HTTP to port 80, signups DNS over UDP, errors resets and ends.

    Some are ARP, ICMP or cut frames. Server answers (SYN-ACK) go the other way.
    """
    number = (u * 5 + e % 3) % len(HOSTS)
    host, pad = HOSTS[number], b"x" * (int(value or 0) % 40)
    client, client_port = f"10.0.{u // 256 % 256}.{u % 256}", 49152 + u * 7 % 64
    server, ttl, ident = f"198.51.100.{number + 1}", 32 + u % 64, e % 65536
    if kind == "signup":
        if e % 13 == 0:
            return ethernet(client, RESOLVER, 0x0806, bytes.fromhex("0001080006040001") + bytes(20))
        return ipv4(client, RESOLVER, 17, udp(client_port, 53, dns_query(host) + pad), ttl, ident)
    if kind == "error" and e % 7 == 0:
        return ipv4(client, server, 1, bytes.fromhex("0800000000010001"), ttl, ident)
    flags = (4 if e % 2 == 0 else 17) if kind == "error" else (2, 18, 16, 24, 17)[e % 5]
    port, payload = (80 if kind == "click" else 443), b""
    if flags == 24 and kind == "click":
        payload = b"POST / HTTP/1.1\r\n\r\n" if e % 4 == 0 else f"GET / HTTP/1.1\r\nHost: {host}\r\nUser-Agent: nq\r\n\r\n".encode() + pad
    elif flags == 24:
        payload = b"X" * 60 if kind == "purchase" and e % 3 == 0 else client_hello(host)
    if flags == 18:
        return ipv4(server, client, 6, tcp(port, client_port, flags, payload, e, e * 2), ttl, ident)
    whole = ipv4(client, server, 6, tcp(client_port, port, flags, payload, e, e * 2), ttl, ident)
    return whole[:30] if kind == "view" and e % 97 == 0 else whole


def frames(events: DataFrame) -> DataFrame:
    """``packet_no, ts_sec, ts_usec, incl_len, orig_len, data`` of ``events(event_id, ts, user_id, event_type, value)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, micros, u, kind, value = (c.to_pylist() for c in batch.columns)
            made = [frame(*x) for x in zip(e, u, kind, value, strict=True)]
            size = pa.array(map(len, made), pa.int32())
            yield pa.record_batch({
                "packet_no": batch.column(0), "ts_sec": pa.array([m // 1_000_000 for m in micros], pa.int32()), "ts_usec": pa.array([m % 1_000_000 for m in micros], pa.int32()),
                "incl_len": size, "orig_len": size, "data": pa.array(made, pa.binary()),
            })

    wanted = events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "user_id", "event_type", "value")
    return wanted.mapInArrow(run, "packet_no bigint, ts_sec int, ts_usec int, incl_len int, orig_len int, data binary")


# The sample capture's client, and its servers with their names.
SAMPLE_CLIENT = "192.168.1.100"
SAMPLE_TLS = (
    ("142.250.185.206", "www.google.com"), ("142.250.185.110", "www.youtube.com"), ("157.240.1.35", "www.facebook.com"), ("157.240.1.174", "www.instagram.com"), ("104.244.42.65", "twitter.com"), ("52.94.236.248", "www.amazon.com"),
    ("23.52.167.61", "www.netflix.com"), ("140.82.114.4", "github.com"), ("104.16.85.20", "discord.com"), ("35.186.224.25", "zoom.us"), ("35.186.227.140", "web.telegram.org"), ("99.86.0.100", "www.tiktok.com"),
    ("35.186.224.47", "open.spotify.com"), ("192.0.78.24", "www.cloudflare.com"), ("13.107.42.14", "www.microsoft.com"), ("17.253.144.10", "www.apple.com"),
)
SAMPLE_HTTP = (("93.184.216.34", "example.com"), ("185.199.108.153", "httpbin.org"))
SAMPLE_DNS = ("www.google.com", "www.youtube.com", "www.facebook.com", "api.twitter.com")
SAMPLE_BLOCKED = ("192.168.1.50", "172.217.0.100")
SAMPLE_REQUEST = "GET / HTTP/1.1\r\nHost: {host}\r\nUser-Agent: DPI-Test/1.0\r\nAccept: */*\r\n\r\n"


def sample_frames(first_port: int = 50_000) -> list[bytes]:
    """77 frames: sixteen TLS handshakes, two HTTP requests, four DNS queries, and five packets of another source."""
    ports, me = iter(range(first_port, 65_536)), SAMPLE_CLIENT
    out: list[bytes] = []
    for ip, host in SAMPLE_TLS:
        port = next(ports)
        out += [ipv4(me, ip, 6, tcp(port, 443, 2)), ipv4(ip, me, 6, tcp(443, port, 18)), ipv4(me, ip, 6, tcp(port, 443, 16)), ipv4(me, ip, 6, tcp(port, 443, 24, client_hello(host)))]
    for ip, host in SAMPLE_HTTP:
        port = next(ports)
        out += [ipv4(me, ip, 6, tcp(port, 80, 2)), ipv4(me, ip, 6, tcp(port, 80, 24, SAMPLE_REQUEST.format(host=host).encode()))]
    out += [ipv4(me, RESOLVER, 17, udp(next(ports), 53, dns_query(host))) for host in SAMPLE_DNS]
    source, target = SAMPLE_BLOCKED
    return out + [ipv4(source, target, 6, tcp(next(ports), 443, 2)) for _ in range(5)]


def sample_packets(spark: SparkSession, first_second: int = 1_700_000_000) -> DataFrame:
    """The sample as raw packets, one a second."""
    rows = [(i, first_second + i, 0, len(f), len(f), bytearray(f)) for i, f in enumerate(sample_frames())]
    return spark.createDataFrame(rows, "packet_no bigint, ts_sec int, ts_usec int, incl_len int, orig_len int, data binary")
