"""Names in payloads: TLS server names, HTTP hosts, DNS questions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.functions.classify import app_of_name
from netquarry.functions.codec import be
from netquarry.operators.decode import NARROW, Frames, ddl, with_fields

#: TLS is looked for in payloads of at least so many bytes on any port.
TLS_ANYWHERE = 50


def _text(raw: bytes) -> str:
    return raw.decode("ascii", "replace")


def server_name(p: bytes) -> str | None:
    """Server name of a ClientHello record: past the version, random, session, ciphers and compression to extension 0."""
    number = lambda at, size: int.from_bytes(p[at : at + size], "big")
    at = 43
    for size in (1, 2, 1):  # session id, cipher suites, compression methods
        if at + size > len(p):
            return None
        at += size + number(at, size)
    if at + 2 > len(p):
        return None
    end = min(len(p), at + 2 + number(at, 2))
    at += 2
    while at + 4 <= end:
        kind, size = number(at, 2), number(at + 2, 2)
        at += 4
        if at + size > end:
            return None
        if kind == 0:
            if size < 5 or number(at, 2) < 3 or p[at + 2] != 0 or number(at + 3, 2) > size - 5:
                return None
            return _text(p[at + 5 : at + 5 + number(at + 3, 2)])
        at += size
    return None


def question_name(p: bytes) -> str | None:
    """First name of a DNS query: labels to the root; a pointer or an overrun ends it."""
    labels, at = [], 12
    while at < len(p):
        size = p[at]
        if size == 0 or size > 63 or at + 1 + size > len(p):
            break
        labels.append(_text(p[at + 1 : at + 1 + size]))
        at += 1 + size
    return ".".join(labels) or None


def _is_hello(p: bytes) -> bool:
    return len(p) >= 9 and p[0] == 0x16 and 0x0300 <= int.from_bytes(p[1:3], "big") <= 0x0304 and int.from_bytes(p[3:5], "big") <= len(p) - 5 and p[5] == 1


def quic_name(p: bytes) -> str | None:
    """Server name of a ClientHello that follows somewhere in a long-header QUIC packet."""
    if len(p) < 5 or not p[0] & 0x80:
        return None
    for i in range(5, len(p) - 50):
        if p[i] == 1 and _is_hello(p[i - 5 :]) and (name := server_name(p[i - 5 :])):
            return name
    return None


def _each(one) -> Column:
    @F.arrow_udf(T.StringType())
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([one(x) if (x := v.as_py()) is not None else None for v in column], pa.string())

    return run


def is_client_hello(p: Column) -> Column:
    n = F.length(p)
    return F.coalesce((n >= 9) & (be(p, 0, 1) == 0x16) & be(p, 1, 2).between(0x0300, 0x0304) & (be(p, 3, 2) <= n - 5) & (be(p, 5, 1) == 1), F.lit(False))


def tls_server_name(p: Column, where: Column | None = None) -> Column:
    """Null outside ``where``; only payloads that start as a ClientHello reach Python."""
    guard = is_client_hello(p) if where is None else where & is_client_hello(p)
    return F.nullif(_each(server_name)(F.when(guard, p)), F.lit(""))


def quic_server_name(p: Column) -> Column:
    return _each(quic_name)(F.when((F.length(p) >= 5) & (be(p, 0, 1) >= 0x80), p))


# The first four bytes of HTTP requests.
METHODS = ("GET ", "POST", "PUT ", "HEAD", "DELE", "PATC", "OPTI")


def is_http_request(p: Column) -> Column:
    return F.coalesce((F.length(p) >= 4) & F.decode(F.substring(p, 1, 4), "ISO-8859-1").isin(*METHODS), F.lit(False))


def http_host(p: Column) -> Column:
    """The first Host header with a value, without its port; bytes beyond ASCII become U+FFFD."""
    text = F.decode(F.when(is_http_request(p), p), "ISO-8859-1")
    value = F.split(F.regexp_extract(text, r"(?is)(?=.{7})host:[ \t]*+([^\r\n]+)", 1), ":")[0]
    value = F.regexp_replace(F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\x80-\xff]", "�")
    return F.nullif(value, F.lit(""))


def is_dns_query(p: Column) -> Column:
    return F.coalesce((F.length(p) >= 12) & (be(p, 2, 1) < 0x80) & (be(p, 4, 2) != 0), F.lit(False))


def dns_name(p: Column, where: Column | None = None) -> Column:
    guard = is_dns_query(p) if where is None else where & is_dns_query(p)
    return _each(question_name)(F.when(guard, p))


#: The applications of findings without a name.
_APPS = {"DNS": "DNS", "port 80": "HTTP", "port 443": "HTTPS"}
_HOST = re.compile(rb"(?is)(?=.{7})host:[ \t]*+([^\r\n]+)")


def host_name(p: bytes) -> str | None:
    """As ``http_host``, of one payload."""
    found = _HOST.search(p) if p[:4].decode("latin-1") in METHODS else None
    return _text(found[1].split(b":")[0].strip(bytes(range(33)))) or None if found else None


def _findings(fields: dict[str, pa.Array], payloads: Frames) -> dict[str, pa.Array]:
    """``found_by``, ``found_sni`` and ``found_app`` of a batch: the conditions are numpy's, only payloads that may hold a name are looked into."""
    number = lambda name: fields[name].to_numpy(zero_copy_only=False)
    source, target, size = number("src_port"), number("dst_port"), payloads.size
    has = (size > 0) & (number("has_tcp") | number("has_udp"))
    by, name = np.full(len(size), None, object), np.full(len(size), None, object)
    hello = has & (size >= 9) & ((target == 443) | (size >= TLS_ANYWHERE))
    hello &= (payloads.number(0, 1, hello) == 0x16) & (payloads.number(5, 1, hello) == 1) & (payloads.number(3, 2, hello) <= size - 5)
    version = payloads.number(1, 2, hello)
    hello &= (version >= 0x0300) & (version <= 0x0304)
    query = has & (size >= 12) & ((target == 53) | (source == 53))
    query &= (payloads.number(2, 1, query) < 0x80) & (payloads.number(4, 2, query) != 0)
    for kind, where, one in (("TLS", hello, server_name), ("HTTP", has & (target == 80), host_name), ("DNS", query, question_name)):
        for i in np.flatnonzero(where & (by == None)).tolist():  # noqa: E711
            found = one(payloads.data[payloads.start[i] : payloads.start[i] + size[i]].tobytes())
            if found:
                by[i], name[i] = kind, found if kind != "DNS" else ""
    for port in (80, 443):
        rest = has & (by == None) & (target == port)  # noqa: E711
        by[rest], name[rest] = f"port {port}", ""
    # an application for each kind of finding and distinct name
    found, app, known = np.flatnonzero(by != None).tolist(), np.full(len(size), None, object), {}  # noqa: E711
    for i in found:
        key = by[i], name[i]
        if key not in known:
            known[key] = _APPS.get(key[0]) or app_of_name(key[1])
        app[i] = known[key]
    return {"found_by": pa.array(by, pa.string()), "found_sni": pa.array(name, pa.string()), "found_app": pa.array(app, pa.string())}


def inspected(raw: DataFrame) -> DataFrame:
    """Raw packets with the ``NARROW`` fields that ``decode`` gives, without their bytes, with ``found_by``, ``found_app`` and ``found_sni``: what a
    packet's payload says of its flow; null if nothing.

    It depends on the packet alone, so one pass over the bytes comes before any shuffle. TLS on port 443 or in larger payloads
    goes first, then HTTP to port 80, DNS on port 53, and at last the port by itself. Only TCP and UDP are looked into.
    """

    def made(frames: Frames) -> dict[str, pa.Array]:
        fields, payloads = frames.columns(NARROW)
        return fields | _findings(fields, payloads)

    keep = tuple(c for c in raw.columns if c in ("packet_no", "ts_sec", "ts_usec"))
    return with_fields(raw, f"{ddl(NARROW)}, found_by string, found_sni string, found_app string", made, keep)
