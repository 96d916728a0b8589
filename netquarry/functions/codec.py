"""Byte, address, flag and hash functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIVE_TUPLE = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
# TCP flag bits in the order in which they are named.
FLAG_NAMES = ((0x02, "SYN"), (0x10, "ACK"), (0x01, "FIN"), (0x04, "RST"), (0x08, "PSH"), (0x20, "URG"))
SYN, ACK, FIN, RST = 0x02, 0x10, 0x01, 0x04


def be(data: Column, offset: Column | int, size: int) -> Column:
    """Unsigned big-endian integer at a 0-based offset."""
    at = offset + 1 if isinstance(offset, Column) else F.lit(offset + 1)
    return F.conv(F.hex(F.substring(data, at.cast("int"), F.lit(size))), 16, 10).cast("long")


def le(data: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian integer at a 0-based offset."""
    return reduce(lambda a, b: a + b, (be(data, offset + i, 1) * (1 << (8 * i)) for i in range(size)))


def swap16(value: Column) -> Column:
    return F.shiftleft(value.bitwiseAND(0xFF), 8).bitwiseOR(F.shiftright(value, 8).bitwiseAND(0xFF))


def swap32(value: Column) -> Column:
    v = value.cast("long")
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.shiftright(v, 8 * i).bitwiseAND(0xFF), 24 - 8 * i) for i in range(4)))


def ip_number(ip: Column) -> Column:
    """Dotted address to a number, the first octet lowest. Anything but digits and dots is skipped; an octet above 255 runs into the next."""
    parts = F.split(F.regexp_replace(ip, "[^0-9.]", ""), r"\.")
    octet = lambda i: F.coalesce(F.nullif(F.get(parts, F.lit(i)), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(octet(i), 8 * i) for i in range(4))).bitwiseAND(0xFFFFFFFF)


def ip_text(number: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(number, 8 * i).bitwiseAND(0xFF).cast("string") for i in range(4)))


def protocol_name(protocol: Column) -> Column:
    return F.when(protocol == 1, "ICMP").when(protocol == 6, "TCP").when(protocol == 17, "UDP").otherwise(F.concat(F.lit("Unknown("), protocol.cast("string"), F.lit(")")))


def flag_names(flags: Column) -> Column:
    named = F.concat_ws(" ", *(F.when(flags.bitwiseAND(bit) != 0, name) for bit, name in FLAG_NAMES))
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("none"))


def flow_label(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column) -> Column:
    kind = F.when(protocol == 6, "TCP").when(protocol == 17, "UDP").otherwise("?")
    return F.concat(src_ip, F.lit(":"), src_port.cast("string"), F.lit(" -> "), dst_ip, F.lit(":"), dst_port.cast("string"), F.lit(" ("), kind, F.lit(")"))


def hash_step(h: Column, value: Column) -> Column:
    """One step of the 64-bit hash of a five-tuple; after five it is below 2**61, so nothing overflows."""
    return h.bitwiseXOR(value + F.lit(0x9E3779B9) + F.shiftleft(h, 6) + F.shiftrightunsigned(h, 2))


def worker_of(h: Column, balancers: int = 2, workers: int = 2) -> Column:
    """Worker index of a hash: the same hash picks the balancer and the worker below it, so with equal counts some stay idle."""
    part = lambda n: F.pmod(h, F.lit(n)) if n > 0 else F.lit(0).cast("long")
    return (part(balancers) * workers + part(workers)).cast("int")


def epoch(ts_sec: Column, ts_usec: Column) -> Column:
    return ts_sec + ts_usec / F.lit(1000000.0)


def utc_millis(ts: Column) -> Column:
    """UTC text of seconds, cut to milliseconds."""
    return F.date_format(F.timestamp_millis((ts * 1000).cast("long")), "yyyy-MM-dd HH:mm:ss.SSS")
