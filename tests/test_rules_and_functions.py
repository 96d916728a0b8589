import pytest
from pyspark.sql import functions as F

from netquarry.functions import codec
from netquarry.functions.classify import app_of
from netquarry.operators.flows import with_hash
from netquarry.operators.inspection import _is_hello, dns_name, http_host, question_name, server_name
from netquarry.operators.rules import RuleSet
from netquarry.synth import client_hello, dns_query


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(0,)], list(values) or ["x"]).select(column.alias("r")).first().r


def test_byte_reads_and_swaps(spark):
    df = spark.createDataFrame([(bytearray.fromhex("1234567890"),)], "d binary")
    d = F.col("d")
    row = df.select(codec.be(d, 0, 2), codec.be(d, 0, 3), codec.be(d, 0, 4), codec.le(d, 0, 2), codec.le(d, 0, 4), codec.swap16(F.lit(0x1234)), codec.swap32(F.lit(0x12345678))).first()
    assert tuple(row) == (0x1234, 0x123456, 0x12345678, 0x3412, 0x78563412, 0x3412, 0x78563412)


def test_tuple_hash_is_directional(spark):
    rows = [("192.168.1.100", "142.250.185.206", 54321, 443, 6), ("142.250.185.206", "192.168.1.100", 443, 54321, 6), ("255.255.255.255", "255.255.255.255", 65535, 65535, 255)]
    found = [r.hash for r in with_hash(spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol int")).collect()]
    assert found[0] == 75370315391541550
    assert found[1] != found[0]
    h = 0
    for v in (2**32 - 1, 2**32 - 1, 65535, 65535, 255):
        h ^= v + 0x9E3779B9 + (h << 6) + (h >> 2)
    assert found[2] == h < 2**61


def test_address_parsing_is_lenient(spark):
    df = spark.createDataFrame([("192.168.1.50",), ("1.2.3",), ("a1.b2.3.4",)], "ip string")
    assert [r[0] for r in df.select(codec.ip_text(codec.ip_number(F.col("ip")))).collect()] == ["192.168.1.50", "1.2.3.0", "1.2.3.4"]


@pytest.mark.parametrize(("host", "app"), [("www.google.com", "Google"), ("www.netflix.com", "Twitter/X"), ("www.microsoft.com", "Twitter/X"), ("api.nflxvideo.net", "Netflix"), ("YT3.ggpht.com", "Google"), ("plain.example", "HTTPS"), ("", "Unknown")])
def test_classification(spark, host, app):
    assert one(spark, app_of(F.col("h")), h=host) == app


def test_domain_rules(spark):
    rules = RuleSet.of(domains=("*.facebook.com", "a*b.com"))
    df = spark.createDataFrame([("facebook.com",), ("api.facebook.com",), ("myfacebook.com",), ("aXb.com",), ("",)], "h string")
    assert [r[0] for r in df.select(rules.domain_hit(F.col("h"))).collect()] == [True, True, False, False, False]


def test_reason_precedence(spark):
    rules = RuleSet.of(("10.0.0.1",), ("YouTube",), ("tube",), (8080,))
    rows = [("10.0.0.1", 8080, "YouTube", "tube.x"), ("10.0.0.2", 8080, "YouTube", "tube.x"), ("10.0.0.2", 1, "YouTube", "tube.x"), ("10.0.0.2", 1, "HTTPS", "tube.x"), ("10.0.0.2", 1, "HTTPS", "")]
    df = spark.createDataFrame(rows, "s string, p int, a string, d string")
    got = [r[0] and tuple(r[0]) for r in df.select(rules.reason(F.col("s"), F.col("p"), F.col("a"), F.col("d"))).collect()]
    assert got == [("IP", "10.0.0.1"), ("PORT", "8080"), ("APP", "YouTube"), ("DOMAIN", "tube.x"), None]


def test_rules_file(tmp_path):
    rules = RuleSet.of(("10.0.0.1",), ("youtube",), ("x.com", "*.y.com"), (53,))
    rules.save(str(tmp_path / "r"))
    assert RuleSet.load(str(tmp_path / "r")) == rules
    text = "junk\n[BLOCKED_APPS]\nNoSuchApp\n Zoom \n[OTHER]\nx\n[BLOCKED_PORTS]\nnone\n"
    (tmp_path / "bad").write_text(text)
    with pytest.raises(ValueError):
        RuleSet.load(str(tmp_path / "bad"))
    (tmp_path / "bad").write_text(text.replace("none", "80"))
    assert RuleSet.load(str(tmp_path / "bad")).stats() == {"blocked_ips": 0, "blocked_apps": 1, "blocked_domains": 0, "blocked_ports": 1}
    assert RuleSet.of(apps=("Youtub",)).apps == {"Unknown"}


def test_server_names():
    hello = client_hello("www.example.org")
    assert _is_hello(hello) and server_name(hello) == "www.example.org" and len(hello) == 70 + 15
    assert not _is_hello(hello[:40])
    assert server_name(hello[:60]) is None
    assert server_name(hello[:-9]) == "www.example.org"  # the extensions' length runs over the end


def test_dns_names(spark):
    assert question_name(dns_query("a.bc.def")) == "a.bc.def"
    assert question_name(bytes(12) + b"\xc0\x0c") is None
    answer = bytearray(dns_query("a.b"))
    answer[2] |= 0x80
    df = spark.createDataFrame([(bytearray(dns_query("a.b")),), (answer,), (bytearray(3),), (None,)], "p binary")
    assert [r[0] for r in df.select(dns_name(F.col("p"))).collect()] == ["a.b", None, None, None]


@pytest.mark.parametrize(("text", "host"), [("GET / HTTP/1.1\r\nHost: a.b:8080\r\n", "a.b"), ("GET / HTTP/1.1\r\nHost: \r\nX-Host: a.b:80\r\n", "a.b"), ("GET / Host:x", None), ("HOST: a.b\r\n", None), ("GET / \r\nhost:\t c.d \r\n", "c.d"), ("GET / \r\nHost: é.com\r\n", "�.com")])
def test_http_hosts(spark, text, host):
    assert one(spark, http_host(F.col("p")), p=bytearray(text.encode("latin-1"))) == host
