"""Block rules by address, application, domain and port."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.classify import app_name
from netquarry.operators.rule_index import matched
from netquarry.sources.files import located

# The sections of a rules file, with the kind of rule in each.
SECTIONS = {"[BLOCKED_IPS]": "IP", "[BLOCKED_APPS]": "APP", "[BLOCKED_DOMAINS]": "DOMAIN", "[BLOCKED_PORTS]": "PORT"}

#: Domain rules that are compared one by one within the plan at most.
MOST_LITERALS = 64


def _octets(ip: str) -> int:
    """As ``codec.ip_number``."""
    number = 0
    for i, part in enumerate("".join(c for c in ip if c in ".0123456789").split(".")[:4]):
        number |= int(part or 0) << (8 * i)
    return number & 0xFFFFFFFF


@dataclass
class RuleSet:
    """Rules; an application name that isn't known blocks what is unclassified, as a rule given by hand does."""

    ips: set[int] = field(default_factory=set)
    apps: set[str] = field(default_factory=set)
    domains: set[str] = field(default_factory=set)
    patterns: list[str] = field(default_factory=list)
    ports: set[int] = field(default_factory=set)

    @classmethod
    def of(cls, ips=(), apps=(), domains=(), ports=()) -> RuleSet:
        rules = cls()
        for add, values in ((rules.block_ip, ips), (rules.block_app, apps), (rules.block_domain, domains), (rules.block_port, ports)):
            for value in values:
                add(value)
        return rules

    def block_ip(self, ip: str) -> None:
        self.ips.add(_octets(ip))

    def unblock_ip(self, ip: str) -> None:
        self.ips.discard(_octets(ip))

    def block_app(self, name: str) -> None:
        self.apps.add(app_name(name))

    def unblock_app(self, name: str) -> None:
        self.apps.discard(app_name(name))

    def block_domain(self, domain: str) -> None:
        if "*" in domain:
            self.patterns.append(domain)
        else:
            self.domains.add(domain)

    def unblock_domain(self, domain: str) -> None:
        if "*" in domain:
            self.patterns = [p for p in self.patterns if p != domain]
        else:
            self.domains.discard(domain)

    def block_port(self, port: int) -> None:
        self.ports.add(int(port))

    def unblock_port(self, port: int) -> None:
        self.ports.discard(int(port))

    def clear(self) -> None:
        self.ips, self.apps, self.domains, self.patterns, self.ports = set(), set(), set(), [], set()

    def blocked_ips(self) -> list[str]:
        return [".".join(str(n >> (8 * i) & 255) for i in range(4)) for n in sorted(self.ips)]

    def blocked_domains(self) -> list[str]:
        return sorted(self.domains) + self.patterns

    def stats(self) -> dict[str, int]:
        return {"blocked_ips": len(self.ips), "blocked_apps": len(self.apps), "blocked_domains": len(self.domains) + len(self.patterns), "blocked_ports": len(self.ports)}

    # -- conditions over columns

    def ip_hit(self, src_ip: Column) -> Column:
        """Of addresses as packets have them: four numbers without leading zeros."""
        return src_ip.isin(self.blocked_ips()) if self.ips else F.lit(False)

    def port_hit(self, dst_port: Column) -> Column:
        return dst_port.isin(sorted(self.ports)) if self.ports else F.lit(False)

    def app_hit(self, app: Column) -> Column:
        return app.isin(sorted(self.apps)) if self.apps else F.lit(False)

    def domain_hit(self, domain: Column) -> Column:
        """A plain rule is met by any name that contains it, ``*.x`` by x and what ends in .x; other stars never. Few rules are part of the plan, more are looked up by an automaton."""
        if len(self.domains) + len(self.patterns) > MOST_LITERALS:
            return matched(SparkSession.active(), self.domains, self.patterns, domain)
        name, hit = F.lower(domain), F.lit(False)
        for rule in sorted(self.domains):
            hit = hit | F.contains(name, F.lit(rule.lower()))
        for rule in self.patterns:
            if rule.startswith("*."):
                hit = hit | F.endswith(name, F.lit(rule[1:].lower())) | (name == rule[2:].lower())
        return F.coalesce(hit, F.lit(False)) & (domain != "")

    def flow_hit(self, app: Column, domain: Column) -> Column:
        return F.coalesce(self.app_hit(app) | self.domain_hit(domain), F.lit(False))

    def address_hit(self, src_ip: Column, dst_port: Column) -> Column:
        return F.coalesce(self.ip_hit(src_ip) | self.port_hit(dst_port), F.lit(False))

    def reason(self, src_ip: Column, dst_port: Column, app: Column, domain: Column) -> Column:
        """struct(type, detail) of the first rule that is met: source address, destination port, application, domain; else null."""
        made = lambda kind, detail: F.struct(F.lit(kind).alias("type"), detail.cast("string").alias("detail"))
        return F.when(self.ip_hit(src_ip), made("IP", src_ip)).when(self.port_hit(dst_port), made("PORT", dst_port)).when(self.app_hit(app), made("APP", app)).when(self.domain_hit(domain), made("DOMAIN", domain))

    # -- files

    def save(self, path: str) -> None:
        parts = (self.blocked_ips(), sorted(self.apps), self.blocked_domains(), [str(p) for p in sorted(self.ports)])
        fs, place = located(path)
        fs.create_dir(place.rpartition("/")[0])
        with fs.open_output_stream(place) as f:
            f.write("\n".join(f"{title}\n" + "".join(f"{v}\n" for v in values) for title, values in zip(SECTIONS, parts, strict=True)).encode())

    @classmethod
    def load(cls, path: str) -> RuleSet:
        rules = cls()
        fs, place = located(path)
        with fs.open_input_stream(place) as f:
            rules.read(f.read().decode().splitlines())
        return rules

    @classmethod
    def from_table(cls, table: DataFrame) -> RuleSet:
        """Rules of a table ``kind, value``. Rules are conditions of a plan, so they come to the driver."""
        rules = cls()
        add = {"IP": rules.block_ip, "APP": rules.block_app, "DOMAIN": rules.block_domain, "PORT": rules.block_port}
        for r in table.select("kind", "value").distinct().orderBy("kind", "value").toLocalIterator():
            add[r.kind](r.value)
        return rules

    def read(self, lines) -> None:
        """Adds the rules of a file's lines. Unknown sections and applications are passed over; a port that is no number raises."""
        kind = None
        for line in map(str.strip, lines):
            if line.startswith("["):
                kind = SECTIONS.get(line)
            elif line and kind == "IP":
                self.block_ip(line)
            elif line and kind == "APP" and app_name(line) != "Unknown":
                self.block_app(line)
            elif line and kind == "DOMAIN":
                self.block_domain(line)
            elif line and kind == "PORT":
                self.block_port(int(line))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("IP", v) for v in self.blocked_ips()] + [("APP", v) for v in sorted(self.apps)] + [("DOMAIN", v) for v in self.blocked_domains()] + [("PORT", str(v)) for v in sorted(self.ports)]
        return spark.createDataFrame(rows, "kind string, value string")
