"""WARC archives: a native writer, and a parallel reader that trusts only records reachable from a file's start."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netquarry.llm.common import cut

#: A record starts with this line; as the text source's line separator it cuts files at each candidate.
MAGIC = "WARC/1.1\r\n"
#: What ends a record, and what ends a header.
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Tables of at most so many small rows are broadcast, larger ones joined by their keys.
BROADCAST_ROWS = 100_000


def base32(hexed: Column) -> Column:
    """Base32 of 20 bytes in hexadecimal."""
    chars = []
    for part in range(4):
        value = F.conv(F.substring(hexed, 10 * part + 1, 10), 16, 10).cast("long")
        chars += [F.substring(F.lit(ALPHABET), (F.shiftright(value, 35 - 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*chars)


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each row. Of equal payloads of at least ``least_bytes`` the smallest id's is a response, others revisit it.

    A null payload is empty. Rows that share the smallest id are all responses; null ids come last, and
    if a payload has null ids only, its rows are responses. A null url is left out, and line ends in one are dropped. Repeated rows
    are records each, an empty table gives archives without records, payloads may be of any size that a string can have,
    and extra columns are ignored. Only digests shuffle, never payloads unless very many repeat.
    """
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col).cast("string"), r"[\r\n]", "").alias("url"), text.alias("payload"), F.octet_length(text).alias("length"), F.sha1(text.cast("binary")).alias("hexed"))
    narrow = cut(rows.select("id", "length", "hexed"))
    repeated = cut(narrow.where(F.col("length") >= least_bytes).groupBy("hexed").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    marked = rows.join(F.broadcast(repeated) if _few(repeated) else repeated, "hexed", "left")
    revisit = F.coalesce((F.col("length") >= least_bytes) & (F.col("first") < F.coalesce("id", F.lit(2**63 - 1))), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("length"), F.lit(END))
    header = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")), F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n")), F.lit("")), F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("hexed")), F.lit("\r\nWARC-Payload-Length: "), F.col("length"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(F.lit("\r\n")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("length")), F.lit(END),
    )
    record = F.concat(header, http, F.when(revisit, "").otherwise(F.col("payload")))
    marked.select(record.alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    """What stands between the candidates, in file order within each split (file, block)."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), *columns)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows candidates within each split. Emits (file, block, place, exit) for each candidate, and the split's width as exit of place -1.

    Places count from the split's first piece; a candidate whose successor isn't one has exit -1.
    """

    def done(split: tuple, places: list[int], spans: list[int], width: int) -> pa.RecordBatch:
        exits: dict[int, int] = {}
        for place, span in zip(reversed(places), reversed(spans), strict=True):
            to = place + span
            exits[place] = to if to >= width else exits.get(to, -1)
        at = [-1, *exits]
        return pa.record_batch({"file": pa.array([split[0]] * len(at)), "block": pa.array([split[1]] * len(at), pa.int64()), "place": pa.array(at, pa.int64()), "exit": pa.array([width, *exits.values()], pa.int64())})

    split, places, spans, width = None, [], [], 0
    for batch in batches:
        for file, block, length, span in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (file, block) != split:
                if split is not None:
                    yield done(split, places, spans, width)
                split, places, spans, width = (file, block), [], [], 0
            if span is not None:
                places.append(width)
                spans.append(span)
            width += length + len(MAGIC)
    if split is not None:
        yield done(split, places, spans, width)


def _splits(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """``file, block, base, entry, following`` of each split, and whether a record may reach beyond its split.

    entry: place of the first record in the split that can be reached from the file's start; following: the place
    of the next reachable record at or after the split's start, or the file's end. Splits link by their candidates' exits,
    so pointer jumping takes as many rounds as the logarithm of the splits of a file.
    """
    value = F.col("value")
    head = F.substring_index(value, END, 1)
    length = F.octet_length(value)
    content = F.try_to_number(F.nullif(F.regexp_extract(head, r"(?im)^content-length:[ \t]*([0-9]{1,15})[ \t]*\r?$", 1), F.lit("")), F.lit("9" * 15)).cast("long")
    sound = head.rlike(r"(?im)^warc-type:") & (F.octet_length(head) < length)
    span = F.when(sound, F.octet_length(head) + len(END) + content + len(END) + len(MAGIC)).cast("long")
    found = cut(_pieces(spark, path, length.cast("long").alias("length"), span.alias("span")).mapInArrow(_chains, "file string, block long, place long, exit long"))
    widths = found.where("place < 0").select("file", "block", F.col("exit").alias("width"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = widths.withColumn("base", F.sum("width").over(in_file) - F.col("width")).withColumn("of_file", F.count(F.lit(1)).over(Window.partitionBy("file")))
    bases = cut(bases)
    nodes = found.where("place >= 0 AND exit >= 0").join(bases, ["file", "block"]).select("file", "block", (F.col("base") + F.col("place")).alias("at"), (F.col("base") + F.col("exit")).alias("to"))
    targets = nodes.select("file", F.col("to").alias("at")).distinct()
    starts = bases.select("file", F.lit(len(MAGIC)).cast("long").alias("at")).distinct()
    nodes = cut(nodes.join(targets.union(starts).distinct(), ["file", "at"], "left_semi"))
    jumps, reached = nodes.select("file", "at", "to"), cut(starts.join(nodes, ["file", "at"], "left_semi").select("file", "at"))
    rounds = (bases.agg(F.max("of_file")).first()[0] or 0).bit_length()
    for _ in range(rounds):
        reached = cut(reached.union(reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct())
        ahead = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = cut(jumps.join(ahead, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")))
    entries = nodes.join(reached, ["file", "at"], "left_semi").groupBy("file", "block").agg(F.min("at").alias("entry"), F.min_by("to", "at").alias("to"))
    later = Window.partitionBy("file").orderBy("block").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    splits = bases.join(entries, ["file", "block"], "left").withColumn("total", F.sum("width").over(Window.partitionBy("file")))
    splits = cut(splits.select("file", "block", "base", "entry", F.coalesce(F.first("entry", ignorenulls=True).over(later), "total").alias("following"), (F.col("to") > F.col("base") + F.col("width")).alias("beyond")))
    return splits.drop("beyond"), not splits.where("beyond").isEmpty()


def _records(fragments: bool):
    """Complete records of each split, or (``fragments``) the parts of those that reach beyond one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic, end = MAGIC.encode(), END.encode()
        split, place, record, start, expected = None, 0, [], 0, None
        for batch in batches:
            out: list[tuple] = []

            def close() -> None:
                if split is not None and record and fragments:
                    out.append((split[0], expected, start, True, magic.join(record)))

            for file, block, base, entry, following, value in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (file, block) != split:
                    close()
                    split, place, record, expected = (file, block), base, [], entry
                if expected is None or not record and place < expected:
                    if fragments:
                        out.append((file, following, place, False, value))
                elif record or place == expected:
                    if not record:
                        start = place
                        head, _, _ = value.partition(end)
                        size = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
                        expected = place + len(head) + len(end) + int(size[1]) + len(end) + len(magic) if size else None
                    record.append(value)
                    if place + len(value) + len(magic) == expected:
                        if not fragments:
                            out.append((file, expected, start, True, magic.join(record)))
                        record = []
                place += len(value) + len(magic)
            yield pa.record_batch(dict(zip(("file", "key", "place", "head", "data"), (pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))), strict=True)))
        if split is not None and record and fragments:
            yield pa.record_batch({"file": pa.array([split[0]]), "key": pa.array([expected], pa.int64()), "place": pa.array([start], pa.int64()), "head": pa.array([True]), "data": pa.array([magic.join(record)], pa.binary())})

    return run


def _assemble(table: pa.Table) -> pa.Table:
    """One record of its parts in order; parts without a head belong to none."""
    table = table.sort_by("place")
    if not table.num_rows or not table["head"][0].as_py():
        return table.slice(0, 0)
    return table.slice(0, 1).set_column(4, "data", pa.array([MAGIC.encode().join(table["data"].to_pylist())], pa.binary()))


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, record_type, record_id, target_uri, refers_to, declared_digest, declared_length, payload`` of each record.

    Files are split; each task emits candidate records with their successors, pointer jumping from the file's start finds
    those that are reachable, and a record start within a payload isn't one. A chain that breaks ends its file. Records may
    reach over many splits. Empty files and folders give no rows; a header that lacks a field gives null for it.
    """
    splits, beyond = _splits(spark, path)
    few = _few(splits)
    pieces = _pieces(spark, path, F.col("value").cast("binary").alias("value")).withColumn("i", F.monotonically_increasing_id()).join(F.broadcast(splits) if few else splits, ["file", "block"])
    if not few:
        pieces = pieces.sortWithinPartitions("file", "block", "i")
    pieces = pieces.select("file", "block", "base", "entry", "following", "value")
    schema = "file string, key long, place long, head boolean, data binary"
    records = pieces.mapInArrow(_records(False), schema)
    if beyond:
        records = records.unionByName(pieces.mapInArrow(_records(True), schema).groupBy("file", "key").applyInArrow(_assemble, schema))
    text = F.col("data")
    at = F.expr("locate(decode(unhex('0D0A0D0A'), 'ISO-8859-1'), decode(data, 'ISO-8859-1'))")
    head = F.decode(F.substring(text, F.lit(1), at - 1), "UTF-8")
    rows = records.withColumn("head_end", at).withColumn("head_text", head).withColumn("block", F.expr("substring(data, head_end + 4, length(data) - head_end - 7)"))
    body = F.expr("locate(decode(unhex('0D0A0D0A'), 'ISO-8859-1'), decode(block, 'ISO-8859-1'))")
    return rows.select(
        "file", (F.col("place") - len(MAGIC)).alias("offset"), _field(F.col("head_text"), "warc-type").alias("record_type"), _field(F.col("head_text"), "warc-record-id").alias("record_id"),
        _field(F.col("head_text"), "warc-target-uri").alias("target_uri"), _field(F.col("head_text"), "warc-refers-to").alias("refers_to"), _field(F.col("head_text"), "warc-payload-digest").alias("declared_digest"),
        _field(F.col("head_text"), "warc-payload-length").cast("long").alias("declared_length"), F.substring(F.col("block"), body + 4, F.lit(2**31 - 1)).alias("payload"),
    )


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``; a response's figures are those of the payload read."""
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '([0-9-]+)>$', 1), '') AS BIGINT)")
    rows = read_archives(spark, path).withColumn("hexed", F.sha1("payload"))
    full = F.col("record_type") == "response"
    return rows.select(
        number("record_id").alias("page_id"), F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("declared_length")).alias("payload_bytes"),
        F.when(full, base32(F.col("hexed"))).otherwise(F.substring_index("declared_digest", ":", -1)).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )
