"""Packet captures: ``read_pcap`` for captures of any size and number, and ``spark.read.format("pcap")`` / ``df.write.format("pcap")``."""

from __future__ import annotations

import io
import itertools
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from netquarry.operators.decode import Frames
from netquarry.sources.files import cut, located, running_totals

SCHEMA = "source_file string, packet_no bigint, ts_sec int, ts_usec int, incl_len int, orig_len int, data binary"
# The magic number in the file's byte order, sizes of the headers, and the most bytes of a frame.
MAGIC, FILE_HEADER, RECORD_HEADER, MOST_BYTES = 0xA1B2C3D4, 24, 16, 65_535
ROWS, BYTES_AT_ONCE = 10_000, 4 << 20
#: Bytes after which a task goes on in another file, and bytes of a file that one task reads.
FILE_BYTES, PIECE_BYTES = 256 << 20, 64 << 20
#: Bytes of a piece whose chains are held at a time; more than a record's, as all places where a piece's first record may start lie in the first of them.
CHAIN_BYTES = 1 << 19
#: The data source numbers packets file by file: a file's place times this, and the packet's place in it.
FILE_STEP = 1 << 40
COLUMNS = pa.schema([("source_file", pa.string()), ("packet_no", pa.int64()), *((c, pa.int32()) for c in ("ts_sec", "ts_usec", "incl_len", "orig_len")), ("data", pa.binary())])


@dataclass
class Header:
    order: str  # "<" or ">"
    version: tuple[int, int]
    snaplen: int
    linktype: int

    @property
    def most(self) -> int:
        return min(self.snaplen, MOST_BYTES)


def file_header(start: bytes) -> Header:
    """Raises for anything but a microsecond capture in either byte order."""
    if len(start) < FILE_HEADER:
        raise ValueError("not a capture: shorter than its header")
    for order in "<>":
        if struct.unpack_from(f"{order}I", start)[0] == MAGIC:
            major, minor = struct.unpack_from(f"{order}HH", start, 4)
            return Header(order, (major, minor), *struct.unpack_from(f"{order}II", start, 16))
    raise ValueError("not a capture of a known kind")


def signed(value: int) -> int:
    return value - (1 << 32) if value >= 1 << 31 else value


def record_header(order: str, sec: int, usec: int, kept: int) -> bytes:
    """The original length becomes that of the bytes kept."""
    return struct.pack(f"{order}IIII", sec & 0xFFFFFFFF, usec & 0xFFFFFFFF, kept, kept)


def records(stream, header: Header) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Records to the stream's end; a cut record, or one longer than may be, ends them."""
    while len(head := stream.read(RECORD_HEADER)) == RECORD_HEADER:
        sec, usec, kept, whole = struct.unpack(f"{header.order}IIII", head)
        if kept > header.most or len(data := stream.read(kept)) < kept:
            return
        yield signed(sec), signed(usec), kept, signed(whole), data


def record_starts(content: bytes, header: Header, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where up to ``n`` records begin that follow each other from the start of some bytes, and these."""
    raw, kind, at, starts = memoryview(content), struct.Struct(f"{header.order}I"), 0, []
    while len(starts) < n and at + RECORD_HEADER <= len(raw):
        kept = kind.unpack_from(raw, at + 8)[0]
        if kept > header.most or at + RECORD_HEADER + kept > len(raw):
            break
        starts.append(at)
        at += RECORD_HEADER + kept
    return np.array(starts, np.int64), np.frombuffer(content, np.uint8)


def windows(stream, header: Header, entry: int, leaves: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``record_starts`` of the ``n`` records of a piece, some megabytes of it at a time."""
    end = leaves + MOST_BYTES + RECORD_HEADER
    while n > 0:
        at, raw = record_starts(stream.read_at(min(BYTES_AT_ONCE + MOST_BYTES + RECORD_HEADER, end - entry), entry), header, n)
        if not len(at):
            return
        yield at, raw
        last = int(at[-1])
        n, entry = n - len(at), entry + last + RECORD_HEADER + int.from_bytes(raw[last + 8 : last + 12].tobytes(), "little" if header.order == "<" else "big")


def record_batches(raw: np.ndarray, header: Header, at: np.ndarray, numbers: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """Batches of the records at ``at``, some megabytes each: headers are read all at once, frames are kept by a mask over the bytes, without a Python object each."""
    start = 0
    while start < len(at):
        end = max(start + 1, min(start + ROWS, int(np.searchsorted(at, at[start] + BYTES_AT_ONCE))))
        some = at[start:end]
        heads = raw[some[:, None] + np.arange(RECORD_HEADER)].view(f"{header.order}u4")
        sec, usec, kept, whole = (heads[:, i].astype(np.uint32).view(np.int32) for i in range(4))
        ends = some + RECORD_HEADER + kept
        between = some + RECORD_HEADER - np.r_[some[0], ends[:-1]]  # headers, and what doesn't pass
        wanted = np.repeat(np.tile([False, True], len(some)), np.column_stack([between, kept]).reshape(-1))
        frames = raw[some[0] : ends[-1]][wanted]
        data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.r_[0, np.cumsum(kept)].astype(np.int32)), pa.py_buffer(frames)])
        names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(some), np.int32)), pa.array([name])).dictionary_decode()
        yield pa.record_batch([names, pa.array(numbers[start:end], pa.int64()), *(pa.array(c, pa.int32()) for c in (sec, usec, kept, whole)), data], schema=COLUMNS)
        start = end


def record_bytes(order: str, sec: np.ndarray, usec: np.ndarray, frames: Frames) -> np.ndarray:
    """Records of frames that lie one after another; the original length becomes that of the bytes kept."""
    n, size = len(frames.size), frames.size
    heads = np.empty((n, 4), f"{order}u4")
    heads[:, 0], heads[:, 1], heads[:, 2], heads[:, 3] = sec.view(np.uint32), usec.view(np.uint32), size, size
    is_frame = np.repeat(np.tile([False, True], n), np.column_stack([np.full(n, RECORD_HEADER), size]).reshape(-1))
    out = np.empty(len(is_frame), np.uint8)
    out[~is_frame] = heads.view(np.uint8).reshape(-1)
    out[is_frame] = frames.data[frames.start[0] : frames.start[-1] + size[-1]] if n else frames.data[:0]
    return out


def batches(found: Iterator[tuple], name: str, first: int) -> Iterator[pa.RecordBatch]:
    """Record batches of ``records``, numbered from ``first``."""
    for rows in itertools.batched(((name, n, *r) for n, r in enumerate(found, first)), ROWS):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), COLUMNS.types, strict=True)], schema=COLUMNS)


# -- captures read in pieces


def _start(uri: str):
    """A capture's open file and its header."""
    fs, path = located(uri)
    stream = fs.open_input_file(path)
    return stream, file_header(stream.read_at(FILE_HEADER, 0))


def chains(content: np.ndarray, begin: int, end: int, size: int, header: Header, entries: np.ndarray) -> dict[int, tuple[int, int]]:
    """For each place in ``entries`` where a record may start: where the chain of records from there leaves ``end``, and its records.

    content: the bytes from ``begin`` on, past ``end`` by a record's header. A chain that meets a wrong or cut record has exit -1.
    """
    weights = np.array([1, 1 << 8, 1 << 16, 1 << 24] if header.order == "<" else [1 << 24, 1 << 16, 1 << 8, 1], np.int64)
    inside = entries[entries - begin + RECORD_HEADER <= len(content)]
    kept = (content[(inside - begin + 8)[:, None] + np.arange(4)].astype(np.int64) * weights).sum(axis=1)
    sound = inside[(kept <= header.most) & (inside + RECORD_HEADER + kept <= size)]
    raw, kind, known = content.tobytes(), struct.Struct(f"{header.order}I"), {}
    for entry in sound.tolist():
        path, at = [], entry
        while begin <= at < end and at not in known:
            path.append(at)
            kept = kind.unpack_from(raw, at - begin + 8)[0] if at - begin + RECORD_HEADER <= len(raw) else MOST_BYTES + 1
            at = at + RECORD_HEADER + kept if kept <= header.most and at + RECORD_HEADER + kept <= size else -1
        leaves, n = known.get(at, (at, 0))
        if leaves < 0 and at < 0:
            known[path.pop()] = (-1, 0)
        for place in reversed(path):
            n += 1
            known[place] = (leaves, n)
    return {e: known[e] for e in sound.tolist()}


def piece_chains(stream, begin: int, end: int, size: int, header: Header, entries: np.ndarray) -> dict[int, tuple[int, int]]:
    """``chains`` through a piece of any size, block by block: the places where chains leave a block, few as they fall in with each other, are the entries of the next. Only a block's chains are held.

    ``entries`` lie in the first block."""
    found, tails = None, {}
    for read in range(begin, end, BYTES_AT_ONCE):
        upto = min(end, read + BYTES_AT_ONCE)
        content = np.frombuffer(stream.read_at(min(size, upto + RECORD_HEADER) - read, read), np.uint8)
        for start in range(read, upto, CHAIN_BYTES):
            stop = min(upto, start + CHAIN_BYTES)
            block = content[start - read : stop + RECORD_HEADER - read]
            if found is None:
                found = chains(block, start, stop, size, header, entries)
                tails = {leaves: (leaves, 0) for leaves, _ in found.values()}
                continue
            inside = {at for at, _ in tails.values() if start <= at < stop}
            on = dict.fromkeys(inside, (-1, 0)) | chains(block, start, stop, size, header, np.array(sorted(inside), np.int64))
            tails = {leaves: (on[at][0], n + on[at][1]) if at in inside else (at, n) for leaves, (at, n) in tails.items()}
    return {entry: (tails[leaves][0], n + tails[leaves][1]) for entry, (leaves, n) in (found or {}).items()}


def _candidates(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains through each piece: from the file's header in the first piece, from anywhere that a record could start in others."""
    for batch in parts:
        for name, size, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            stream, header = _start(name)
            entries = np.array([FILE_HEADER]) if begin == 0 else np.arange(begin, min(end, begin + header.most + RECORD_HEADER))
            with stream:
                found = piece_chains(stream, begin, end, size, header, entries)
            yield pa.record_batch({
                "source_file": pa.array([name] * len(found), pa.string()), "entry": pa.array(list(found), pa.int64()), "end": pa.array([end] * len(found), pa.int64()), "leaves": pa.array([x for x, _ in found.values()], pa.int64()), "n": pa.array([n for _, n in found.values()], pa.int64()),
            })


def _ranked(candidates: DataFrame, most_pieces: int) -> DataFrame:
    """Of the candidates the chains that join up from their file's start, with the packets ``before`` each: list ranking by pointer jumping.

    A chain can only be joined where another one leaves, and the chains of a piece soon fall in with each other, so few of a piece's
    candidates are left. Each round doubles what a pointer jumps over; then the chains reached from the start are
    doubled from the longest jumps down. No file is gathered anywhere: all steps are joins by (file, place).
    """
    first = F.col("entry") == FILE_HEADER
    exits = candidates.select("source_file", F.col("leaves").alias("entry")).distinct()
    nodes = cut(candidates.where(first).unionByName(candidates.where(~first).join(exits, ["source_file", "entry"], "left_semi")))
    jumps = [nodes.where("leaves >= 0").select("source_file", "entry", F.col("leaves").alias("to"), "n")]
    while 1 << len(jumps) < most_pieces:
        near, far = jumps[-1].alias("near"), jumps[-1].select(F.col("source_file").alias("of"), F.col("entry").alias("at"), F.col("to").alias("over"), F.col("n").alias("more"))
        jumps.append(cut(near.join(far, (F.col("near.source_file") == F.col("of")) & (F.col("near.to") == F.col("at"))).select("source_file", "entry", F.col("over").alias("to"), (F.col("n") + F.col("more")).alias("n"))))
    reached = nodes.where(first).select("source_file", "entry", F.lit(0).cast("long").alias("before"))
    for jump in reversed(jumps):
        reached = cut(reached.unionByName(reached.join(jump, ["source_file", "entry"]).select("source_file", F.col("to").alias("entry"), (F.col("before") + F.col("n")).alias("before"))))
    return nodes.where("n > 0").join(reached, ["source_file", "entry"])


def capture_pieces(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``source_file, entry, leaves, n, number``: where the records of each piece begin and end, how many they are, and the number of the first over all captures.

    A file of any size is cut into pieces. Where a record starts can't be told from within a file, so each piece gives the chains of
    records from all places where one could start, and those that join up from the file's start are kept. Files
    are opened by pyarrow, which knows local and mounted folders, S3, GCS and HDFS. The table (a row for each piece) is kept once made.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), "length")
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / piece_bytes) - 1, F.lit(0)).cast("long"))
    cuts = files.select("source_file", "length", F.explode(pieces).alias("i"))
    cuts = cuts.select("source_file", "length", "i", (F.col("i") * piece_bytes).alias("begin"), F.least((F.col("i") + 1) * piece_bytes, "length").alias("end"))
    size = cuts.agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("end") - F.col("begin")).alias("bytes"), F.coalesce(F.max("i"), F.lit(0)).alias("last")).first()
    found = cut(cuts.drop("i").repartition(_tasks(spark, size.pieces, size.bytes)).mapInArrow(_candidates, "source_file string, entry long, end long, leaves long, n long"))
    true = cut(_ranked(found, size.last + 1))
    bases = running_totals(true.groupBy("source_file").agg(F.sum("n").alias("of_file")), "source_file", "of_file").select("source_file", F.col("before").alias("base"))
    # of a chain that breaks what stands before the break is read
    leaves = F.when(F.col("leaves") >= 0, F.col("leaves")).otherwise(F.col("end"))
    return cut(true.join(bases, "source_file").select("source_file", "entry", leaves.alias("leaves"), "n", (F.col("base") + F.col("before")).alias("number")))


#: Packets for which one bitmap tells which of them pass: Spark's own bitmaps have so many bits.
BUCKET = 1 << 15


def passing_bitmaps(numbers: DataFrame) -> DataFrame:
    """``bucket, bits`` of a column of packet numbers: a bit for each packet of a bucket of the capture, set for those given."""
    at = F.col("packet_no") + 1  # Spark counts from 1
    return numbers.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def with_bitmaps(pieces: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Pieces with the bitmaps of their packets, ``passing``; a piece without any is left out."""
    bucket = lambda number: (number / BUCKET).cast("long") + 1
    over = pieces.withColumn("bucket", F.explode(F.sequence(bucket(F.col("number")), bucket(F.col("number") + F.col("n") - 1))))
    return over.join(bitmaps, "bucket").groupBy("source_file", "entry", "leaves", "n", "number").agg(F.collect_list(F.struct("bucket", "bits")).alias("passing"))


def _read_pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of pieces, of those with bitmaps the ones that pass."""
    for batch in parts:
        for i in range(batch.num_rows):  # one at a time, as each may hold bitmaps
            row = batch.slice(i, 1).to_pylist()[0]
            yield from _piece(row["source_file"], row["entry"], row["leaves"], row["n"], row["number"], row.get("passing"))


def _piece(name: str, entry: int, leaves: int, n: int, number: int, passing: list | None) -> Iterator[pa.RecordBatch]:
    stream, header = _start(name)
    bits = None if passing is None else {p["bucket"]: np.frombuffer(p["bits"], np.uint8) for p in passing}
    with stream:
        for at, raw in windows(stream, header, entry, leaves, n):
            numbers, end = number + np.arange(len(at)), number + len(at)
            if bits is not None:
                none = np.zeros(BUCKET // 8, np.uint8)
                stay = np.concatenate([np.unpackbits(bits.get(b + 1, none), bitorder="little")[max(0, number - b * BUCKET) : end - b * BUCKET] for b in range(number // BUCKET, (end - 1) // BUCKET + 1)]).astype(bool)
                at, numbers = at[stay], numbers[stay]
            yield from record_batches(raw, header, at, numbers, name)
            number = end


def read_pieces(pieces: DataFrame) -> DataFrame:
    """The packets of ``capture_pieces``, those of a piece in order."""
    return pieces.mapInArrow(_read_pieces, SCHEMA)


def read_pcap(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """All packets of the captures at ``path`` (a glob, or a folder), as one capture: files in the order of their names, ``packet_no`` from 0 over all of them. Files are read in pieces, see ``capture_pieces``."""
    return read_pieces(dealt(capture_pieces(spark, path, piece_bytes)))


def dealt(pieces: DataFrame) -> DataFrame:
    """Pieces in tasks of about PIECE_BYTES."""
    size = pieces.agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("leaves") - F.col("entry")).alias("bytes")).first()
    return pieces.repartition(_tasks(pieces.sparkSession, size.pieces, size.bytes), "source_file", "entry")


def dealt_in_order(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Some of the pieces in the order of their packets, in as many tasks as the bytes of ``pieces`` ask for. What a row itself weighs says nothing of the work, so Spark isn't left to coalesce tasks by it."""
    size = pieces.agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("leaves") - F.col("entry")).alias("bytes")).first()
    return rows.repartitionByRange(_tasks(pieces.sparkSession, size.pieces, size.bytes), "number").sortWithinPartitions("number")


def _tasks(spark: SparkSession, pieces: int, size: int | None) -> int:
    return max(1, min(pieces, max(spark.sparkContext.defaultParallelism, -(-(size or 0) // PIECE_BYTES))))


def packets_between(pieces: DataFrame, first: int, end: int) -> DataFrame:
    """The packets numbered from ``first`` up to ``end``: only pieces that hold some of them are opened, as the table of pieces tells their numbers."""
    some = pieces.where((F.col("number") < end) & (F.col("number") + F.col("n") > first))
    return read_pieces(dealt(some)).where((F.col("packet_no") >= first) & (F.col("packet_no") < end))


def _times(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        least, most = [], []
        for row in batch.to_pylist():
            stream, header = _start(row["source_file"])
            with stream:
                seconds = [raw[at[:, None] + np.arange(4)].view(f"{header.order}u4").astype(np.uint32).view(np.int32) for at, raw in windows(stream, header, row["entry"], row["leaves"], row["n"])]
            least.append(min(int(s.min()) for s in seconds))
            most.append(max(int(s.max()) for s in seconds))
        yield pa.record_batch([*batch.columns, pa.array(least, pa.int32()), pa.array(most, pa.int32())], names=[*batch.schema.names, "least_sec", "most_sec"])


def with_times(pieces: DataFrame) -> DataFrame:
    """Pieces with the least and the greatest second of their packets, which need not be in order; kept once made, so that ranges of time can be looked for again and again."""
    return cut(dealt(pieces).mapInArrow(_times, T.StructType([*pieces.schema.fields, T.StructField("least_sec", T.IntegerType()), T.StructField("most_sec", T.IntegerType())])))


def packets_during(timed: DataFrame, first_sec: int, end_sec: int) -> DataFrame:
    """The packets of the seconds from ``first_sec`` up to ``end_sec``: only pieces of ``with_times`` that may hold some are opened."""
    some = timed.where((F.col("least_sec") < end_sec) & (F.col("most_sec") >= first_sec)).drop("least_sec", "most_sec")
    return read_pieces(dealt(some)).where((F.col("ts_sec") >= first_sec) & (F.col("ts_sec") < end_sec))


# -- the data source


class _File(InputPartition):
    pass


class _Reader(DataSourceReader):
    """One partition a file; ``read_pcap`` reads large files in pieces."""

    def __init__(self, path: str):
        self.path, self.low, self.high = path, 0, 1 << 62

    def partitions(self) -> list[InputPartition]:
        fs, path = located(self.path)
        info = fs.get_file_info(path)
        found = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".pcap")] if info.type == pyarrow.fs.FileType.Directory else [path] if info.is_file else []
        if not found:
            raise FileNotFoundError(self.path)
        return [_File((i, f)) for i, f in enumerate(sorted(found)) if i * FILE_STEP <= self.high and (i + 1) * FILE_STEP > self.low]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rank, path = partition.value
        fs, _ = located(self.path)
        with fs.open_input_stream(path) as stream:
            header = file_header(stream.read(FILE_HEADER))
            yield from batches(records(stream, header), path, rank * FILE_STEP)


class _PushingReader(_Reader):
    """Conditions on ``packet_no`` leave out the files whose numbers they exclude. Spark refuses it unless ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("packet_no",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value)
            yield f  # Spark still looks at each row


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceArrowWriter):
    """Captures of about FILE_BYTES at most of each task, renamed into place at commit: the order of names is that of partitions."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.most = int(options.get("filebytes", FILE_BYTES))
        self.order = ">" if options.get("byteorder", "little") == "big" else "<"
        self.header = struct.pack(f"{self.order}IHHiIII", MAGIC, 2, 4, 0, 0, int(options.get("snaplen", MOST_BYTES)), int(options.get("linktype", 1)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task, (fs, root) = TaskContext.get(), located(self.uri)
        fs.create_dir(root)
        paths: list[str] = []
        out, size = None, 0
        for batch in iterator:
            sec, usec = (batch.column(batch.schema.get_field_index(c)).fill_null(0).to_numpy() for c in ("ts_sec", "ts_usec"))
            frames = Frames.of(batch.column(batch.schema.get_field_index("data")))
            ends, at = np.cumsum(frames.size + RECORD_HEADER), 0
            while at < len(ends):
                done = int(ends[at - 1]) if at else 0
                upto = int(np.searchsorted(ends, done + self.most - size, "right")) if out is not None else at
                if upto <= at and (out is None or size > FILE_HEADER):
                    if out is not None:
                        out.close()
                    paths.append(f"{root}/.part-{task.partitionId():08d}-{len(paths):05d}-{task.taskAttemptId()}.tmp")
                    out, size = io.BufferedWriter(fs.open_output_stream(paths[-1]), 1 << 20), FILE_HEADER
                    out.write(self.header)
                    continue
                upto = max(at + 1, min(upto, int(np.searchsorted(ends, done + BYTES_AT_ONCE))))
                some = slice(at, upto)
                out.write(record_bytes(self.order, sec[some], usec[some], Frames(frames.data, frames.start[some], frames.size[some])))
                size, at = size + int(ends[upto - 1]) - done, upto
        if out is not None:
            out.close()
        return _Written(paths)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        kept, (fs, root) = [path for m in messages if m is not None for path in m.paths], located(self.uri)
        fs.create_dir(root)
        if self.overwrite:
            for old in fs.get_file_info(pyarrow.fs.FileSelector(root)):
                if old.path.endswith(".pcap"):
                    fs.delete_file(old.path)
        for path in kept:
            _, part, piece, _ = path.rsplit("/", 1)[1].split("-")
            fs.move(path, f"{root}/part-{part}-{piece}.pcap")
        if not kept:  # nothing passed: an empty capture
            with fs.open_output_stream(f"{root}/part-00000000-00000.pcap") as out:
                out.write(self.header)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = located(self.uri)
        for path in (path for m in messages if m is not None for path in m.paths):
            if fs.get_file_info(path).is_file:
                fs.delete_file(path)


class PcapDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown", "false").lower() == "true" else _Reader)(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapDataSource)
