"""The trie of conversations that share their first turns, by partition refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import cut

#: Ids that are joined into one string before they meet the others of their node.
CHUNK = 4_096
EMPTY = hashlib.sha256(b"").hexdigest()


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and summed characters of sorted turns within this task; a conversation may have begun in an earlier one."""
    pid, last, places, total = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, chars = (batch.column(i).to_numpy() for i in (0, 2))
        new = np.r_[last is None or conv[0] != last, conv[1:] != conv[:-1]]
        run, at, cum = np.cumsum(new), np.arange(len(conv)), np.cumsum(chars, dtype=np.int64)
        starts = np.flatnonzero(new)
        first = np.r_[0, starts][run]  # of rows that go on with the last batch's conversation it isn't used
        going_on = run == 0
        pos = np.where(going_on, places + at + 1, at - first + 1)
        cum = np.where(going_on, total + cum, cum - (cum - chars)[first])
        last, places, total = conv[-1], int(pos[-1]), int(cum[-1])
        yield pa.record_batch({"conv_id": batch.column(0), "pos": pa.array(pos, pa.int64()), "digest": batch.column(1), "chars": batch.column(2), "cum": pa.array(cum), "pid": pa.array(np.full(len(conv), pid), pa.int32())})


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, digest, chars, cum``: each conversation's turns from 1, with the code points of the turn and of all to it.

    Turns go by ``turn_col``, null first, and ties by the SHA-256 of role and text, which stands for these from here on, so texts aren't shuffled.
    Turns are sorted by ranges, so one conversation may lie over many tasks; what its turns in earlier tasks add up to is broadcast: at most
    two rows a task. Null roles and texts are empty. Rows without a conversation are left out.
    """
    role, text = _text(role_col), _text(text_col)
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), digest.alias("digest"), F.length(text).cast("long").alias("chars"), F.col(turn_col).cast("long").alias("turn"))
    rows = rows.withColumn("copy", F.monotonically_increasing_id())  # so that repeated rows can lie in several tasks
    order = ("conv_id", F.asc_nulls_first("turn"), "digest", "copy")
    local = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "chars").mapInArrow(_numbered, "conv_id long, pos long, digest binary, chars long, cum long, pid int"))
    ends = local.groupBy("pid").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    over = ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("conv_id")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("tasks")).where("tasks > 1").select("conv_id")
    parts = local.join(F.broadcast(over), "conv_id", "left_semi").groupBy("conv_id", "pid").agg(F.max("pos").alias("pos"), F.max("cum").alias("cum"))
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "pid", F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("pos_before"), F.coalesce(F.sum("cum").over(before), F.lit(0)).alias("cum_before"))
    found = local.join(F.broadcast(parts), ["conv_id", "pid"], "left")
    return found.select("conv_id", (F.col("pos") + F.coalesce("pos_before", F.lit(0))).alias("pos"), "digest", "chars", (F.col("cum") + F.coalesce("cum_before", F.lit(0))).alias("cum"))


def forked(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one: the turns, and the ids of all, those without a turn too.

    Conversation c takes the first h turns of c - c % group (all if it has fewer, none if it is absent), then its own
    turns after its first h; h is the CRC-32 of c's decimal digits modulo ``most``.
    """
    h = lambda conv: F.crc32(conv.cast("string").cast("binary")) % most
    heads = turns.where(F.col("pos") < most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars", "cum"))).alias("head"))
    bases = heads.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    convs = heads.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h(F.col("conv_id")).alias("h"), "head").join(bases, "base", "left")
    cum = lambda head: F.coalesce(F.get(head, F.size(head) - 1)["cum"], F.lit(0))
    first = lambda head: F.slice(F.coalesce(head, F.array().cast(turns_type)), F.lit(1), F.col("h").cast("int"))
    turns_type = "array<struct<pos: bigint, digest: binary, chars: bigint, cum: bigint>>"
    convs = cut(convs.select("conv_id", "h", first(F.col("base_head")).alias("taken"), cum(first(F.col("head"))).alias("left_out")))
    moves = convs.select("conv_id", (F.size("taken") - F.col("h")).alias("move"), (cum(F.col("taken")) - F.col("left_out")).alias("more"))
    own = turns.where(F.col("pos") > h(F.col("conv_id"))).join(moves, "conv_id").select("conv_id", (F.col("pos") + F.col("move")).alias("pos"), "digest", "chars", (F.col("cum") + F.col("more")).alias("cum"))
    return cut(convs.select("conv_id", F.inline("taken")).unionByName(own)), convs.select("conv_id")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of one node as text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        of, conv = (c.to_numpy() for c in batch.columns)
        new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        cuts = np.unique(np.r_[new, np.arange(0, len(of), CHUNK)])
        texts = [",".join(map(str, part.tolist())) for part in np.split(conv, cuts[1:])]
        yield pa.record_batch({"ends_of": pa.array(of[cuts]), "first": pa.array(conv[cuts]), "ids": pa.array(texts, pa.string())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node, which follow each other."""
    made = lambda: pa.record_batch({"ends_of": pa.array([of], pa.int64()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})
    of = state = None
    for batch in batches:
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != of:
                if of is not None:
                    yield made()
                of, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if of is not None:
        yield made()


def copies_hashed(pairs: DataFrame) -> DataFrame:
    """``ends_of, ends_sha256`` of pairs ``ends_of, conv_id``: the SHA-256 of the ids in order, comma-joined. Ids are sorted and joined over many tasks; one task hashes the few joined runs of a node."""
    order = ("ends_of", "conv_id")
    runs = pairs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, "ends_of long, first long, ids string")
    return runs.repartition("ends_of").sortWithinPartitions("ends_of", "first").select("ends_of", "ids").mapInArrow(_hashed, "ends_of long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: a row for each node.

    turns: ``conv_id, pos, digest, chars, cum`` as from ``numbered_turns``, already written by ``cut``; convs: all ids. A node is the set of conversations
    that agree in their first ``depth`` turns, named by the smallest. Whole copies are one weighted conversation from the start. All conversations
    are one class; each round splits the classes by their next turn. A class of one conversation is retired: the
    rest of its turns is a chain of nodes with one child each, and isn't shuffled again. So rounds, and what
    they shuffle, end with the last turn that two different conversations share.

    Folding back needs no rounds: a conversation stops being counted twice at the last turn where a smaller one goes with it, so the
    sums of a subtree are sums over the members of its top of one number each. Counts and sums of a class are taken by partial aggregation.

    No conversations give no nodes. A single one, or copies of one, give one chain; conversations without turns end at the root.
    """
    marks = turns.select("conv_id", "pos", "cum", F.xxhash64("pos", "digest").alias("a"), F.xxhash64("digest", "pos").alias("b"))
    blank = convs.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("pos", "cum", "a", "b")))
    whole = marks.unionByName(blank).groupBy("conv_id").agg(F.max("pos").alias("n_turns"), F.max("cum").alias("total"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    distinct = cut(whole.groupBy("n_turns", "total", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")))
    everything = distinct.agg(F.min("conv_id").alias("top"), F.sum("copies").alias("n"), F.sum((F.col("copies") - 1) * F.col("total")).alias("saved"), F.max(F.when(F.col("n_turns") == 0, F.struct("conv_id", "copies"))).alias("ends"), F.max("n_turns").alias("deepest")).first()
    rest = cut(turns.join(distinct.select("conv_id", "copies", "n_turns", "total"), "conv_id").withColumn("class", F.lit(everything.top).cast("long")))
    last, depth = F.col("pos") == F.col("n_turns"), 0
    rounds: list[DataFrame] = []
    while not rest.isEmpty():
        depth += 1
        now = rest.where(F.col("pos") == depth)
        groups = now.groupBy("class", "digest").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("members"), F.sum("copies").alias("n_convs"), F.max(F.when(last, F.struct("conv_id", "copies"))).alias("ends"))
        moved = now.select("conv_id", "class", "digest").join(groups, ["class", "digest"]).drop("class", "digest")
        stepped = cut(rest.join(moved, "conv_id").withColumn("depth", F.lit(depth).cast("long")))
        rounds.append(stepped)
        rest = stepped.where((F.col("pos") > depth) & (F.col("members") > 1)).withColumn("class", F.col("node")).drop("node", "members", "n_convs", "ends", "depth")
    if everything.n is None:
        return turns.sparkSession.createDataFrame([], NODES)
    if not rounds:
        stepped = rest.withColumns({"node": F.col("class"), "members": F.lit(0), "n_convs": F.lit(0).cast("long"), "ends": F.struct("conv_id", "copies"), "depth": F.lit(0).cast("long")})
        rounds.append(stepped)
    all_rounds = reduce(DataFrame.unionByName, rounds)
    at = all_rounds.where(F.col("pos") == F.col("depth"))
    heads, shared, alone = at.where("conv_id = node"), at.where("members > 1"), F.col("members") == 1
    # what a conversation gives to each shared node above: what it shares with a smaller one, its copies, and whether it ends as a leaf
    twice = shared.select("conv_id", F.when(F.col("conv_id") != F.col("node"), F.col("cum")).alias("twice"), F.lit(0).cast("long").alias("leaf"))
    gives = twice.unionByName(heads.where(alone).select("conv_id", F.lit(None).cast("long").alias("twice"), F.lit(1).cast("long").alias("leaf"))).groupBy("conv_id").agg(F.coalesce(F.max("twice"), F.lit(0)).alias("twice"), F.max("leaf").alias("leaf"))
    gives = cut(gives)
    mine = F.when(F.col("conv_id") != F.col("node"), F.col("twice")).otherwise(0)
    sums = shared.select("depth", "node", "conv_id", "copies", "total").join(gives, "conv_id").groupBy("depth", "node").agg(F.sum(mine + (F.col("copies") - 1) * F.col("total")).alias("gross"), F.sum("leaf").alias("n_leaves"))
    children = heads.groupBy((F.col("depth") - 1).alias("depth"), F.col("class").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    inner = heads.where("members > 1").join(sums, ["depth", "node"]).join(children, ["depth", "node"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("class").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (F.col("gross") - (F.col("n_convs") - 1) * (F.col("cum") - F.col("chars"))).alias("saved_tokens"), "ends",
    )
    chain = all_rounds.where(alone).select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("class")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("copies").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("copies") - 1) * (F.col("total") - F.col("cum") + F.col("chars"))).alias("saved_tokens"), F.when(last, F.struct("conv_id", "copies")).alias("ends"),
    )
    root = gives.agg(F.sum(F.when(F.col("conv_id") != everything.top, F.col("twice"))).alias("twice"), F.sum("leaf").alias("leaves")).crossJoin(heads.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"))).select(
        F.lit(everything.top).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(everything.n).cast("long").alias("n_convs"), "n_children",
        (F.coalesce("leaves", F.lit(0)) if everything.deepest else F.lit(1)).cast("long").alias("n_leaves"), (F.coalesce("twice", F.lit(0)) + everything.saved).cast("long").alias("saved_tokens"),
        (F.struct(F.lit(everything.ends.conv_id).cast("long").alias("conv_id"), F.lit(everything.ends.copies).cast("long").alias("copies")) if everything.ends else F.lit(None).cast("struct<conv_id: bigint, copies: bigint>")).alias("ends"),
    )
    nodes = inner.unionByName(chain).unionByName(root).withColumns({"ends_of": F.col("ends.conv_id"), "ended": F.coalesce("ends.copies", F.lit(0))}).drop("ends")
    copied = distinct.where("copies > 1").select("n_turns", "total", "a", "b", F.col("conv_id").alias("ends_of"))
    hashes = copies_hashed(whole.join(copied, ["n_turns", "total", "a", "b"]))
    few = nodes.where("ended < 2").withColumn("ends_sha256", F.when(F.col("ended") == 0, EMPTY).otherwise(F.sha2(F.col("ends_of").cast("string").cast("binary"), 256)))
    many = nodes.where("ended > 1").join(hashes, "ends_of")
    return few.unionByName(many).select(*(c.split()[0] for c in NODES.split(", ")))


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def oracle_sql() -> str:
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))"
    crc = f"xor({crc}, 4294967295)"
    return f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT c, c - c % 100 AS base, {crc.format(c="c")} % 6 AS h FROM (SELECT DISTINCT c FROM own)
), rebuilt AS (
  SELECT v.c, o.pos, 0 AS part, key, chars FROM convs v JOIN own o ON o.c = v.base AND o.pos <= v.h UNION ALL SELECT v.c, o.pos, 1 AS part, key, chars FROM convs v JOIN own o ON o.c = v.c AND o.pos > v.h
), turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, key, chars FROM rebuilt
), prefixes AS (SELECT c, d, chars, md5(string_agg(key, '') OVER (PARTITION BY c ORDER BY d)) AS p FROM turns UNION ALL SELECT c, 0, 0, 'root' FROM convs
), members AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM prefixes
), nodes AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY d, p
), parents AS (
  SELECT n.d, n.p, m.p AS parent, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN members m ON m.c = n.conv_id AND m.d = n.d - 1 LEFT JOIN nodes u ON u.d = m.d AND u.p = m.p
), children AS (SELECT d - 1 AS d, parent AS p, count(*) AS n FROM parents GROUP BY d, parent
), below AS (
  SELECT m.d, m.p, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM nodes n JOIN members m ON m.c = n.conv_id AND m.d <= n.d LEFT JOIN children k ON k.d = n.d AND k.p = n.p GROUP BY m.d, m.p
)
SELECT n.conv_id, n.d AS depth, q.parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN parents q USING (d, p) JOIN below b USING (d, p) LEFT JOIN children k ON k.d = n.d AND k.p = n.p
"""
