"""Fill-in-the-middle forms of texts, cut at token boundaries by rank and select over packed bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import joined, slices

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits for which the directory has one count.
BLOCK = 8
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class BitVector:
    """Bits packed into 64-bit words, and a directory of the set bits before each block of words: rank and select look at one block."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // (64 * BLOCK) + 1) * 8 * BLOCK, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8").reshape(-1, BLOCK)
        self.directory = np.r_[0, np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block, word = at // (64 * BLOCK), at // 64 % BLOCK
        before = np.bitwise_count(self.words[block]) * (np.arange(BLOCK) < word[:, None])
        low = self.words[block, word] & ((np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1))
        return self.directory[block] + before.sum(axis=1, dtype=np.int64) + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the set bit that has ``k`` set bits before it."""
        block = np.searchsorted(self.directory, k, "right") - 1
        counts = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        rest = k - self.directory[block]
        word = (counts <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(word > 0, counts[np.arange(len(k)), np.maximum(word - 1, 0)], 0)
        bits = np.cumsum(self.words[block, word][:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1), axis=1, dtype=np.int64)
        return (block * BLOCK + word) * 64 + (bits <= rest[:, None]).sum(axis=1)


def boundaries(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True at each byte where a token starts: at a text's first byte, and at white space after anything else. ``starts`` has the texts' first bytes."""
    white = _SPACE[data]
    first = white.copy()
    first[1:] &= ~white[:-1]
    first[starts] = True
    return first


def _marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a marker."""
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], [ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)])]
    row = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[row[at + 2 < offsets[row + 1]]] = True
    return out


def _formed(batch: pa.RecordBatch, rate: int, spm_rate: int) -> pa.RecordBatch:
    data, offsets = joined(batch.column(1))
    begin, end = offsets[:-1], offsets[1:]
    h1, h2, h3, h4 = (batch.column(2 + i).to_numpy() for i in range(4))
    tokens, chars = BitVector(boundaries(data, begin[begin < end])), BitVector(data & 0xC0 != 0x80)
    before = tokens.rank(begin)
    n = tokens.rank(end) - before
    cuts = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        place = end.copy()
        place[k < n] = tokens.select((before + k)[k < n])
        cuts.append(place)
    plain = (n == 0) | _marked(data, offsets) | (h3 % 100 >= rate)
    form = np.where(plain, "plain", np.where(h4 % 100 < spm_rate, "spm", "psm"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    output, raw = [], data.tobytes()
    for kind, a, b, c, d in zip(form.tolist(), begin.tolist(), cuts[0].tolist(), cuts[1].tolist(), end.tolist(), strict=True):
        if kind == "plain":
            output.append(raw[a:d])
        elif kind == "psm":
            output.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
        else:
            output.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
    at = [chars.rank(x) for x in (begin, *cuts)]
    return pa.record_batch({
        "doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()),
        "prefix_chars": pa.array(at[1] - at[0], pa.int64(), mask=plain), "middle_chars": pa.array(at[2] - at[1], pa.int64(), mask=plain), "output": pa.array(output, pa.binary()),
    })


def draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:id``; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each row: its text in one of the forms plain, psm and spm.

    A token is white space with the run of other bytes after it, or white space at the end. Of each slice of texts the token starts are
    packed bits with a directory of counts: the difference of two ranks is a text's ``n``, and select gives the bytes
    at which the prefix and the middle end; code points are counted by rank over a second vector. ``rate`` and ``spm_rate``
    are percentages: of texts that get cut, and of those that put the suffix first. Nothing is shuffled.

    A null text is empty; an empty text, and one that holds a marker, stays plain, with null counts of characters. A null id
    draws as no digits. Rows with one id and text give equal rows; very long texts are cut whole, in memory of a few
    times their bytes; an empty table gives an empty one; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield _formed(part, rate, spm_rate)

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *draws(id_col, seed))
    return wanted.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary").withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text from which an output was made: markers can't stand in it, so the first one of each kind ends its part."""
    body = F.substring(output, len(PREFIX) + 1, 2_147_483_647)
    after = lambda text, mark: F.substring(text, F.length(F.substring_index(text, mark, 1)) + len(mark) + 1, F.length(text))
    first, rest = lambda mark: F.substring_index(body, mark, 1), lambda mark: after(body, mark)
    psm = F.concat(first(SUFFIX), after(rest(SUFFIX), MIDDLE), F.substring_index(rest(SUFFIX), MIDDLE, 1))
    spm = F.concat(rest(PREFIX).substr(F.lit(1), F.length(F.substring_index(rest(PREFIX), MIDDLE, 1))), after(rest(PREFIX), MIDDLE), first(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def oracle_sql() -> str:
    space = r"\x20\x09-\x0D"
    return rf"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[{space}]*[^{space}]+|[{space}]+') AS t FROM documents
), drawn AS (
  SELECT *, len(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(t) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(t) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut
), parts AS (
  SELECT *, coalesce(array_to_string(t[1:least(x, y)], ''), '') AS p, coalesce(array_to_string(t[least(x, y) + 1:greatest(x, y)], ''), '') AS m, coalesce(array_to_string(t[greatest(x, y) + 1:], ''), '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
