"""Fill-in-the-middle: a text is cut in three at unit ends and its parts change places.

A unit is a word with the white space before it, or the white space at a text's end (white space:
space, tab to carriage return). Texts of an Arrow batch lie end to end in one buffer, each padded
with spaces to whole 64-bit words. A byte that ends a unit gets its high bit marked, eight bytes at a
time, by arithmetic that no carry leaves a byte in; ``bitwise_count`` gives the marks of a word, and
their running sum the units before it. A text's k-th unit ends in the word that a search in the
running sums finds, at the byte where the word has the mark wanted.

Forms: ``plain`` (the text), ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle), ``spm`` (``<S>``
suffix ``<P>`` prefix ``<M>`` middle). Form and cuts depend on the seed and doc_id alone. A text that
is empty or holds a sentinel is plain, so an output splits at its sentinels in one way only.

A null text is empty. A null id counts as the id of no digits. Repeated rows and ids each keep a row.
Other columns are ignored. An empty table gives an empty one. A very long text stands whole in its
task, with about four times its bytes. Bytes that aren't UTF-8 are counted as the characters that
they would start.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import byte_view, only, released, slices, table

P, S, M = b"<P>", b"<S>", b"<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _of(byte: int) -> np.uint64:
    """The byte in all eight places of a word."""
    return np.uint64(byte * 0x0101010101010101)


LOW, HIGH = _of(0x7F), _of(0x80)


def white_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is white space, and no other bit. Seven bits and a constant of
    at most 0x7f stay below 0x100, so sums don't reach the next byte."""
    low = words & LOW
    control = (low + _of(0x80 - 9)) & ~(low + _of(0x80 - 14))  # 9 to 13
    other = words ^ _of(0x20)
    space = ~((other & LOW) + LOW | other)
    return (control & ~words | space) & HIGH


def unit_marks(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The high bit of every byte that ends a unit: one that isn't white before one that is, and the
    texts' ``last`` bytes (places in the buffer). Each text has white padding behind it."""
    white = white_marks(words)
    following = white >> np.uint64(8)
    following[:-1] |= white[1:] << np.uint64(56)
    ends = ~white & following & HIGH
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7) << 3).astype(np.uint64))
    return ends


class Units:
    """The ends of the units of texts that lie end to end in ``flat``, between ``offsets``."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        self.first = np.concatenate([[0], np.cumsum(sizes // 8 + 1)])  # each text's first word
        buffer = np.full(int(self.first[-1]) * 8, 0x20, np.uint8)
        for to, a, b in zip((self.first[:-1] * 8).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            buffer[to : to + b - a] = flat[a:b]
        self.marks = unit_marks(buffer.view("<u8"), (self.first[:-1] * 8 + sizes - 1)[sizes > 0])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])
        self.n = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def end_of(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The byte, in each text, behind its first k units (0 <= k <= n)."""
        wanted = self.before[self.first[text]] + k
        word = np.searchsorted(self.before, wanted) - 1  # its marks reach the number wanted
        some = k > 0
        word = np.where(some, word, 0)
        rank = wanted - self.before[word]
        marks = self.marks[word] if len(self.marks) else np.zeros(len(word), np.uint64)
        for r in range(1, 8):  # drop the lowest marks until the one wanted is lowest
            marks = np.where(rank > r, marks & (marks - np.uint64(1)), marks)
        byte = np.bitwise_count((marks & (~marks + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        return np.where(some, (word - self.first[text]) * 8 + byte + 1, 0)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def characters(part: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(part, np.uint8) & 0xC0 != 0x80))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, percent_spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document: its units, and its text
    in the form drawn. ``percent`` of the texts are cut, ``percent_spm`` of those have the suffix first."""

    @released()
    def run(batches):
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            flat, offsets = byte_view(batch.column(1))
            units = Units(flat, offsets)
            h = np.array([draws(seed, i) for i in ids], np.int64).reshape(-1, 4)
            at = np.sort(h[:, :2] % (units.n + 1)[:, None], axis=1)
            which = np.arange(len(ids))
            cut_a, cut_b = units.end_of(which, at[:, 0]).tolist(), units.end_of(which, at[:, 1]).tolist()
            whole = flat.tobytes()
            forms, outputs, prefixes, middles = [], [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                text = whole[a:b]
                if not text or h[i, 2] % 100 >= percent or P in text or S in text or M in text:
                    forms.append("plain")
                    outputs.append(text)
                    prefixes.append(None)
                    middles.append(None)
                    continue
                prefix, middle, suffix = text[: cut_a[i]], text[cut_a[i] : cut_b[i]], text[cut_b[i] :]
                spm = h[i, 3] % 100 < percent_spm
                forms.append("spm" if spm else "psm")
                outputs.append(S + suffix + P + prefix + M + middle if spm else P + prefix + S + suffix + M + middle)
                prefixes.append(characters(prefix))
                middles.append(characters(middle))
            columns = [batch.column(0), pa.array(units.n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64())]
            out = pa.Array.from_buffers(pa.large_string(), len(outputs), [None, pa.py_buffer(np.cumsum([0, *map(len, outputs)], dtype=np.int64)), pa.py_buffer(b"".join(outputs))])
            yield pa.RecordBatch.from_arrays([*columns, out.cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)


def restored(form: F.Column, output: F.Column) -> F.Column:
    """The text from its output: the parts between the sentinels in their old order."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256")
    )


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
numbers AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4
  FROM drawn),
parts AS (
  SELECT doc_id, text, n, coalesce(array_to_string(units[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
         coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
