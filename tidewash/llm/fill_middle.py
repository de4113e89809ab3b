"""Fill-in-the-middle samples: documents cut twice and put together in another order.

A text is a sequence of units (lines, or single code points). Its bytes are held in
fixed blocks, and a Fenwick tree over the blocks has the number of units and of code
points of each. Going down the tree by halves finds the block that holds a wanted
unit's end, and with it the units and code points before the block; the place within
the block is looked up locally. Cuts, and whether and in which order a document is put
together, are drawn from a hash of the document's id, so every run gives the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewash.llm.registry import query, table
from tidewash.llm.words import text_blocks

#: Bytes of text in one block of the tree.
BLOCK = 4096
#: The marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("line", "character")


class Fenwick:
    """Sums over the first blocks, of several counts at once; blocks are numbered from 0."""

    def __init__(self, counts: np.ndarray):
        """``counts`` has one row per block and one column per count."""
        self.size = len(counts)
        # Node i has the blocks from i - (its lowest bit) to i, so a difference of running sums.
        sums = np.zeros((self.size + 1, counts.shape[1]), np.int64)
        np.cumsum(counts, axis=0, out=sums[1:])
        nodes = np.arange(self.size + 1)
        self.tree = sums - sums[nodes & (nodes - 1)]

    def descend(self, column: int, wanted: int) -> tuple[int, np.ndarray]:
        """The block in which the count reaches ``wanted`` (at least 1), and all counts before it.

        Halving steps from the largest power of two: a step is taken while less
        than ``wanted`` lies before its end.
        """
        at, before = 0, np.zeros(self.tree.shape[1], np.int64)
        step = 1 << max(0, self.size.bit_length() - 1)
        while step:
            if at + step <= self.size and before[column] + self.tree[at + step][column] < wanted:
                at += step
                before = before + self.tree[at]
            step >>= 1
        return at, before


class TextIndex:
    """The units of one text (its UTF-8 bytes) and where they end."""

    def __init__(self, text: bytes, unit: str = "line", block: int = BLOCK):
        self.raw = np.frombuffer(text, np.uint8)
        self.unit, self.block = unit, block
        begins = np.arange(0, len(self.raw), block)
        firsts = self._is_first(self.raw)
        ends = self._is_end(self.raw)
        counts = np.zeros((len(begins), 2), np.int64)
        if len(begins):
            counts[:, 0] = np.add.reduceat(ends, begins, dtype=np.int64)
            counts[:, 1] = np.add.reduceat(firsts, begins, dtype=np.int64)
        self.tree = Fenwick(counts)
        self.characters = int(counts[:, 1].sum())
        closed = int(counts[:, 0].sum())
        #: Units, with a last line that no line break ends.
        self.units = closed + bool(unit == "line" and len(text) and text[-1] != 0x0A)
        self.closed = closed

    def _is_first(self, raw: np.ndarray) -> np.ndarray:
        """Whether a byte is a code point's first."""
        return (raw & 0xC0) != 0x80

    def _is_end(self, raw: np.ndarray) -> np.ndarray:
        """Whether a byte counts a unit: a line break, or a code point's first byte."""
        return raw == 0x0A if self.unit == "line" else self._is_first(raw)

    def cut(self, units: int) -> tuple[int, int]:
        """The bytes and the code points of the first ``units`` units."""
        if units <= 0:
            return 0, 0
        if units > self.closed or (self.unit != "line" and units == self.closed):
            return len(self.raw), self.characters
        # A code point ends where the next one begins.
        wanted = units if self.unit == "line" else units + 1
        block, before = self.tree.descend(0, wanted)
        begin = block * self.block
        local = self.raw[begin : begin + self.block]
        place = int(np.flatnonzero(self._is_end(local))[wanted - int(before[0]) - 1])
        length = place + (self.unit == "line")
        return begin + length, int(before[1]) + int(self._is_first(local[:length]).sum())


@dataclass(frozen=True)
class Cuts:
    """How documents are drawn: shares are in hundredths."""

    seed: int = 7
    #: Documents that are cut; the rest stay plain.
    rate: int = 100
    #: Of those cut, the share with the suffix first.
    suffix_first: int = 50

    def draw(self, key: str, units: int) -> tuple[int, int, bool, bool]:
        """The two cuts, whether the document is cut at all, and whether the suffix comes first."""
        digest = hashlib.sha256(f"{self.seed}:{key}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (units + 1), h2 % (units + 1)))
        return a, b, h3 % 100 < self.rate, h4 % 100 < self.suffix_first


def rearrange(
    text: bytes, key: str, cuts: Cuts, unit: str, marks: tuple[str, str, str]
) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (None if plain), and the new text."""
    index = TextIndex(text, unit)
    a, b, cut, suffix_first = cuts.draw(key, index.units)
    p, s, m = (mark.encode() for mark in marks)
    if not text or not cut or any(mark in text for mark in (p, s, m)):
        return index.units, "plain", None, None, text
    first, first_chars = index.cut(a)
    second, second_chars = index.cut(b)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    parts = (s, suffix, p, prefix, m, middle) if suffix_first else (p, prefix, s, suffix, m, middle)
    form = "spm" if suffix_first else "psm"
    return index.units, form, first_chars, second_chars - first_chars, b"".join(parts)


def _rearrange_all(
    batches: Iterator[pa.RecordBatch], cuts: Cuts, unit: str, marks: tuple[str, str, str]
) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    for batch, texts in text_blocks(batches):
        keys = batch.column("key").to_pylist()
        found = [rearrange(t, k, cuts, unit, marks) for t, k in zip(texts, keys, strict=True)]
        columns = [pa.array([f[n] for f in found], kind) for n, kind in enumerate(kinds)]
        columns[4] = columns[4].cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *columns],
            names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def fill_in_middle(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    cuts: Cuts | None = None,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    ``n`` is the number of units; the prefix ends after the smaller of two drawn numbers
    of units and the middle after the larger. Form ``psm`` is prefix, suffix, middle,
    ``spm`` suffix, prefix, middle, each after its mark. Texts that hold a mark
    stay ``plain``, so that :func:`restored_text` is exact; so do empty ones.

    Defined results: a null text is empty; a null id draws as the empty text does;
    repeated rows get equal outputs; lengths of plain rows are null; an empty
    table gives an empty result. Other columns are not looked at. A task holds
    about a megabyte of text at once, or one text if it is longer, a few times over.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is not one of {UNITS}")
    if len(set(marks)) != 3 or any(m[1:].find(m[0]) >= 0 for m in marks if m) or "" in marks:
        raise ValueError("marks need to differ, and to have their first character only in front")
    if len({m[0] for m in marks}) != 1:
        raise ValueError("marks need to begin alike, so that none begins within another")
    cuts = cuts or Cuts()
    kind = docs.schema[id].dataType.simpleString()
    key = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))
    return (
        docs.select(F.col(f"`{id}`").alias("id"), key.alias("key"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(
            lambda batches: _rearrange_all(batches, cuts, unit, marks),
            f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
        )
        .withColumnRenamed("id", id)
    )


def restored_text(
    output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS
) -> Column:
    """The text before it was rearranged, from output and form alone."""
    parts = F.split(F.col(output), "|".join(f"\\Q{m}\\E" for m in marks), -1)
    ordered = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    found = F.when(F.col(form) == "plain", F.col(output))
    for name, places in ordered.items():
        found = found.when(F.col(form) == name, F.concat(*[F.get(parts, F.lit(k)) for k in places]))
    return found


SQL = """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS pieces,
        sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
),
counted AS (
    SELECT *, CAST(len(pieces) - CASE WHEN pieces[len(pieces)] = '' THEN 1 ELSE 0 END AS BIGINT) AS n,
        CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM texts
),
drawn AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
            OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM counted
),
-- The text up to a cut: its lines with their breaks, but without one after the last piece.
ended AS (
    SELECT *, array_to_string(pieces[1:a], chr(10))
            || CASE WHEN a > 0 AND a < len(pieces) THEN chr(10) ELSE '' END AS prefix,
        array_to_string(pieces[1:b], chr(10))
            || CASE WHEN b > 0 AND b < len(pieces) THEN chr(10) ELSE '' END AS upto
    FROM drawn
),
parts AS (
    SELECT *, substr(upto, length(prefix) + 1) AS middle, substr(body, length(upto) + 1) AS suffix
    FROM ended
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN body
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(body) AS restored_sha256
FROM parts
"""


@query("op13_fill_in_middle", sql=SQL)
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle(table(spark, folder, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored_text(), 256).alias("restored_sha256"),
    )
