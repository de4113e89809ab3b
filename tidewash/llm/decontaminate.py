"""Documents that quote test questions or answers, by one automaton over all of them.

The items are normalised and cut into windows of consecutive words; an
Aho-Corasick automaton holds every window once and reads each normalised
document once. Matches give word numbers, and these are mapped back to character
offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewash.functions.scratch import write_scratch
from tidewash.llm.registry import query, table
from tidewash.llm.words import text_of_rows

#: Characters of items in one automaton (some hundred bytes of memory each at the
#: most). Larger sets are cut into slices, each with an automaton of its own.
ITEM_CHARS = 4_000_000

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_PLAIN = bytes.maketrans(
    _SEPARATORS + bytes(range(0x41, 0x5B)),
    b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)),
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def windows(
    items: list[tuple], length: int, unnamed: bool = False
) -> dict[str, tuple[int, set[str]]]:
    """Every window as `` word word ... word ``, with its word count and items.

    Items with a null id have no windows, or if ``unnamed`` windows without an item.
    """
    found: dict[str, tuple[int, set[str]]] = {}
    for item_id, text in items:
        words = plain_words(text)
        if not words or (item_id is None and not unnamed):
            continue
        for start in range(max(1, len(words) - length + 1)):
            cut = words[start : start + length]
            key = f" {b' '.join(cut).decode('utf-8', 'surrogatepass')} "
            owners = found.setdefault(key, (len(cut), set()))[1]
            if item_id is not None:
                owners.add(str(item_id))
    return found


def automaton_of(found: dict[str, tuple[int, set[str]]]) -> ahocorasick.Automaton | None:
    if not found:
        return None
    machine = ahocorasick.Automaton()
    for key, value in found.items():
        machine.add_word(key, value)
    machine.make_automaton()
    return machine


def mark(text: str | None, machine) -> tuple[int, np.ndarray | None, set[str]]:
    """The word count, which words are hit (None: none), and the items hit."""
    words = plain_words(text)
    if machine is None or not words:
        return len(words), None, set()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    hit, items, spaces = None, set(), None
    for end, (count, owners) in machine.iter(line):
        if hit is None:
            hit = np.zeros(len(words), dtype=bool)
            points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            spaces = np.flatnonzero(points == 32)
        after = int(np.searchsorted(spaces, end))
        hit[after - count : after] = True
        items |= owners
    return len(words), hit, items


def hit_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """The hit words' places in the original text, neighbours joined."""
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(places[a][0], places[b - 1][1]) for a, b in edges.reshape(-1, 2)]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _hit_words(packed: bytes | None, count: int) -> np.ndarray | None:
    if packed is None:
        return None
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=count).astype(bool)


def _scan(
    batches: Iterator[pa.RecordBatch], asked: list[tuple], length: int, last: bool, unnamed: bool
) -> Iterator[pa.RecordBatch]:
    """Scan with the automaton of one slice of the items, on top of earlier slices.

    The last slice counts the hit words and gives their places in the text; the
    others pass the text and the hit words on.
    """
    machine = automaton_of(windows(asked, length, unnamed))
    for batch in batches:
        texts = batch.column("text")
        earlier = batch.column("hit_bits") if "hit_bits" in batch.schema.names else None
        n_words, hits, items = [], [], []
        for place, value in enumerate(texts):
            n, hit, found = mark(value.as_py(), machine)
            if earlier is not None:
                old = _hit_words(earlier[place].as_py(), n)
                hit = old if hit is None else hit if old is None else hit | old
                found = found | set(batch.column("items")[place].as_py())
            n_words.append(n)
            hits.append(hit)
            items.append(sorted(found))
        names = ["row", "n_words", "items"]
        columns = [
            batch.column("row"),
            pa.array(n_words, pa.int64()),
            pa.array(items, pa.list_(pa.string())),
        ]
        if last:
            names += ["n_hit", "spans"]
            counts = [0 if hit is None else int(hit.sum()) for hit in hits]
            spans = [
                []
                if hit is None
                else [{"start": a, "end": b} for a, b in hit_spans(text.as_py(), hit)]
                for text, hit in zip(texts, hits, strict=True)
            ]
            columns += [pa.array(counts, pa.int64()), pa.array(spans, _SPANS)]
        else:
            names += ["text", "hit_bits"]
            packed = [None if hit is None else np.packbits(hit).tobytes() for hit in hits]
            columns += [texts, pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _schema(kind: T.DataType, rest: str) -> T.StructType:
    fields = T.StructType.fromDDL(rest).fields
    return T.StructType([T.StructField("row", kind), *fields])


def _scanned(
    rows: DataFrame,
    items: DataFrame,
    item_id: str,
    item_text: str,
    length: int,
    item_chars: int,
    unnamed: bool,
) -> DataFrame:
    """``row, n_words, items, n_hit, spans`` from ``row`` and, unless the row has it, ``text``.

    The items are a stated set of questions. They are brought to the tasks in
    slices of at most about ``item_chars`` characters; usually that is one, and
    the documents are read once and nothing is shuffled.
    """
    asked = items.select(
        F.col(f"`{item_id}`").alias("item"),
        F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("words"),
    )
    total = asked.agg(F.sum(F.length("words"))).first()[0] or 0
    slices = max(1, -(-total // item_chars))
    kind = rows.schema["row"].dataType
    counts = "n_words long, items array<string>"
    passed_on = _schema(kind, f"{counts}, text string, hit_bits binary")
    done = _schema(kind, f"{counts}, n_hit long, spans array<struct<start:int,end:int>>")
    for number in range(slices):
        part = asked.where(F.pmod(F.xxhash64("item", "words"), F.lit(slices)) == number)
        chosen, last = [tuple(r) for r in part.collect()], number + 1 == slices
        if number:
            rows = write_scratch(rows, "scanned")
        rows = rows.mapInArrow(
            lambda b, chosen=chosen, last=last: _scan(
                _with_text(b), chosen, length, last, unnamed
            ),
            done if last else passed_on,
        )
    return rows


def _with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a ``text`` column; without one it is the first field of the ``row``."""
    for batch in batches:
        if "text" in batch.schema.names:
            yield batch
        else:
            yield from text_of_rows(iter([batch]), batch.column("row").type.field(0).name)


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    length: int = 13,
    share: int = 20,
    item_chars: int = ITEM_CHARS,
    unnamed: bool = True,
) -> DataFrame:
    """``id, n_words, n_hit, items, spans, contaminated`` for every row of ``docs``.

    A window is ``length`` consecutive words of an item, or the whole item if it
    is shorter; words inside any occurrence are hit. ``items`` lists the item ids
    as sorted strings, ``spans`` the hit regions as character offsets in the
    original text. A document is contaminated if at least one in ``share`` of its
    words is hit. Defined results: null and empty texts have no words and are
    clean; items without words match nothing; the words of items with null id are hit,
    but these items are not listed (without ``unnamed`` they match nothing); repeated
    rows are judged one by one; without items every document is clean. Other columns
    are not looked at.
    """
    rows = docs.select(F.col(f"`{id}`").alias("row"), F.col(f"`{text}`").alias("text"))
    found = _scanned(rows, items, item_id, item_text, length, item_chars, unnamed)
    return found.select(
        F.col("row").alias(id),
        "n_words",
        "n_hit",
        "items",
        "spans",
        _contaminated(share).alias("contaminated"),
    )


def _contaminated(share: int) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def keep_clean(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    length: int = 13,
    share: int = 20,
    item_chars: int = ITEM_CHARS,
    unnamed: bool = True,
) -> DataFrame:
    """The rows of ``docs`` that :func:`benchmark_hits` finds clean, with all their columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    # The text comes first in the row, where the scan finds it.
    rows = docs.select(F.struct(F.col(f"`{text}`"), *others).alias("row"))
    found = _scanned(rows, items, item_id, item_text, length, item_chars, unnamed)
    kept = found.where(~_contaminated(share)).select("row.*")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k,
    array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS window_text
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i
        FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS window_text
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, sizes WHERE len(w) >= k)
), m AS (
  SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw USING (k, window_text)
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM m))
  GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


@query("op6_benchmark_decontamination", SQL)
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    hits = benchmark_hits(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), unnamed=True
    )
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
