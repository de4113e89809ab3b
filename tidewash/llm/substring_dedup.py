"""Repeated passages, removed from all documents but the first.

A window is a number of consecutive words of one document. Every word that some
window covers is removed if the window's words also start in a document with a
smaller id.

Two passes find the repeated windows without shuffling all of them. In the first,
windows are counted in a count-min sketch, whose estimates are never too low. What is
counted is the window's anchor, the shorter run of words in it with the smallest
hash; equal windows have equal anchors and neighbouring windows often share one, so
there are about a fifth as many anchors as windows, and an anchor's count is never
below that of a window around it. The second pass keeps only the windows that are
estimated to be repeated, and groups those exactly. Nothing is lost: a repeated
window has an estimate of two or more.

Documents are put into blocks of about equal size, shuffled once. The sketch is cut
into ranges of the anchors' hashes, and there are as many as the input needs, so its cells
grow with the input and nobody holds all of it: a block sends each of its anchors
once to the anchor's range, the range adds up the blocks' counts and answers every
block with a bit per anchor. Blocks, ranges and the parts of the exact grouping all
have a fixed size, whatever the size of the table.

Inside a block, a window that also starts in a document of the same block with a
smaller id is decided on the spot; for the others one document per window and
block goes on. So a passage that fills a third of the table is as light as any
other after the first step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewash.llm.lm_scoring import _packed, _unpacked
from tidewash.llm.registry import query, table
from tidewash.llm.words import Words, cut_words, mix, stretch_hashes, text_blocks

WINDOW = 13
ANCHOR = 5
#: Rows of the sketch.
DEPTH = 2
#: Bytes of text in one block, about.
BLOCK_TEXT = 12_000_000
#: Bytes of text for each range of the sketch (a text has about one anchor in 28), and the
#: cells of one row of a range.
RANGE_TEXT, RANGE_CELLS = 30_000_000, 1 << 22
#: Bytes of text for each part of the exact grouping.
PART_TEXT = 15_000_000
_NO_ID = np.iinfo(np.int64).max


def anchored_windows(words: Words, hashes: np.ndarray, window: int, anchor: int):
    """First word of each window, and the anchor's place and hash."""
    count = len(hashes) - window + 1
    if count <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    starts = np.flatnonzero(words.owner[window - 1 :] == words.owner[:count])
    places = np.arange(len(hashes) - anchor + 1)
    runs = stretch_hashes(hashes, places, places + anchor)
    at = sliding_window_view(runs, window - anchor + 1)[starts].argmin(axis=1) + starts
    return starts, at, runs[at]


def sketch_cells(anchors: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each anchor in every row of the sketch, rows one after another."""
    return [
        (mix(anchors + np.uint64(row + 1)) % np.uint64(cells)).astype(np.int64) + row * cells
        for row in range(DEPTH)
    ]


def _documents(docs: pa.Table) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """A block's rows as one batch, each row's id, and its number among the different rows.

    The numbers follow id and text, so they are the same whenever the block is read.
    """
    batch = docs.combine_chunks().to_batches()[0]
    ids = batch.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    text_hash = batch.column("text_hash").to_numpy()
    order = np.lexsort((text_hash, ids))
    new = first_of_run(ids[order], text_hash[order])
    number = np.empty(len(ids), np.int64)
    number[order] = np.cumsum(new) - 1
    return batch, ids, number


def _once(batch: pa.RecordBatch, number: np.ndarray) -> Iterator[tuple[np.ndarray, Words]]:
    """The block's words by slices, with the rows of each; of repeated rows only the first's."""
    first = np.zeros(len(number), bool)
    first[np.unique(number, return_index=True)[1]] = True
    at = 0
    for some, raw in text_blocks(iter([batch])):
        rows = np.arange(at, at + some.num_rows)
        at += some.num_rows
        yield rows, cut_words([t if first[r] else b"" for r, t in zip(rows, raw, strict=True)])


def _pieces(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """From each start to the next one, and from the last to the end."""
    return list(zip(starts, [*starts[1:], size][: len(starts)], strict=True))


def _keys(anchors: np.ndarray) -> np.ndarray:
    """What is sent of an anchor; equal for some different ones, which only raises estimates."""
    return anchors >> np.uint64(16)


def _count_anchors(docs: pa.Table, ranges: int, window: int, anchor: int) -> pa.Table:
    """The block's distinct anchors by range, and which of them it has twice."""
    batch, _, number = _documents(docs)
    found = [np.zeros(0, np.uint64)]
    for _, words in _once(batch, number):
        _, at, anchors = anchored_windows(words, words.hashes(), window, anchor)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        found.append(_keys(anchors[new]))
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    range_of = ((keys >> np.uint64(16)) * np.uint64(ranges)) >> np.uint64(32)
    used, starts = np.unique(range_of, return_index=True)
    cuts = _pieces(starts, len(keys))
    return pa.table(
        {
            "range": pa.array(used.astype(np.int32)),
            "block": pa.array([docs["block"][0].as_py()] * len(used), pa.int32()),
            "n": pa.array([b - a for a, b in cuts], pa.int64()),
            "steps": pa.array(
                [_packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in cuts], pa.binary()
            ),
            "twice": pa.array(
                [np.packbits(counts[a:b] > 1).tobytes() for a, b in cuts], pa.binary()
            ),
        }
    )


def _estimate(counted: pa.Table, cells: int) -> pa.Table:
    """Add the blocks' anchors up in the range's sketch; a bit per anchor for two or more."""
    sizes = counted["n"].to_pylist()
    keys = [
        np.cumsum(_unpacked(p, n, "<u8"), dtype=np.uint64)
        for p, n in zip(counted["steps"].to_pylist(), sizes, strict=True)
    ]
    sketch = np.zeros(DEPTH * cells, np.uint32)
    for own, packed in zip(keys, counted["twice"].to_pylist(), strict=True):
        twice = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(own))
        for cell in sketch_cells(own, cells):
            # A block's anchors are distinct, but may share a cell.
            np.add.at(sketch, cell, 1 + twice)
    bits = []
    for own in keys:
        repeated = np.ones(len(own), bool)
        for cell in sketch_cells(own, cells):
            repeated &= sketch[cell] > 1
        bits.append(np.packbits(repeated).tobytes())
    return pa.table(
        {
            "block": counted["block"],
            "range": counted["range"],
            "n": counted["n"],
            "repeated": pa.array(bits, pa.binary()),
        }
    )


def first_of_run(*columns: np.ndarray) -> np.ndarray:
    """Whether a sorted row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def smaller_elsewhere(w1: np.ndarray, w2: np.ndarray, ids: np.ndarray):
    """An order by window and id, and in it whether the window has a smaller id."""
    order = np.lexsort((ids, w2, w1))
    new = first_of_run(w1[order], w2[order])
    smallest = ids[order][new][np.cumsum(new) - 1] if len(order) else ids
    return order, ids[order] > smallest


_ASKED = {"w1": "<u8", "w2": "<u4", "id": "<i8", "number": "<u4", "start": "<u4"}


def _ask(docs: pa.Table, estimates: pa.Table, parts: int, window: int, anchor: int) -> pa.Table:
    """The windows that the block asks about by part, and (without windows) the starts in it
    that are already known to be removed."""
    batch, ids, number = _documents(docs)
    slices = []
    for rows, words in _once(batch, number):
        hashes = words.hashes(1)
        starts, _, anchors = anchored_windows(words, hashes, window, anchor)
        slices.append((rows, words, hashes, starts, _keys(anchors)))
    estimates = estimates.sort_by("range")
    flags = [
        np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        for bits, n in zip(estimates["repeated"].to_pylist(), estimates["n"].to_pylist(), strict=True)
    ]
    # In the order of the block's distinct anchors, as they were sent.
    repeated = np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool)
    distinct = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s[4] for s in slices)]))
    held = []
    for rows, words, hashes, starts, keys in slices:
        chosen = starts[repeated[np.searchsorted(distinct, keys)]]
        owner = words.owner[chosen]
        second = stretch_hashes(words.hashes(2), chosen, chosen + window) >> np.uint64(32)
        held.append(
            (
                stretch_hashes(hashes, chosen, chosen + window),
                second.astype(np.uint32),
                ids[rows[owner]],
                number[rows[owner]].astype(np.uint32),
                (chosen - words.first[owner]).astype(np.uint32),
            )
        )
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    order, smaller = smaller_elsewhere(*columns[:3])
    removed = np.zeros(len(columns[0]), bool)
    removed[order] = smaller
    # In the order of the documents, in which ids and places compress well.
    open_ = np.flatnonzero(~removed)
    part = (columns[0][open_] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    by_part = np.argsort(part, kind="stable")
    used, firsts = np.unique(part[by_part], return_index=True)
    groups = [open_[by_part[a:b]] for a, b in _pieces(firsts, len(open_))]
    parts_of = used.astype(np.int32).tolist()
    if removed.any():
        block = docs["block"][0].as_py()
        groups.append(np.flatnonzero(removed))
        parts_of.append(block % parts)
    known = [False] * len(used) + [True] * (len(groups) - len(used))
    packed = {
        n: pa.array(
            [b"" if k and n in ("w1", "w2") else c[some].astype(kind).tobytes()
             for some, k in zip(groups, known, strict=True)],
            pa.binary(),
        )
        for (n, kind), c in zip(_ASKED.items(), columns, strict=True)
    }
    return pa.table(
        {
            "part": pa.array(parts_of, pa.int32()),
            "block": pa.array([docs["block"][0].as_py()] * len(groups), pa.int32()),
            **packed,
            "known": pa.array(known, pa.bool_()),
        }
    )


def _answer(asked: pa.Table) -> pa.Table:
    """The removed starts of every block, from all that was asked about these windows."""
    blocks, known = asked["block"].to_pylist(), asked["known"].to_pylist()
    columns = {n: asked[n].to_pylist() for n in _ASKED}
    found = [
        (block, columns["number"][k], columns["start"][k])
        for k, block in enumerate(blocks)
        if known[k]
    ]
    rows = [k for k in range(len(blocks)) if not known[k]]
    if rows:
        w1, w2, ids, number, start = (
            np.concatenate([np.frombuffer(columns[n][k], kind) for k in rows])
            for n, kind in _ASKED.items()
        )
        sizes = [len(columns["start"][k]) // 4 for k in rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        order, smaller = smaller_elsewhere(w1, w2, ids)
        gone = np.sort(order[smaller])  # by block again
        bounds = np.searchsorted(owner[gone], np.arange(len(rows) + 1))
        for i, k in enumerate(rows):
            some = gone[bounds[i] : bounds[i + 1]]
            if len(some):
                found.append((blocks[k], number[some].tobytes(), start[some].tobytes()))
    return pa.table(
        {
            "block": pa.array([f[0] for f in found], pa.int32()),
            "number": pa.array([f[1] for f in found], pa.binary()),
            "start": pa.array([f[2] for f in found], pa.binary()),
        }
    )


def _remove(docs: pa.Table, removed: pa.Table, window: int) -> pa.Table:
    batch, _, number = _documents(docs)
    numbers, starts = (
        np.concatenate(
            [np.zeros(0, "<u4"), *(np.frombuffer(p, "<u4") for p in removed[n].to_pylist())]
        )
        for n in ("number", "start")
    )
    order = np.lexsort((starts, numbers))
    numbers, starts = numbers[order], starts[order]
    bounds = np.searchsorted(numbers, np.arange(number.max(initial=-1) + 2))
    n_words, n_removed, kept = [], [], []
    for own, text in zip(number.tolist(), batch.column("text").cast(pa.binary()), strict=True):
        words = (text.as_py() or b"").split()
        at = np.unique(starts[bounds[own] : bounds[own + 1]])
        gone = np.zeros(len(words) + 1, np.int32)
        gone[at] += 1
        gone[at + window] -= 1  # starts are distinct, and so are their ends
        covered = np.cumsum(gone[:-1]) > 0
        n_words.append(len(words))
        n_removed.append(int(covered.sum()))
        if len(at):
            words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
        kept.append(b" ".join(words))
    return pa.table(
        {
            "id": batch.column("id"),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        }
    )


def substring_dedup(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    block_text: int = BLOCK_TEXT,
    range_text: int = RANGE_TEXT,
    range_cells: int = RANGE_CELLS,
    part_text: int = PART_TEXT,
) -> DataFrame:
    """``id, n_words, n_removed, kept_text`` for every row of ``docs``.

    ``id`` is a whole number. Windows are judged on the given texts, not on what
    is left of others. ``kept_text`` has the kept words with one space between.
    Defined results: null, empty and blank texts have no words; texts shorter than
    a window are kept whole; rows with the same id do not remove each other's
    words; a null id counts as larger than any other; an empty table gives an
    empty result. Other columns are not looked at.

    Windows are compared by 96 bits of two independent hashes. The sizes say how many bytes
    of text a block, a range of the sketch and a part of the exact grouping stand for;
    their numbers follow the input. With fewer ``range_cells`` more windows that are not
    repeated go to the exact grouping, and the result stays the same. A task holds a
    block's words, so a text much longer than a block takes about forty times its size.
    """
    rows = docs.select(
        F.col(f"`{id}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, ranges, parts = (1 + size // each for each in (block_text, range_text, part_text))
    keyed = rows.withColumn("text_hash", F.xxhash64("text"))
    place = F.pmod(F.xxhash64("id", "text_hash"), F.lit(blocks)).cast("int")
    # The three steps that read the texts group the same rows, so Spark shuffles them once.
    in_blocks = keyed.withColumn("block", place).groupBy("block")
    estimates = (
        in_blocks.applyInArrow(
            lambda own: _count_anchors(own, ranges, window, anchor),
            "range int, block int, n long, steps binary, twice binary",
        )
        .groupBy("range")
        .applyInArrow(
            lambda counted: _estimate(counted, range_cells),
            "block int, range int, n long, repeated binary",
        )
    )
    removed = (
        in_blocks.cogroup(estimates.groupBy("block"))
        .applyInArrow(
            lambda own, found: _ask(own, found, parts, window, anchor),
            "part int, block int, w1 binary, w2 binary, id binary, number binary, start binary, "
            "known boolean",
        )
        .groupBy("part")
        .applyInArrow(_answer, "block int, number binary, start binary")
    )
    return (
        in_blocks.cogroup(removed.groupBy("block"))
        .applyInArrow(
            lambda own, gone: _remove(own, gone, window),
            "id long, n_words long, n_removed long, kept_text string",
        )
        .withColumnRenamed("id", id)
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS window_text
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), m AS (
  SELECT window_text, min(doc_id) AS first_id FROM v GROUP BY window_text
  HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM v JOIN m USING (window_text) WHERE doc_id > first_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT words.doc_id, count(gone.p) AS n_removed,
    string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p
  GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query("op4_substring_dedup", SQL)
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
