"""Words and word hashes of many texts at once, as numpy arrays.

Texts are joined to one byte buffer and cut at white space; the hash of any
stretch of bytes comes from prefix sums, so no text is handled word by word.
Hashes are 64 bits, depend only on the bytes, and are the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; the arrays take about forty times as much.
BLOCK_BYTES = 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))


_TABLES = {seed: _table(seed) for seed in (1, 2)}


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash factor and of its inverse."""
    global _powers
    if len(_powers[0]) < count:
        _powers = tuple(
            np.concatenate(([np.uint64(1)], np.cumprod(np.full(count - 1, f, np.uint64))))
            for f in (_FACTOR, _INVERSE)
        )
    return _powers[0][:count], _powers[1][:count]


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for every pair, by differences of prefix sums."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Texts cut into words; word ``i`` is ``buffer[starts[i]:ends[i]]`` of text ``owner[i]``."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    #: Text ``k`` has the words ``first[k]`` to ``first[k + 1]``.
    first: np.ndarray

    def hashes(self, seed: int = 1) -> np.ndarray:
        return stretch_hashes(_TABLES[seed][self.buffer], self.starts, self.ends)


def cut_words(texts: list[bytes]) -> Words:
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = _SPACE[buffer]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    first = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(buffer, starts, ends, owner, first)


def text_of_rows(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches of a struct ``row``, with its field ``text`` beside it and not twice on the way."""
    for batch in batches:
        row = batch.column("row")
        at = row.type.get_field_index(text)
        yield pa.RecordBatch.from_arrays([row, row.field(at)], names=["row", "text"])


def text_blocks(
    batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their ``text`` column as bytes (null: empty).

    A slice ends when its texts reach ``size``, so one holds a single longer text
    at the most beyond that.
    """
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        begin, held, total = 0, [], 0
        for place, text in enumerate(texts):
            held.append(text.as_py() or b"")
            total += len(held[-1])
            if total >= size:
                yield batch.slice(begin, place + 1 - begin), held
                begin, held, total = place + 1, [], 0
        if held:
            yield batch.slice(begin), held
