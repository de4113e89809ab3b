"""Near-equal vectors by lattice hashing.

Every table projects the unit vectors at random onto a few blocks of eight
coordinates and decodes each block to the nearest point of the lattice E8. A vector
lives in the cell of its points and also visits the neighbouring cells that its
projection lies closest to. Two vectors meet if one lives where the other lives or
visits, in any table; pairs that meet are verified by their exact cosine. Cells are
compared in tiles of bounded size, which give counts and connecting links, not pairs.
A pair may meet more than once and is counted where it meets first.

The vectors and projections are rounded to multiples of 2^-20, so that all sums
before the decoding are exact and every task finds the same cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewash.functions.scratch import drop_table, free_shuffles, write_scratch
from tidewash.llm.registry import query, table
from tidewash.llm.vectors import binary, matrix, usable
from tidewash.llm.words import mix
from tidewash.operators.components import connected_components

COSINE = 0.95
#: Rows of a crowded cell in one part; a tile compares two parts.
TILE = 1024
#: Groups up to this size are compared pair by pair for many groups at once.
SMALL = 48
#: Pairs whose products are held at once.
PAIRS = 100_000
#: Rows of vectors in cells that are worked on at once; more are cut by table, then by cell.
PASS_ROWS = 18_000_000
#: Parts that one table is cut into at most, as each part asks for the vectors again.
SLICES = 4
_GRID = float(1 << 20)


@dataclass(frozen=True)
class Lattice:
    """How vectors are hashed.

    The defaults find a pair of cosine 0.95 (the least that links) with probability 0.94,
    one of 0.97 with 0.99, and let a vector meet about 6e-5 of all unrelated ones.
    """

    tables: int = 4
    blocks: int = 2
    #: The lattice's unit against the spread of a projected unit vector.
    scale: float = 1.6
    #: Neighbouring cells that a vector visits in every table.
    probes: int = 8
    #: Neighbours of one block's point that take part in the choice.
    near: int = 8
    seed: int = 12

    def __post_init__(self):
        if not 0 <= self.probes < (1 + self.near) ** self.blocks or self.near > 240:
            raise ValueError("more probes than neighbouring cells to choose from")


@lru_cache
def shortest_vectors() -> np.ndarray:
    """The 240 lattice vectors that lead to the neighbours, in halves."""
    found = []
    for (i, j), signs in product(combinations(range(8), 2), product((2, -2), repeat=2)):
        vector = [0] * 8
        vector[i], vector[j] = signs
        found.append(vector)
    found += [s for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(found, np.float64) / 2


def _even_integers(y: np.ndarray) -> np.ndarray:
    """The nearest integer points whose coordinates have an even sum."""
    point = np.rint(y)
    apart = y - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(apart[odd]).argmax(axis=1)
    point[odd, worst] += np.where(apart[odd, worst] >= 0, 1.0, -1.0)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8: even integer points, or such points moved by a half."""
    whole, half = _even_integers(y), _even_integers(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; first scaled, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


@lru_cache
def _projection(lattice: Lattice, number: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    pick = np.random.default_rng([lattice.seed, number, size])
    across = pick.normal(size=(size, 8 * lattice.blocks)) / lattice.scale
    factors = pick.integers(0, 1 << 63, 8 * lattice.blocks, np.uint64) * np.uint64(2) + np.uint64(1)
    return np.rint(across * _GRID) / _GRID, factors


def _hash(points: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A hash that adds up: of a sum of points it is the sum of the hashes."""
    return ((2 * points).astype(np.int64).astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)


def _smallest(values: np.ndarray, count: int) -> np.ndarray:
    """The places of each row's ``count`` smallest values, in the order of a stable sort."""
    width = values.shape[1]
    if not 0 < count < width:
        return np.argsort(values, axis=1, kind="stable")[:, :count]
    low = values <= np.partition(values, count - 1, axis=1)[:, count - 1 : count]
    tied = np.flatnonzero(low.sum(axis=1) != count)  # these rows are sorted as a whole
    low[tied] = np.arange(width) < count
    places = np.nonzero(low)[1].reshape(len(values), count)
    order = np.argsort(np.take_along_axis(values, places, 1), axis=1, kind="stable")
    places = np.take_along_axis(places, order, 1)
    places[tied] = np.argsort(values[tied], axis=1, kind="stable")[:, :count]
    return places


def cells(units: np.ndarray, lattice: Lattice, only: int | None = None) -> np.ndarray:
    """For each vector and table, or one table, the cell it lives in, then those it visits."""
    count = len(units)
    rounded = np.rint(units * _GRID) / _GRID
    numbers = range(lattice.tables) if only is None else [only]
    found = np.empty((count, len(numbers), 1 + lattice.probes), np.uint64)
    roots = shortest_vectors()
    for place, number in enumerate(numbers):
        across, factors = _projection(lattice, number, units.shape[1])
        y = rounded @ across
        # The cheapest choices of one point in every block; the first is the nearest of all.
        cost, code = np.zeros((count, 1)), np.zeros((count, 1), np.uint64)
        for b in range(lattice.blocks):
            own, factor = y[:, 8 * b : 8 * b + 8], factors[8 * b : 8 * b + 8]
            point = decode(own)
            beyond = 2 - 2 * ((own - point) @ roots.T)
            near = _smallest(beyond, lattice.near)
            steps = np.concatenate([np.zeros((count, 1)), np.take_along_axis(beyond, near, 1)], 1)
            names = np.concatenate(
                [np.zeros((count, 1), np.uint64), _hash(roots, factor)[near]], 1
            ) + _hash(point, factor)[:, None]
            choices = cost.shape[1] * steps.shape[1]  # not -1, which no vectors leave open
            cost = (cost[:, :, None] + steps[:, None, :]).reshape(count, choices)
            code = (code[:, :, None] + names[:, None, :]).reshape(count, choices)
            least = _smallest(cost, 1 + lattice.probes)
            cost, code = np.take_along_axis(cost, least, 1), np.take_along_axis(code, least, 1)
        found[:, place] = mix(code + np.uint64((number + 1) << 56))
    return found


def meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cell in which each pair of rows of :func:`cells` meets first.

    Tables come in their order; within one the common home, then ``a``'s, then ``b``'s.
    Pairs that never meet get 0.
    """
    found = np.zeros(len(a), np.uint64)
    apart = np.arange(len(a))  # pairs that have not met in the tables before
    for number in range(a.shape[1]):
        if number:
            a, b = a[left], b[left]
        home_a, home_b = a[:, number, 0], b[:, number, 0]
        there = (a[:, number, 1:] == home_b[:, None]).any(axis=1)
        here = (b[:, number, 1:] == home_a[:, None]).any(axis=1) | (home_a == home_b)
        found[apart] = np.where(here, home_a, np.where(there, home_b, 0))
        left = ~(here | there)
        apart = apart[left]
    return found


def _prepare(batches: Iterator[pa.RecordBatch], wide: str) -> Iterator[pa.RecordBatch]:
    """Every row with a number; the vector's bytes where it can link."""
    part = TaskContext.get().partitionId()
    at = 0
    for batch in batches:
        lengths, firsts, flat = usable(batch.column("vector"))
        values = np.full(batch.num_rows, None, object)
        for size in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == size)
            vectors = matrix(rows, firsts, flat, size) + 0.0  # one form of zero
            some = np.abs(vectors).max(axis=1) > 0
            for row, vector in zip(rows[some], vectors[some].astype(wide), strict=True):
                values[row] = vector.tobytes()
        numbers = (np.int64(part) << 40) + at + np.arange(batch.num_rows)
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(numbers), pa.array(values, pa.binary())],
            names=["id", "row", "vector"],
        )


def _by_size(column: pa.Array, wide: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors, for every size of vector."""
    lengths = np.asarray(pc.binary_length(column), np.int64)
    width = np.dtype(wide).itemsize
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        joined = b"".join(column.take(pa.array(rows)).to_pylist())
        vectors = np.frombuffer(joined, wide).reshape(len(rows), size // width)
        yield rows, unit(vectors.astype(np.float64))


def _stays(
    batches: Iterator[pa.RecordBatch], wide: str, lattice: Lattice, only: int | None = None
):
    """``cell, row, home``: where each vector lives and which cells it visits."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 2048):
            batch = whole.slice(begin, 2048)
            for rows, units in _by_size(batch.column("vector"), wide):
                found = cells(units, lattice, only)
                count = found[0].size
                home = np.zeros(found.shape[1:], bool)
                home[:, 0] = True
                numbers = np.asarray(batch.column("row"))[rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.ravel().view(np.int64)),
                        pa.array(np.repeat(numbers, count)),
                        pa.array(np.tile(home.ravel(), len(rows))),
                    ],
                    names=["cell", "row", "home"],
                )


@dataclass
class Tiles:
    """Rows of whole tiles, sorted by tile; all vectors have one size."""

    cell: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    part: np.ndarray
    #: Whether a tile compares a part with itself.
    same: np.ndarray
    home: np.ndarray
    row: np.ndarray
    weight: np.ndarray
    units: np.ndarray

    def linked(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of row places that are near enough, a bounded number at once."""
        sizes = self.end - self.begin
        place = np.arange(len(self.cell))
        own = self.end[np.repeat(np.arange(len(sizes)), sizes)]
        after = np.where(np.repeat(sizes, sizes) <= SMALL, own - place - 1, 0)
        edges = np.concatenate(([0], np.cumsum(after)))
        at = 0
        while at < len(place):
            upto = max(at + 1, int(np.searchsorted(edges, edges[at] + PAIRS, side="right")) - 1)
            a = np.repeat(place[at:upto], after[at:upto])
            b = a + 1 + np.arange(len(a)) - (edges[a] - edges[at])
            good = self._compared(a, b)
            a, b = a[good], b[good]
            near = np.einsum("ij,ij->i", self.units[a], self.units[b])
            yield self._near(a, b, near, least)
            at = upto
        for group in np.flatnonzero(sizes > SMALL):
            begin, end = self.begin[group], self.end[group]
            strip = max(1, 2_000_000 // int(end - begin))
            for first in range(begin, end, strip):
                last = min(end, first + strip)
                near = self.units[first:last] @ self.units[begin:end].T
                a, b = np.nonzero(near >= least - 1e-9)
                values = near[a, b]
                a, b = a + first, b + begin
                good = (a < b) & self._compared(a, b)
                yield self._near(a[good], b[good], values[good], least)

    def _compared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.home[a] | self.home[b]) & (self.same[a] | (self.part[a] != self.part[b]))

    def _near(self, a, b, near: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        close = near >= least
        # Next to the bound the sum is taken in one fixed order.
        for k in np.flatnonzero(np.abs(near - least) < 1e-9):
            close[k] = float(np.sum(self.units[a[k]] * self.units[b[k]])) >= least
        return a[close], b[close]


def hubs(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``count`` places the smallest that links reach."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label.copy())  # what was one label stays one
        label = label[label]
        if (label == before).all():
            return label


def _count(tiles: Tiles, least: float, lattice: Lattice) -> pa.RecordBatch:
    """``row, links, hub``: this part's links of a row, and a row that they connect it with."""
    links = np.zeros(len(tiles.row), np.int64)
    known = np.zeros(len(tiles.row), bool)
    homes = np.empty((len(tiles.row), lattice.tables, 1 + lattice.probes), np.uint64)
    joined: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in tiles.linked(least):
        if not len(a):
            continue
        a, b = np.where(tiles.row[a] < tiles.row[b], (a, b), (b, a))
        fresh = np.unique(np.concatenate((a, b)))
        fresh = fresh[~known[fresh]]
        homes[fresh], known[fresh] = cells(tiles.units[fresh], lattice), True
        for begin in range(0, len(a), PAIRS):
            some = slice(begin, begin + PAIRS)
            here = meeting(homes[a[some]], homes[b[some]]) == tiles.cell[a[some]]
            first, second = a[some][here], b[some][here]
            np.add.at(links, first, tiles.weight[second])
            np.add.at(links, second, tiles.weight[first])
            label = hubs(len(links), first, second) if len(first) else None
            if label is not None:
                moved = np.flatnonzero(label != np.arange(len(label)))
                joined.append((moved, label[moved]))
    if joined:
        a, b = (np.concatenate(side) for side in zip(*joined, strict=True))
        label = hubs(len(links), a, b)
    else:
        label = np.arange(len(links))
    used = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.array(tiles.row[used]), pa.array(links[used]), pa.array(tiles.row[label[used]])],
        names=["row", "links", "hub"],
    )


_TILE = ("cell", "low", "high")


def _compare(batches: Iterator[pa.RecordBatch], wide: str, least: float, lattice: Lattice):
    """Whole tiles from rows that are sorted by tile; one tile may go on in the next batch."""

    def finished(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = rows.combine_chunks().to_batches()[0]
        column = {n: np.asarray(batch.column(n)) for n in batch.schema.names if n != "vector"}
        for places, units in _by_size(batch.column("vector"), wide):
            own = {n: c[places] for n, c in column.items()}
            change = np.zeros(len(places), bool)
            change[:1] = True
            for n in _TILE:
                change[1:] |= own[n][1:] != own[n][:-1]
            begin = np.flatnonzero(change)
            tiles = Tiles(
                own["cell"].view(np.uint64),
                begin,
                np.append(begin[1:], len(places)),
                own["part"],
                own["low"] == own["high"],
                own["home"],
                own["row"],
                own["n"],
                units,
            )
            yield _count(tiles, least, lattice)

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if rows.num_rows < 4096:
            held = rows
            continue
        last = rows.slice(rows.num_rows - 1)
        alike = np.ones(rows.num_rows, bool)
        for n in _TILE:
            alike &= rows.column(n).to_numpy() == last.column(n).to_numpy()
        cut = int(np.flatnonzero(~alike)[-1]) + 1 if not alike.all() else 0
        held = rows.slice(cut)
        if cut:
            yield from finished(rows.slice(0, cut))
    if held is not None and held.num_rows:
        yield from finished(held)


def _spread(held: DataFrame, tile: int) -> DataFrame:
    """Rows of crowded cells in all their tiles.

    A cell of up to ``tile`` rows is one tile. A larger one has parts that live
    there and parts that visit; each part that lives there meets every part, itself
    included, and visitors do not meet each other.
    """
    n, homes = F.col("size"), F.col("homes")
    whole = n <= tile
    home_parts = F.when(whole, 1).otherwise(F.ceil(homes / tile)).cast("int")
    visit_parts = F.when(whole, 0).otherwise(F.ceil((n - homes) / tile)).cast("int")
    salt = F.xxhash64("row")
    part = (
        F.when(whole, 0)
        .when(F.col("home"), F.pmod(salt, home_parts.cast("long")))
        .otherwise(home_parts + F.pmod(salt, F.greatest(visit_parts, F.lit(1)).cast("long")))
    )
    others = F.when(F.col("home"), home_parts + visit_parts).otherwise(home_parts)
    return (
        held.withColumn("part", part.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        .select(
            "cell",
            F.least("part", "other").alias("low"),
            F.greatest("part", "other").alias("high"),
            "part",
            "home",
            "row",
        )
    )


def _links_within(
    stays: DataFrame, vectors: DataFrame, wide: str, least: float, lattice: Lattice, tile: int
) -> DataFrame:
    """:func:`lattice_links` of whole cells."""
    sizes = (
        stays.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("size"), F.count_if("home").alias("homes"))
        .where("size > 1 AND homes > 0")
    )
    held = _spread(stays.join(sizes, "cell"), tile)
    rows = held.join(vectors, "row").select(*_TILE, "part", "home", "row", "n", "vector")
    found = (
        rows.repartition(*_TILE)
        .sortWithinPartitions(*_TILE)
        .mapInArrow(
            lambda b: _compare(b, wide, least, lattice), "row long, links long, hub long"
        )
    )
    return write_scratch(found, "links")


def lattice_links(
    vectors: DataFrame,
    wide: str,
    least: float = COSINE,
    lattice: Lattice | None = None,
    tile: int = TILE,
    pass_rows: int = PASS_ROWS,
) -> DataFrame:
    """``row, links, hub`` from distinct vectors (``row, n, vector``: number, copies, bytes).

    ``links`` add up to the copies of linked vectors, and links between ``row`` and
    ``hub`` connect what links connect. Stored. More than ``pass_rows`` rows of vectors in
    cells are not on disk at once, but one table's, and of these a part of the cells meets
    the vectors at a time; a cell is never cut.
    """
    lattice = lattice or Lattice()
    spark = vectors.sparkSession
    rows = vectors.count() * lattice.tables * (1 + lattice.probes)
    tables = [None] if rows <= pass_rows else range(lattice.tables)
    slices = max(1, min(SLICES, -(-rows // (len(tables) * pass_rows))))
    found = []
    for number in tables:
        stays = write_scratch(
            vectors.select("row", "vector").mapInArrow(
                lambda b, number=number: _stays(b, wide, lattice, number),
                "cell long, row long, home boolean",
            ),
            "stays",
        )
        for k in range(slices):
            own = stays if slices == 1 else stays.where(F.pmod("cell", F.lit(slices)) == k)
            found.append(_links_within(own, vectors, wide, least, lattice, tile))
            if len(tables) > 1:
                free_shuffles(spark)
        drop_table(stays)
    return spark.read.schema(found[0].schema).parquet(*(t.scratch_path for t in found))


def near_vectors(
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    least: float = COSINE,
    lattice: Lattice | None = None,
    tile: int = TILE,
    pass_rows: int = PASS_ROWS,
) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row.

    Equal vectors are one class and are never paired; a class links with others by
    its one vector. ``n_links`` counts the other rows of cosine ``least`` or more that were
    found, ``component_id`` is the smallest id that links reach, itself included.

    Defined results: vectors that are null, empty or zero, or hold null or non-finite
    components link with nothing, nor do vectors of different sizes; a null id is its component's name
    only where all its members have null ids; repeated rows link with each other; an empty
    table gives an empty result. Other columns are not looked at.
    """
    element = rows.schema[vector].dataType.elementType.simpleString()
    wide = "<f4" if element == "float" else "<f8"
    kind = rows.schema[id].dataType.simpleString()
    numbered = write_scratch(
        rows.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
        .mapInArrow(lambda b: _prepare(b, wide), f"id {kind}, row long, vector binary")
        .withColumn("key", F.unhex(F.md5("vector"))),
        "vectors",
    )
    usable_rows = numbered.where(F.col("key").isNotNull())
    # One row per class: its first row, first id and number of copies.
    classes = write_scratch(
        usable_rows.groupBy("key").agg(
            F.min("row").alias("row"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n")
        ),
        "classes",
    )
    vectors = write_scratch(
        classes.select("row", "n").join(usable_rows.select("row", "vector"), "row"), "distinct"
    )
    keys = write_scratch(numbered.select("id", "key"), "keys")
    drop_table(numbered)
    found = lattice_links(vectors, wide, least, lattice, tile, pass_rows)
    drop_table(vectors)
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    nodes = connected_components(found.where("row <> hub"), "row", "hub")
    named = write_scratch(
        classes.join(links, "row", "left")
        .join(nodes.withColumnRenamed("node", "row"), "row", "left")
        .select(
            "key",
            "id",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "row").alias("component"),
        ),
        "named",
    )
    first = named.groupBy("component").agg(F.min("id").alias("component_id"))
    answer = named.join(first, "component").select("key", "n_links", "component_id")
    return (
        keys.join(answer, "key", "left")
        .select(
            F.col("id").alias(id),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias(
                "component_id"
            ),
        )
        .withColumn("kept", F.col(f"`{id}`").eqNullSafe(F.col("component_id")))
    )


SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
),
good AS (
    SELECT vec_id, e FROM v
    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
    WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
),
reached AS (
    SELECT vec_id AS node, vec_id AS name FROM v
    UNION
    SELECT links.b, reached.name FROM reached JOIN links ON links.a = reached.node
),
names AS (SELECT node, min(name) AS component_id FROM reached GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN names ON names.node = v.vec_id LEFT JOIN counts ON counts.a = v.vec_id
"""


@query("op12_lattice_near_dedup", sql=SQL)
def op12_lattice_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))
