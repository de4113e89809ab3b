"""Pairs of vectors with a high cosine similarity, found exactly.

Vectors are cut into blocks, level by level: a block with too many vectors is cut
around a few pivots of its own, each vector going to the nearest. The tree of blocks
with their pivots and radii is a table; neither the driver nor a task holds more than the few
pivots of one block. By the triangle inequality for angles, a vector can only be similar to members
of a block if its angle to the block's pivot is at most the wanted angle plus the
block's radius; all other blocks are skipped with all that they are cut into. What is
left is compared in tiles: one group holds a bounded part of a block and a bounded part
of the vectors that may match it, so a block that draws a third of all vectors is spread
over many tasks. Inside a group one matrix product gives all similarities, and only the
matches leave it. For dense
vectors that are about equally far from each other no block can be skipped, and
the work is then quadratic; ``block`` limits it to vectors with the same key, and
``recall`` finds that share of the pairs by signatures instead
(:mod:`tidewash.operators.signatures`).

Texts are compared by their character trigrams as sparse vectors
(:func:`trigram_terms`, :func:`sparse_cosine_pairs`): an equality join on the rare
trigrams that the cosine bound requires, exact as well, without blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewash.functions.columns import column
from tidewash.functions.scratch import drop_table, write_scratch
from tidewash.functions.text import normalized
from tidewash.functions.tiles import Compare, CompareInParts, meet, meet_within
from tidewash.operators.components import LAST_EDGES, connected_components
from tidewash.operators.signatures import signature_pairs
from tidewash.operators.vectors import forest, thinned, unit_rows

# Members of a block, and visitors to it, that meet in one group. A spanning
# result is small, so its groups may be larger, which shuffles fewer copies.
TILE = 2048
SPANNING_TILE = 8192
# A listing leaves the task part by part, so its tiles may be large as well. Every vector is
# sent to each tile that it meets: tiles grow with the table, up to a bound, so that their number,
# and with it the copies of a vector, does not.
LISTING_TILE, LISTING_TILES = 16_384, 16
# Tiles of vectors from which on a spanning result begins with a hub.
HUB_TILES = 4
# Share of the vectors outside the component that a hub may leave for another one to follow.
HUB_LEAVES = 0.75
#: Pairs that a task gives out at once.
PAIRS_AT_ONCE = 50_000
STRIP = 512
#: Blocks that a block is cut into, at most (two hexadecimal digits name one).
FAN = 64
#: Products of vectors and pivots that a task holds at once.
MOST_PRODUCTS = 4_000_000
# Room for rounding when an angle is compared with a block's reach.
ANGLE_SLACK = 1e-6


def trigram_terms(values: DataFrame, name: str = "value") -> DataFrame:
    """``id, term, weight``: how often each character trigram is in each distinct value.

    Values are stripped and lower-cased; a value is padded by one space on either
    side. Blank and null values are left out.
    """
    distinct = (
        values.select(normalized(F.col(name)).alias("id")).where(F.col("id") != "").distinct()
    )
    padded = F.concat(F.lit(" "), F.col("id"), F.lit(" "))
    places = F.sequence(F.lit(1), F.length(padded) - 2)
    grams = F.transform(places, lambda i: F.substring(padded, i, F.lit(3)))
    return (
        distinct.select("id", F.explode(grams).alias("term"))
        .groupBy("id", "term")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def _unit_terms(terms: DataFrame) -> DataFrame:
    """``id, terms``: each vector's terms with unit weights, from rare to common.

    A term is known by its place in that order: how many vectors have it, then its
    hash, then the term itself.
    """
    rarity = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    placed = terms.join(rarity, "term").select(
        "id", F.struct("df", F.xxhash64("term").alias("h"), "term", "weight").alias("entry")
    )
    vectors = placed.groupBy("id").agg(F.array_sort(F.collect_list("entry")).alias("terms"))
    squares = F.aggregate("terms", F.lit(0.0), lambda a, e: a + e["weight"] * e["weight"])
    return vectors.withColumn("length", F.sqrt(squares)).select(
        "id",
        F.transform("terms", lambda e: e["term"]).alias("terms"),
        F.transform("terms", lambda e: e["weight"] / F.col("length")).alias("weights"),
    )


def sparse_cosine_pairs(terms: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """``id_a, id_b, cosine`` for all pairs of sparse vectors with enough cosine.

    ``terms`` has ``id, term, weight`` with one row per vector and term. Exact: a
    vector's terms are ordered from rare to common, and its prefix is cut where
    what follows is shorter than the threshold. Two vectors whose rarest common
    term is not in both prefixes stay below the threshold, so an equality join on
    prefix terms and ids finds all pairs. Terms that many vectors have come last and are
    in few prefixes; a prefix term that is still frequent is split by Spark's
    handling of skewed joins.
    """
    if not threshold > 0:
        raise ValueError("the threshold must be above zero")
    vectors = write_scratch(_unit_terms(terms), "terms")
    # What is left after a term, from the last one back; a little room for rounding.
    least = threshold * threshold - 1e-9
    beyond = F.aggregate(
        F.reverse("weights"),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda a, w: F.struct(
            (a["s"] + w * w).alias("s"),
            (a["n"] + F.when(a["s"] + w * w < least, 1).otherwise(0)).alias("n"),
        ),
    )["n"]
    keyed = vectors.select(
        F.explode(F.slice("terms", F.lit(1), F.size("weights") - beyond)).alias("term"), "id"
    )
    # Terms and ids only; the vectors come afterwards, once for each pair.
    pairs = (
        keyed.select("term", F.col("id").alias("id_a"))
        .join(keyed.select("term", F.col("id").alias("id_b")), "term")
        .where("id_a < id_b")
        .select("id_a", "id_b")
        .distinct()
    )
    left, right = (
        vectors.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "terms", "weights")])
        for x in "ab"
    )
    common = F.array_intersect("terms_a", "terms_b")  # in the order of the first
    cosine = F.aggregate(
        F.transform(
            "common",
            lambda t: F.element_at("weights_a", F.array_position("terms_a", t).cast("int"))
            * F.element_at("weights_b", F.array_position("terms_b", t).cast("int")),
        ),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    enough = F.col("cosine") > threshold if strict else F.col("cosine") >= threshold
    return (
        pairs.join(left, "id_a")
        .join(right, "id_b")
        .withColumn("common", common)
        .withColumn("cosine", cosine)
        .where(enough)
        .select("id_a", "id_b", "cosine")
    )


def sparse_similarity_moments(terms: DataFrame) -> tuple[int, float, float]:
    """As :func:`similarity_moments`, for sparse vectors.

    The sum of the matrix is the squared length of the summed unit vectors. The
    sum of its squares is that of the products of the terms, so every vector
    contributes its pairs of terms: time, not memory, grows with the square of a value's
    length.
    """
    vectors = write_scratch(_unit_terms(terms), "terms")
    n = vectors.count()
    if not n:
        return 0, 0.0, 0.0
    entries = vectors.select(F.arrays_zip("terms", "weights").alias("entries"))
    one = entries.select(F.explode("entries").alias("x")).select("x.terms", "x.weights")
    sums = one.groupBy("terms").agg(F.sum("weights").alias("s"))
    total = sums.agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    # Terms stand in one order in all vectors, so a pair is made once, as (earlier, later).
    later = F.slice("entries", F.col("at") + 1, F.size("entries") - F.col("at"))
    two = (
        entries.select("entries", F.posexplode("entries").alias("at", "x"))
        .select("x", F.explode(later).alias("y"))
        .groupBy("x.terms", F.col("y.terms").alias("other"))
        .agg(F.sum(F.col("x.weights") * F.col("y.weights")).alias("s"))
    )
    twice = F.when(F.col("terms") == F.col("other"), 1).otherwise(2)
    squares = two.agg(F.sum(twice * F.col("s") * F.col("s"))).first()[0]
    mean = total / n**2
    return n, mean, math.sqrt(max(0.0, squares / n**2 - mean * mean))


def sparse_zscore_pairs(terms: DataFrame, z: float = 1.5) -> DataFrame:
    """Pairs of sparse vectors whose similarity has a z-score above ``z``."""
    _, mean, deviation = sparse_similarity_moments(terms)
    return sparse_cosine_pairs(terms, mean + z * deviation, strict=True)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def cosine_pairs(
    vectors: DataFrame,
    threshold: float,
    strict: bool = False,
    spanning: bool = False,
    tile: int | None = None,
    block: str | None = None,
    recall: float | None = None,
) -> DataFrame:
    """``id_a, id_b, cosine`` for all pairs with a cosine of at least ``threshold``.

    ``vectors`` has a unique ``id`` and an array ``vector``; ``id_a < id_b``.
    ``strict`` asks for more than the threshold. With ``spanning`` each tile
    gives only as many of its pairs as connect the same vectors, which is
    enough for clusters and keeps the output small where a great many vectors
    are alike; vectors that a first round connects are not compared again. ``block`` names a column that pairs must agree in (null agrees with
    null); without it all vectors are candidates. With ``recall`` the pairs come from
    signatures of random hyperplanes: only about that share of the pairs right at the
    threshold (more of the closer ones) is found, without the quadratic work.
    """
    if not threshold > 0:
        raise ValueError("the threshold must be above zero")
    given, tile = tile, tile or (SPANNING_TILE if spanning else TILE)
    rows = vectors.select("id", "vector").where(F.col("vector").isNotNull())
    id_type = vectors.schema["id"].dataType.simpleString()
    if recall is not None:
        return signature_pairs(vectors, threshold, recall, strict, spanning, tile, block)
    if block is not None:
        return _pairs_within(vectors, threshold, strict, spanning, block, tile, id_type)
    if not (given or spanning):
        tile = min(LISTING_TILE, max(TILE, math.ceil(rows.count() / LISTING_TILES)))
    assigned, levels = _in_blocks(rows, tile, id_type)
    angle = math.acos(min(1.0, threshold))
    schema = f"id_a {id_type}, id_b {id_type}, cosine double"

    def compare(visit: pd.DataFrame, home: pd.DataFrame) -> Iterator[pd.DataFrame]:
        u, v = unit_rows(visit["vector"]), unit_rows(home["vector"])
        visit_ids, home_ids = visit["id"].to_numpy(), home["id"].to_numpy()
        same = (visit["block"] == home["block"].iloc[0]).to_numpy()
        rows = max(1, MOST_PRODUCTS // len(v))

        def pairs(i: np.ndarray, j: np.ndarray) -> Iterator[pd.DataFrame]:
            for start in range(0, len(i), PAIRS_AT_ONCE):
                some, others = i[start : start + PAIRS_AT_ONCE], j[start : start + PAIRS_AT_ONCE]
                a, b = visit_ids[some], home_ids[others]
                swap = a > b
                yield pd.DataFrame(
                    {
                        "id_a": np.where(swap, b, a),
                        "id_b": np.where(swap, a, b),
                        "cosine": np.einsum("ij,ij->i", u[some], v[others]),
                    }
                )

        linked = []
        for start in range(0, len(u), rows):
            strip = slice(start, start + rows)
            cosines = u[strip] @ v.T
            match = cosines > threshold if strict else cosines >= threshold
            # Within a block each pair is seen from both sides; keep one of them.
            own = np.flatnonzero(same[strip])
            match[own] &= visit_ids[strip][own][:, None] < home_ids[None, :]
            i, j = forest(match) if spanning else np.nonzero(match)
            if spanning:
                linked.append((i + start, j))
            else:
                yield from pairs(i + start, j)
        if linked:
            # What connects a strip connects the tile, with more pairs than it needs.
            yield from pairs(*thinned(*map(np.concatenate, zip(*linked)), len(u), len(v)))

    if spanning and levels and (count := assigned.count()) > HUB_TILES * tile:
        parts = math.ceil(count / tile)
        return _spanning_pairs(assigned, levels, angle, compare, schema, tile, parts, id_type)
    visits = _visits(assigned, levels, angle, tile, id_type)
    homes = assigned.select("id", "vector", "block", F.col("block").alias("target"))
    return meet(homes, visits, compare, schema, tile, in_parts=True)


def _spanning_pairs(
    assigned: DataFrame,
    levels: list[DataFrame],
    angle: float,
    compare: CompareInParts,
    schema: str,
    tile: int,
    parts: int,
    id_type: str,
) -> DataFrame:
    """Pairs that connect the same vectors as all matches do.

    First every vector meets a hub, the vectors of one hash in ``parts``, about a tile. Pairs
    within the largest component that this gives would connect nothing new. So the vectors
    beside it meet a hub of its members, those that still match none of them meet another
    one, and so on while that helps. The few that are left are compared in full: with each
    other and with whatever they have not met. Where hubs connect little, that is nearly
    every pair.
    """
    number = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts))
    apart, nowhere = F.lit("").alias("block"), F.lit("").alias("target")

    def met(homes: DataFrame, visits: DataFrame) -> DataFrame:
        return meet(homes, visits, compare, schema, tile, in_parts=True)

    block = F.when(number == 0, "hub").otherwise("").alias("block")
    asking = assigned.select("id", "vector", block, nowhere)
    pairs = write_scratch(met(asking.where(F.col("block") == "hub"), asking), "pairs")
    linked = connected_components(pairs, last_edges=LAST_EDGES)
    largest = (
        linked.groupBy("component")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "component")
        .first()
    )
    members = linked.where(F.col("component") == F.lit(largest and largest["component"])).select(
        F.col("node").alias("id"), F.lit(True).alias("tied")
    )
    split = write_scratch(assigned.where(number > 0).join(members, "id", "left"), "vectors")
    tied = split.where(F.col("tied")).drop("tied")
    beside = rest = split.where(F.col("tied").isNull()).drop("tied")
    last, left, before = 0, rest.count(), math.inf
    while tile < left < HUB_LEAVES * before and last + 1 < parts:
        last += 1
        hub = tied.where(number == last).select("id", "vector", F.lit("hub").alias("block"), nowhere)
        found = write_scratch(met(hub, rest.select("id", "vector", apart, nowhere)), "pairs")
        pairs = pairs.unionByName(found)
        ids = found.select(F.col("id_a").alias("id")).union(found.select("id_b")).distinct()
        rest = write_scratch(rest.join(ids, "id", "left_anti"), "vectors")
        before, left = left, rest.count()
    visits = _visits(rest, levels, angle, tile, id_type, both=True)
    homes = rest.select("id", "vector", "block", F.col("block").alias("target"))
    pairs = pairs.unionByName(met(homes, visits.where(F.col("target") >= F.col("block"))))
    # Nobody visits from among these, so each of their pairs is seen from one side.
    others = tied.where(number > last).unionByName(beside.join(rest, "id", "left_anti"))
    homes = others.select("id", "vector", apart, F.col("block").alias("target"))
    return pairs.unionByName(met(homes, visits))


def _pairs_within(
    vectors: DataFrame,
    threshold: float,
    strict: bool,
    spanning: bool,
    block: str,
    tile: int,
    id_type: str,
) -> DataFrame:
    """Pairs within the rows of one key, which is cut into tiles if it has many."""
    key = F.to_json(F.struct(column(block))).alias("block")
    rows = vectors.where(F.col("vector").isNotNull()).select(key, "id", "vector")

    def compare(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        u, v = unit_rows(some["vector"]), unit_rows(others["vector"])
        ids, other_ids = some["id"].to_numpy(), others["id"].to_numpy()
        itself = set(ids) == set(other_ids)
        found = []
        for start in range(0, len(u), STRIP):
            cosines = u[start : start + STRIP] @ v.T
            match = cosines > threshold if strict else cosines >= threshold
            if itself:
                match &= ids[start : start + STRIP][:, None] < other_ids[None, :]
            pairs = np.array(forest(match)).T if spanning else np.argwhere(match)
            found.append(pairs + [start, 0])
        i, j = np.concatenate(found).T
        swap = ids[i] > other_ids[j]
        return pd.DataFrame(
            {
                "id_a": np.where(swap, other_ids[j], ids[i]),
                "id_b": np.where(swap, ids[i], other_ids[j]),
                "cosine": np.einsum("ij,ij->i", u[i], v[j]),
            }
        )

    schema = f"id_a {id_type}, id_b {id_type}, cosine double"
    return meet_within(write_scratch(rows, "vectors"), ["block"], compare, schema, tile)


def _strips(batch: pd.DataFrame, pivots: int) -> Iterator[pd.DataFrame]:
    """Parts of a batch whose products with all pivots take a bounded amount of memory."""
    rows = max(1, MOST_PRODUCTS // max(1, pivots))
    for start in range(0, len(batch), rows):
        yield batch.iloc[start : start + rows]


def _ask(
    pivots: DataFrame, asking: DataFrame, compare: Compare, schema: str, tile: int
) -> DataFrame:
    """Rows with all pivots of the block (``target``) that they ask, in one group."""
    return meet(pivots, asking, compare, schema, max(tile, FAN))


def _ask_root(pivots: DataFrame, asking: DataFrame, compare: Compare, schema: str) -> DataFrame:
    """As :func:`_ask` where only the root is asked: its pivots, ``FAN`` at most, travel
    with the function, and no row is shuffled."""
    few = pivots.toPandas()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield compare(batch, few)

    return asking.mapInPandas(run, schema)


def _in_blocks(vectors: DataFrame, tile: int, id_type: str) -> tuple[DataFrame, list[DataFrame]]:
    """``id, vector, block``, and for each level the blocks that it cut others into.

    A block's name is that of the block it comes from and two hexadecimal digits. A level
    has ``target`` (the block that was cut), ``child``, ``radius`` and the pivot
    (``id, vector``). Every level is one choice of pivots, one pass in which the rows of
    large blocks ask them, and one count. Vectors that are copies of each other cannot be
    cut apart and stay one block, of any size.
    """
    element = vectors.schema["vector"].dataType.simpleString()
    stored = write_scratch(
        vectors.select("id", "vector", F.lit("").alias("block"), F.lit(0.0).alias("angle")),
        "vectors",
    )
    count = stored.count()
    # A few levels more than even cuts would take; what is left then is tiled as it is.
    most = math.ceil(math.log(count / tile, FAN)) + 2 if count > tile else 0
    schema = f"id {id_type}, vector {element}, block string, angle double"

    def nearest(visit: pd.DataFrame, home: pd.DataFrame) -> pd.DataFrame:
        home = home.sort_values("child")
        pivots, names = unit_rows(home["vector"]), home["child"].to_numpy()
        parts = []
        for part in _strips(visit, len(pivots)):
            cosines = unit_rows(part["vector"]) @ pivots.T
            at = cosines.argmax(axis=1)
            parts.append(
                part[["id", "vector"]].assign(
                    block=names[at], angle=_angles(cosines[np.arange(len(part)), at])
                )
            )
        return pd.concat(parts)

    levels: list[DataFrame] = []
    sizes = None
    for _ in range(most):
        if sizes is None:
            large = stored.withColumn("parts", F.lit(min(FAN, math.ceil(count / tile))))
        else:
            cut = sizes.where((F.col("n") > tile) & (F.col("radius") > ANGLE_SLACK)).select(
                "block", F.least(F.lit(FAN), F.ceil(F.col("n") / tile)).cast("int").alias("parts")
            )
            if cut.isEmpty():
                break
            large = stored.join(cut, "block")
        hashed = F.xxhash64("id")
        number = F.pmod(hashed, F.col("parts").cast("bigint"))
        child = F.concat("block", F.lower(F.lpad(F.hex(number), 2, "0")))
        first = F.min_by(F.struct("id", "vector"), F.struct(hashed, "id")).alias("pivot")
        pivots = write_scratch(
            large.groupBy(F.col("block").alias("target"), child.alias("child"))
            .agg(first)
            .select("target", "child", "pivot.id", "pivot.vector"),
            "pivots",
        )
        if sizes is None:
            moved = _ask_root(pivots, large.select("id", "vector"), nearest, schema)
        else:
            asking = large.select(
                F.col("block").alias("target"), F.lit("").alias("child"), "id", "vector"
            )
            moved = stored.join(cut, "block", "left_anti").unionByName(
                _ask(pivots, asking, nearest, schema, tile)
            )
        before, stored = stored, write_scratch(moved, "vectors")
        drop_table(before)
        sizes = write_scratch(
            stored.groupBy("block").agg(F.count("*").alias("n"), F.max("angle").alias("radius")),
            "sizes",
        )
        reached = sizes.select(F.col("block").alias("child"), "radius")
        levels.append(pivots.join(reached, "child"))
    return stored.select("id", "vector", "block"), levels


def _visits(
    assigned: DataFrame,
    levels: list[DataFrame],
    angle: float,
    tile: int,
    id_type: str,
    both: bool = False,
) -> DataFrame:
    """Each vector with every block, from its own on, that may hold a match (``target``).

    With ``both`` the blocks before its own are given as well. Vectors go down the tree together, into every child whose pivot is near enough.
    """
    element = assigned.schema["vector"].dataType.simpleString()
    schema = f"id {id_type}, vector {element}, block string, targets array<string>"

    def near(visit: pd.DataFrame, home: pd.DataFrame) -> pd.DataFrame:
        home = home.sort_values("child")
        pivots, names = unit_rows(home["vector"]), home["child"].to_numpy().astype(str)
        reach = home["radius"].to_numpy() + angle + ANGLE_SLACK
        parts = []
        for part in _strips(visit, len(pivots)):
            angles = _angles(unit_rows(part["vector"]) @ pivots.T)
            # Names of blocks sort as the tree does; earlier blocks visit this one.
            own = part["block"].str.slice(0, len(names[0])).to_numpy().astype(str)
            meets = (angles <= reach) & (both | (names[None, :] >= own[:, None]))
            targets = [names[row].tolist() for row in meets]
            parts.append(part[["id", "vector", "block"]].assign(targets=targets))
        return pd.concat(parts)

    at = assigned.select("id", "vector", "block", F.lit("").alias("target"))
    if not levels:
        return at
    leaves = []
    for level, after in zip(levels, [*levels[1:], None], strict=True):
        if level is levels[0]:
            asked = _ask_root(level, assigned, near, schema)
        else:
            homes = level.select(
                "target", "id", "vector", "child", "radius", F.lit("").alias("block")
            )
            none = [F.lit("").alias("child"), F.lit(0.0).alias("radius")]
            asking = at.select("target", "id", "vector", *none, "block")
            asked = _ask(homes, asking, near, schema, tile)
        # Stored with one row for all children of a block, and counted before it is sent on.
        found = write_scratch(asked, "visits")
        reached = found.select("id", "vector", "block", F.explode("targets").alias("target"))
        if after is None:
            leaves.append(reached)
            break
        inner = after.select("target").distinct()
        leaves.append(reached.join(inner, "target", "left_anti"))
        at = reached.join(inner, "target", "left_semi")
    visits = leaves[0]
    for more in leaves[1:]:
        visits = visits.unionByName(more)
    return visits


def similarity_moments(vectors: DataFrame) -> tuple[int, float, float]:
    """Count, mean and population deviation of the full similarity matrix.

    The matrix has a row and a column for every vector, diagonal included. Its
    sum is the squared length of the summed unit vectors, and the sum of its
    squares is that of the Gram matrix of the dimensions, so one pass with a
    matrix as wide as the vectors is enough.
    """
    schema = "place int, total double, n bigint"

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = gram = None
        n = 0
        for batch in batches:
            if len(batch):
                unit = unit_rows(batch["vector"])
                n += len(unit)
                total = unit.sum(axis=0) if total is None else total + unit.sum(axis=0)
                gram = unit.T @ unit if gram is None else gram + unit.T @ unit
        if n:
            flat = np.concatenate([total, gram.ravel()])
            count = np.zeros(len(flat), dtype=np.int64)
            count[0] = n
            yield pd.DataFrame(
                {"place": np.arange(len(flat), dtype=np.int32), "total": flat, "n": count}
            )

    # As many rows as the vectors have dimensions, squared.
    found = (
        vectors.select("vector")
        .where(F.col("vector").isNotNull())
        .mapInPandas(sums, schema)
        .groupBy("place")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        .orderBy("place")
        .toPandas()
    )
    n = int(found["n"].sum())
    if not n:
        return 0, 0.0, 0.0
    flat = found["total"].to_numpy()
    dims = int(round((math.sqrt(4 * len(flat) + 1) - 1) / 2))
    mean = float((flat[:dims] ** 2).sum()) / n**2
    square = float((flat[dims:] ** 2).sum()) / n**2
    return n, mean, math.sqrt(max(0.0, square - mean * mean))


def zscore_cutoff(vectors: DataFrame, z: float = 1.5) -> float:
    """The cosine that lies ``z`` deviations above the mean of all similarities."""
    _, mean, deviation = similarity_moments(vectors)
    return mean + z * deviation


def zscore_pairs(
    vectors: DataFrame, z: float = 1.5, spanning: bool = False, recall: float | None = None
) -> DataFrame:
    """Pairs whose similarity has a z-score above ``z`` within the whole matrix."""
    cutoff = zscore_cutoff(vectors, z)
    return cosine_pairs(vectors, cutoff, strict=True, spanning=spanning, recall=recall)
