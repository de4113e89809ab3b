"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewash.functions.rounds import RoundLog
from tidewash.functions.scratch import drop_table, write_scratch

#: Edges that one task may take for the last round; a few megabytes of ids.
LAST_EDGES = 50_000


def _last_round(pairs: DataFrame) -> DataFrame:
    """``node, chosen`` for a graph of at most ``LAST_EDGES`` edges, solved in one task.

    Each node chooses the first of its component's nodes.
    """
    kind = pairs.schema["u"].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = pd.concat(list(batches) or [pd.DataFrame({"u": [], "v": []})])
        if edges.empty:
            return
        codes, nodes = pd.factorize(pd.concat([edges["u"], edges["v"]]), sort=True)
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in codes.reshape(2, -1).T.tolist():
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
        first = np.array([root(x) for x in range(len(nodes))])
        yield pd.DataFrame({"node": nodes, "chosen": nodes[first]})

    return pairs.repartition(1).mapInPandas(solve, f"node {kind}, chosen {kind}")


def connected_components(
    edges: DataFrame,
    a: str = "id_a",
    b: str = "id_b",
    log: RoundLog | None = None,
    last_edges: int = 0,
) -> DataFrame:
    """``node, component`` for every node with an edge; the name is the smallest member.

    Each round every node joins the neighbour (or itself) that comes first in
    a fresh random order, and the graph is contracted along these choices. The
    random order makes a constant share of the nodes vanish in every round,
    also on long chains and stars. Nothing is gathered per node: choices are a
    minimum, which is combined before the shuffle. With a ``log`` every finished round is
    kept, and a later call with the same log goes on after the last one. Once no more than
    ``last_edges`` edges are left (``LAST_EDGES`` at most), one task solves what remains
    instead of several more rounds; the result is the same.
    """

    def store(df: DataFrame, name: str, turn: int) -> DataFrame:
        return write_scratch(df, name) if log is None else log.write(df, name, turn)

    before = log.last() if log else None
    if before:
        turn, tables, _ = before
        pairs, labels = tables["edges"], tables.get("labels")
    else:
        pairs = store(
            edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct(),
            "edges",
            0,
        )
        labels, turn = None, 0
        if log:
            log.finish(0, {"edges": pairs})
    finished: list[DataFrame] = []  # tables of this and the last round that nothing reads later
    last_edges = min(last_edges, LAST_EDGES)
    while not pairs.isEmpty():
        last = last_edges > 0 and pairs.limit(last_edges + 1).count() <= last_edges
        both = pairs.union(pairs.select("v", "u"))
        order = F.struct(F.xxhash64("v", F.lit(turn)).alias("h"), F.col("v").alias("x"))
        own = F.struct(F.xxhash64("u", F.lit(turn)).alias("h"), F.col("u").alias("x"))
        chosen = write_scratch(
            _last_round(pairs)
            if last
            else both.groupBy("u")
            .agg(F.min(order).alias("first"))
            .select(F.col("u").alias("node"), F.least(own, "first")["x"].alias("chosen")),
            "choices",
        )
        if labels is None:
            labels = store(
                chosen.select("node", F.col("chosen").alias("component")), "labels", turn + 1
            )
        else:
            step = chosen.select(F.col("node").alias("component"), "chosen")
            finished.append(labels)
            labels = store(
                labels.join(step, "component", "left").select(
                    "node", F.coalesce("chosen", "component").alias("component")
                ),
                "labels",
                turn + 1,
            )
        if last:  # a log keeps the tables of its last finished round
            for table in [chosen] if log else [*finished, chosen, pairs]:
                drop_table(table)
            break
        ends = (
            pairs.join(chosen.select(F.col("node").alias("u"), F.col("chosen").alias("s")), "u")
            .join(chosen.select(F.col("node").alias("v"), F.col("chosen").alias("t")), "v")
            .where(F.col("s") != F.col("t"))
        )
        finished += [chosen, pairs]
        pairs = store(
            ends.select(F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v")).distinct(),
            "edges",
            turn + 1,
        )
        turn += 1
        if log:  # which deletes the tables of the last round
            log.finish(turn, {"edges": pairs, "labels": labels})
            finished = [chosen]
        for table in finished:
            drop_table(table)
        finished = []
    if labels is None:
        node_type = pairs.schema["u"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {node_type}, component {node_type}")
    names = labels.groupBy("component").agg(F.min("node").alias("name"))
    return labels.join(names, "component").select("node", F.col("name").alias("component"))


def clusters_within(components: DataFrame, smallest: int = 2, largest: int = 20) -> DataFrame:
    """The components with between ``smallest`` and ``largest`` members."""
    sizes = (
        components.groupBy("component")
        .agg(F.count("*").alias("size"))
        .where(F.col("size").between(smallest, largest))
    )
    return components.join(sizes, "component").select(
        F.col("component").alias("cluster_id"), F.col("node").alias("member"), "size"
    )
