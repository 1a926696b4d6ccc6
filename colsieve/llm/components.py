"""Connected components by contraction, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsieve.llm.common import map_arrow
from colsieve.session import materialize

#: Edges that are left from contraction at which one task unites the rest (at most 320 KB).
FINISH_EDGES = 20_000


def connected_components(edges: DataFrame, rounds: int = 60, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Each round every node follows its smallest neighbour, and edges are relabelled and reduced to
    distinct ones, so they shrink by half at least; a rest of at most finish_edges is united by one task. Minima are partial
    aggregates; a hub's relabelling is left to the skew join. Rounds are written tables: nothing is collected but their row counts.
    """
    current = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels: DataFrame | None = None
    for _ in range(rounds):
        left = current.count()
        if labels is not None and not left:
            return settle(materialize(labels, "labels"))
        if left <= finish_edges:
            parent = materialize(_united(current), "parents")
            return parent if labels is None else settle(materialize(_followed(labels, parent), "labels"))
        both = current.select("a", "b").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "parents")
        labels = parent if labels is None else _followed(labels, parent)
        p, q = parent.select(F.col("node").alias("a"), F.col("root").alias("pa")), parent.select(F.col("node").alias("b"), F.col("root").alias("pb"))
        current = materialize(current.join(p, "a").join(q, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a <> b").distinct(), "edges")
    raise RuntimeError("components didn't settle")


def _followed(labels: DataFrame, parent: DataFrame) -> DataFrame:
    step = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def _united(edges: DataFrame) -> DataFrame:
    """Components of a bounded number of edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        if root:
            nodes = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])

    return map_arrow(edges.select("a", "b").coalesce(1), run, "node bigint, root bigint")


def settle(labels: DataFrame) -> DataFrame:
    """Follow roots that have a smaller root themselves until none does."""
    while True:
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("next")).filter("root <> next")
        if labels.join(up, "root", "left_semi").isEmpty():
            return labels
        labels = materialize(labels.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
