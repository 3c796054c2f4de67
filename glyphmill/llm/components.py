"""Connected components of an edge table by alternating star contractions, without collecting anything."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._common import materialise


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links (a, b): (member, smallest id)."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _towards_minimum(edges: DataFrame) -> DataFrame:
    """Every node's minimal neighbour (or itself), joined back to the node's edges."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _towards_minimum(both).filter("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _towards_minimum(down)
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = linked.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u long, v long) edges -> (node, root): root is the smallest node reachable. Nodes without an edge are absent.

    Self-loops and repeated edges do no harm; null ends are ignored; an empty table gives an empty one. Each round
    contracts every neighbourhood onto its minimum (two shuffles with map-side minima), so chains halve and groups
    that arrive as stars end in two or three rounds. Rounds are written to the shared scratch folder, so that a lost
    executor costs one round and not the lineage.
    """
    now = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u is not null and v is not null and u <> v").distinct()
    now = materialise(now, "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(now)
    if before[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        now = materialise(_small_star(_large_star(now)), "edges")
        after = mark(now)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
