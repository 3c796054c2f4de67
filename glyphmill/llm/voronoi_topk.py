"""Exact top-k inner-product search as a Voronoi kNN join (operator 7).

Vectors x become (x, sqrt(M^2 - |x|^2)) and queries (q, 0), where M is the largest norm; then |q' - x'|^2 = |q|^2 + M^2 -
2 q.x, so the nearest vectors have the highest inner products. Data and queries are put into the cells of their nearest
pivots. A cell's summary is its size, its radius and its central vectors, the k + 1 nearest to the pivot. A query's k + 1
smallest distances to all central vectors bound its k-th distance, and the largest bound of a cell's queries is the cell's.
Cells of queries that need the same data are joined into groups of bounded size; a vector is sent to a group only if, for
some cell of the group, no pivot's ring of distances rules it out: |d(x, p) - d(q, p)| <= bound for every pivot p. A group
is solved locally, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm._common import hashed_order, materialise

#: Pivots: the first so many vectors in hashed order (a bounded sample); as many as the root of the rows, between these.
LEAST_PIVOTS, MOST_PIVOTS = 16, 64
#: Data and query rows that a task solves.
BLOCK_ROWS, QUERY_ROWS = 20_000, 10_000
TOP, SCALE, QUERY_EVERY = 5, 256, 50
#: The largest component that takes part: the squares of a thousand such ones, scaled, are within a double. No float is as large.
MOST = 1e140
#: The ends of a long: scores beyond them count as the end, so they tie.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row_id, vec_id, v array<double>) with v = floor(scale * x); rows that are null or hold null or non-finite components
    go, as do those with a component over MOST in size, whose norm a double can't hold. row_id tells rows of equal vec_id
    apart; it holds once the rows are written."""
    # from 2^53 on a double is whole, and floor() would put it into a long
    x = F.transform("embedding", lambda c: F.when(F.abs(c * F.lit(float(scale))) < 2.0**53, F.floor(c.cast("double") * scale).cast("double")).otherwise(c.cast("double") * scale))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= MOST))
    return rows.filter(F.coalesce(good, F.lit(False))).select(F.monotonically_increasing_id().alias("row_id"), F.col("vec_id").cast("long"), x.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def _lifted(v: np.ndarray, largest: float | None) -> np.ndarray:
    """Data with the further coordinate that gives all vectors the norm `largest`; queries (None) with a zero."""
    more = np.zeros(len(v)) if largest is None else np.sqrt(np.maximum(0.0, largest * largest - (v * v).sum(1)))
    return np.concatenate([v, more[:, None]], 1)


def _assign(pivots: np.ndarray, largest: float):
    """Every data vector's cell and radius."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distance = _distances(_lifted(_matrix(batch.column(0)), largest), pivots)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(distance.argmin(1).astype(np.int32)), pa.array(distance.min(1))], ["v", "cell", "radius"])

    return assign


class Cells:
    """Pivots and central vectors, and from them each query's cell, bound and distances to the pivots."""

    def __init__(self, pivots: np.ndarray, central: np.ndarray, largest: float, k: int) -> None:
        self.pivots, self.central, self.largest, self.k = pivots, central, largest, k

    def bounds(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, bound, distances to the pivots) of query vectors: the (k + 1)-th smallest distance to a central vector, as
        one of them may be the query's own row; infinite where there are fewer."""
        lifted = _lifted(v, None)
        distance = _distances(lifted, self.pivots)
        near = _distances(lifted, self.central)
        bound = np.partition(near, self.k, axis=1)[:, self.k] if near.shape[1] > self.k else np.full(len(v), np.inf)
        return distance.argmin(1), bound, distance

    def summarise(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query cell of a task: queries, the largest bound, the least and the most distance to every pivot."""
        n: dict[int, int] = {}
        far: dict[int, float] = {}
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, bound, distance = self.bounds(_matrix(batch.column(0)))
            for c in np.unique(cell).tolist():
                own = cell == c
                n[c] = n.get(c, 0) + int(own.sum())
                far[c] = max(far.get(c, 0.0), float(bound[own].max()))
                least, most = distance[own].min(0), distance[own].max(0)
                low[c], high[c] = np.minimum(low.get(c, least), least), np.maximum(high.get(c, most), most)
        p = len(self.pivots)
        found = sorted(n)
        columns = (np.repeat(found, p), np.tile(np.arange(p), len(found)), np.repeat([n[c] for c in found], p), np.repeat([far[c] for c in found], p), *(np.concatenate([x[c] for c in found]) if found else np.zeros(0) for x in (low, high)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int32()] * 2 + [pa.int64()] + [pa.float64()] * 3, strict=True)], ["cell", "pivot", "n", "far", "low", "high"])


class Groups:
    """How data and queries meet: groups of query cells, each a grid of query slices and data blocks of bounded size, a grid
    cell being a task. Memory of the plan: a cell's rings, pivots x pivots numbers."""

    def __init__(self, cells: Cells, rings: dict[int, tuple[int, float, np.ndarray, np.ndarray]]) -> None:
        self.cells, self.rings = cells, rings
        self.slack = 1e-6 * (1 + cells.largest)
        self.group_of: dict[int, int] = {c: i for i, c in enumerate(sorted(rings))}
        self.grid: dict[int, tuple[int, int]] = {}

    def needed(self, v: np.ndarray) -> np.ndarray:
        """rows x query cells (in order of their numbers): whether the cell's rings let the vector come within its bound."""
        distance = _distances(_lifted(v, self.cells.largest), self.cells.pivots)
        out = np.ones((len(v), len(self.rings)), bool)
        for i, c in enumerate(sorted(self.rings)):
            _, far, low, high = self.rings[c]
            out[:, i] = ((distance >= low - far - self.slack) & (distance <= high + far + self.slack)).all(1)
        return out

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows two query cells need both (on the diagonal, each): what joining them saves."""
        both = np.zeros((len(self.rings), len(self.rings)), np.int64)
        for batch in batches:
            if batch.num_rows:
                need = self.needed(_matrix(batch.column(0))).astype(np.float32)
                both += np.rint(need.T @ need).astype(np.int64)
        a, b = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(both[a, b])], ["a", "b", "n"])

    def settle(self, both: np.ndarray, block_rows: int, query_rows: int) -> None:
        """Greedy grouping: a cell joins the open group whose data overlap its own most, while it has room for the queries
        and sending the data once is no more than sending them twice: the overlap is at least half of what either needs."""
        order = sorted(self.rings)
        asked: list[int] = []
        members: list[list[int]] = []
        for i in sorted(range(len(order)), key=lambda i: -int(both[i, i])):
            n = self.rings[order[i]][0]
            best = max(
                (g for g in range(len(members)) if asked[g] + n <= query_rows and 2 * min(both[i, j] for j in members[g]) >= max(both[i, i], *(both[j, j] for j in members[g]))),
                key=lambda g: min(both[i, j] for j in members[g]),
                default=None,
            )
            if best is None:
                members.append([])
                asked.append(0)
                best = len(members) - 1
            members[best].append(i)
            asked[best] += n
        for g, own in enumerate(members):
            held = int(max(both[i, i] for i in own))
            self.grid[g] = (max(1, -(-asked[g] // query_rows)), max(1, -(-held // block_rows)))
            for i in own:
                self.group_of[order[i]] = g
        self.columns = [np.array(own) for own in members]

    def data(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            need = self.needed(_matrix(batch.column(2)))
            for group, (slices, blocks) in self.grid.items():
                rows = np.flatnonzero(need[:, self.columns[group]].any(1))
                if len(rows):
                    own = batch.take(pa.array(rows))
                    block = _hashed(np.asarray(own.column(1)) * 31 + np.asarray(own.column(0)), blocks)
                    for part in range(slices):
                        yield _piece(group, np.full(len(rows), part), block, own, False)

    def queries(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, _, _ = self.cells.bounds(_matrix(batch.column(2)))
            group_of = np.array([self.group_of[c] for c in cell.tolist()], np.int64)
            for group in np.unique(group_of).tolist():
                slices, blocks = self.grid[group]
                own = batch.take(pa.array(np.flatnonzero(group_of == group)))
                part = _hashed(np.asarray(own.column(1)) * 31 + np.asarray(own.column(0)), slices)
                for block in range(blocks):
                    yield _piece(group, part, np.full(own.num_rows, block), own, True)


def _hashed(ids: np.ndarray, n: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


_DEALT = "lane int, part int, block int, row_id long, vec_id long, v array<double>, is_query boolean"


def _piece(group: int, part: np.ndarray, block: np.ndarray, own: pa.RecordBatch, query: bool) -> pa.RecordBatch:
    n = own.num_rows
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, group, np.int32)), pa.array(part.astype(np.int32)), pa.array(block.astype(np.int32)), *own.columns, pa.array(np.full(n, query))], ["lane", "part", "block", "row_id", "vec_id", "v", "is_query"]
    )


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: in double precision where all sums are below 2^53, else in Python's integers."""
    most = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(q).dot(whole(x).T)


def best_of_block(q_key: np.ndarray, q: np.ndarray, key: np.ndarray, x: np.ndarray, k: int, tile: int = 512) -> pd.DataFrame:
    """Each query's k best rows of x, ties to smaller ids, without its own row. Keys are pairs (vec_id, row_id)."""
    order = np.lexsort((key[:, 1], key[:, 0]))
    key, x = key[order], x[order]
    out = []
    for at in range(0, len(q_key), tile):
        score = np.clip(inner_products(q[at : at + tile], x), LOWEST, HIGHEST).astype(np.int64)
        for row, (query, number) in enumerate(q_key[at : at + tile].tolist()):
            mine = score[row]
            usable = np.flatnonzero((key[:, 0] != query) | (key[:, 1] != number))
            if len(usable) > k:
                kth = np.partition(mine[usable], len(usable) - k)[len(usable) - k]
                usable = usable[mine[usable] >= kth]
            best = sorted((-int(mine[i]), *key[i].tolist()) for i in usable.tolist())[:k]
            out += [(query, number, i, n, -s) for s, i, n in best]
    return pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "row_id", "score"]).astype("int64")


_FOUND = "query_id long, query_row long, vec_id long, row_id long, score long"


def _solve(k: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["is_query"].to_numpy()
        if not asks.any() or asks.all():
            return pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")}, dtype="int64")
        v, key = np.stack(rows["v"].to_numpy()), rows[["vec_id", "row_id"]].to_numpy(np.int64)
        return best_of_block(key[asks], v[asks], key[~asks], v[~asks], k)

    return solve


def _planned(rows: DataFrame, is_query: str, k: int, pivots: int | None, block_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame, Groups, np.ndarray, int] | None:
    """The written data, the queries, their groups, the cells' overlaps and the number of rows; None without any."""
    data = materialise(quantised(rows), "vectors")
    lengths = data.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    data = data.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))
    count = data.count()
    wanted = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, int(count**0.5)))
    centres = [r["v"] for r in data.orderBy(hashed_order("vec_id"), "vec_id", "row_id").limit(wanted).collect()]
    if not centres:
        return None
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    largest = float(data.agg(F.max(norm)).first()[0])
    points = np.unique(_lifted(np.array(centres, float), largest), axis=0)
    # the k + 1 vectors nearest to each pivot; the limit is applied in each partition before the shuffle
    first = Window.partitionBy("cell").orderBy("radius", "v")
    placed = data.select("v").mapInArrow(_assign(points, largest), "v array<double>, cell int, radius double")
    central = [r["v"] for r in placed.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).collect()]
    cells = Cells(points, _lifted(np.array(central, float), largest), largest, k)
    asks = data.filter(is_query)
    parts = asks.select("v").mapInArrow(cells.summarise, "cell int, pivot int, n long, far double, low double, high double")
    merged = parts.groupBy("cell", "pivot").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # cells x pivots
    rings: dict[int, tuple[int, float, np.ndarray, np.ndarray]] = {}
    for r in merged:
        ring = rings.setdefault(r["cell"], (r["n"], r["far"], np.zeros(len(points)), np.zeros(len(points))))
        ring[2][r["pivot"]], ring[3][r["pivot"]] = r["low"], r["high"]
    if not rings:
        return None
    groups = Groups(cells, rings)
    both = np.zeros((len(rings), len(rings)), np.int64)
    for r in data.select("v").mapInArrow(groups.count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # cells x cells
        both[r["a"], r["b"]] = r["n"]
    groups.settle(both, block_rows, query_rows)
    return data, asks, groups, both, count


def needed_share(rows: DataFrame, is_query: str, k: int = TOP, pivots: int | None = None) -> float:
    """The share of the data that a query's cell needs, on average over the cells: what the bounds don't prune."""
    planned = _planned(rows, is_query, k, pivots, BLOCK_ROWS, QUERY_ROWS)
    return float(np.diag(planned[3]).mean() / planned[4]) if planned else 0.0


def top_inner_products(rows: DataFrame, is_query: str, k: int = TOP, pivots: int | None = None, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query row (SQL on vec_id), all if there are fewer.

    Unusable vectors take no part; no usable vector gives an empty result. Repeated rows are candidates each and ask each:
    only a query's own row is left out, so another row of its vec_id is a candidate, and a vec_id that occurs n times among
    the queries has n results of each rank. The length that most vectors have is the table's (the smaller of two); vectors of
    another length take no part. Very long ones are read whole. Scores beyond the range of a long saturate, and saturated
    scores tie. What reaches the driver: the pivots, k + 1 central vectors a cell, and the cells' rings and overlaps, pivots x pivots numbers.
    """
    planned = _planned(rows, is_query, k, pivots, block_rows, query_rows)
    if planned is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data, asks, groups, _, _ = planned
    dealt = data.mapInArrow(groups.data, _DEALT).unionByName(asks.mapInArrow(groups.queries, _DEALT))
    local = dealt.groupBy("lane", "part", "block").applyInPandas(_solve(k), _FOUND)
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_voronoi_topk(embeddings: DataFrame) -> DataFrame:
    return top_inner_products(embeddings, f"vec_id % {QUERY_EVERY} = 0")


#: DuckDB's SQL for the whole result.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
