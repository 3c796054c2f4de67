"""Embedding near-duplicates (operator 4): hierarchical navigable small-world graphs per shard.

Vectors are dealt to shards by a hash; each shard builds one graph. Every distinct vector queries every shard's graph. A
beam is widened for a query until its worst member is below the threshold, so that a dense group is walked to its edge, and
the beam's base width is doubled until audits against brute force pass. Most audited vectors are ones with links, which a
second search finds that knows nothing of the graphs: hashes by random hyperplanes. Where the widest beam fails, or where
too few true links can be had to measure recall, the shards are compared in blocks. Links are verified in double precision. A task keeps a spanning forest of its links, not the pairs; components are
united over all tasks. Within a component links are counted exactly, in blocks, so a link that only one end found, or none,
counts at both.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.numeric import cosine
from glyphmill.llm._common import materialise
from glyphmill.llm.components import connected_components, star_forest

THRESHOLD = 0.9
#: Links of a node above the ground layer and on it; width of the beam while building; least shards; rows of a shard.
M, M_GROUND, EF_BUILD, SHARDS, SHARD_ROWS = 12, 24, 48, 4, 50_000
#: Base width of a query's beam, its audited recall, rows of a query block and blocks that meet a copy of a graph.
EF_SEARCH, RECALL, QUERY_ROWS, BLOCKS_PER_TASK = 32, 0.99, 2048, 16
#: Audited queries of a length of vectors at first, of all lengths at most, and the true links that they must have together.
AUDITED, MOST_AUDITED, TRUE_LINKS = 200, 3200, 200
#: Tables of hyperplane hashes, and bits of a hash beyond those that tell all rows apart.
TABLES, SPARE_BITS = 16, 2
#: Rows of a side of a block in which a component's links are counted, and rows that a counting task holds, about.
COUNT_ROWS, COUNT_TASK = 2048, 20_000
_FLOAT_SLACK = 1e-3


# -- the graph -----------------------------------------------------------------------------------------------------


class Graph:
    """One shard's graph. layers[l] = (members: node ids on the layer, links: |members| x degree, -1 where there is none,
    place: node id -> row); all searches run for many queries in step."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 4) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[order], vectors[order]
        self.x = self.exact.astype(np.float32)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(rng.random(len(ids)) + 1e-12) / np.log(M)).astype(int)
        self.layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for top in range(int(level.max(initial=0)), -1, -1):
            self._add_layer(np.flatnonzero(level >= top), M_GROUND if top == 0 else M, rng)

    def _add_layer(self, members: np.ndarray, degree: int, rng: np.random.Generator) -> None:
        """Insert the layer's members in growing batches: the layers above give the entries, a beam on the layer the
        candidates, joined by the batch's own nearest; the links are chosen for spread, both ways."""
        n = len(members)
        links = np.full((n, degree), -1, np.int64)
        place = np.full(len(self.ids), -1, np.int64)
        order = rng.permutation(n)
        done, batch = 0, 32
        while done < n:
            rows = order[done : done + batch]
            fresh = self.x[members[rows]]
            near = np.argsort(-(fresh @ fresh.T), axis=1)[:, 1 : EF_BUILD // 2 + 1]
            found = rows[near]
            if done:
                entry = place[self._entries(fresh)] if self.layers else np.full(len(rows), order[0])
                entry = np.where(entry >= 0, entry, order[0])
                found = np.concatenate([self._beam(fresh, entry, members, links, EF_BUILD), found], 1)
            self._connect(rows, found, members, links)
            place[members[rows]] = rows
            done += len(rows)
            batch = min(1024, max(32, done))
        self.layers.append((members, links, place))

    def _entries(self, queries: np.ndarray) -> np.ndarray:
        """The node nearest to each query that greedy descent through the finished layers finds."""
        here = np.full(len(queries), self.layers[0][0][0])
        for members, links, place in self.layers:
            here = members[self._beam(queries, place[here], members, links, 4)[:, 0]]
        return here

    def _spread(self, rows: np.ndarray, candidates: np.ndarray, members: np.ndarray, degree: int) -> np.ndarray:
        """The candidates that are nearer to the row than to any one chosen before, the nearest first; then the nearest."""
        c = np.where(candidates == rows[:, None], -1, candidates)
        c = -np.sort(-c, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        v = self.x[members[np.maximum(c, 0)]]
        to_row = np.where(c >= 0, np.einsum("nd,ncd->nc", self.x[members[rows]], v), -9.0)
        order = np.argsort(-to_row, axis=1, kind="stable")[:, : 2 * degree]
        c, to_row, v = np.take_along_axis(c, order, 1), np.take_along_axis(to_row, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        between = v @ v.transpose(0, 2, 1)
        width = c.shape[1]
        chosen = np.zeros(c.shape, bool)
        closest = np.full(c.shape, -9.0)
        for j in range(width):
            take = (c[:, j] >= 0) & (to_row[:, j] > closest[:, j]) & (chosen.sum(1) < degree)
            chosen[:, j] = take
            closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
        rank = np.where(chosen, 0, 1) * width + np.arange(width) + np.where(c >= 0, 0, 4 * width)
        best = np.argsort(rank, axis=1)[:, :degree]
        out = np.full((len(rows), degree), -1, np.int64)
        out[:, : best.shape[1]] = np.take_along_axis(c, best, 1)
        return out

    def _connect(self, rows: np.ndarray, found: np.ndarray, members: np.ndarray, links: np.ndarray) -> None:
        degree = links.shape[1]
        if found.shape[1] == 0:
            return
        links[rows] = self._spread(rows, found, members, degree)
        back = np.repeat(rows, degree), links[rows].ravel()
        keep = back[1] >= 0
        source, target = back[0][keep], back[1][keep]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hit, first, counts = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(hit), 1024):
            some, at, n = hit[low : low + 1024], first[low : low + 1024], counts[low : low + 1024]
            # a node that many chose at once keeps the nearest of them: 3 x degree candidates in equal steps
            width = int(min(n.max(), 3 * degree))
            step = np.minimum(np.arange(width)[None, :] * np.maximum(1, n[:, None] // width), n[:, None] - 1)
            more = source[at[:, None] + step]
            links[some] = self._spread(some, np.concatenate([links[some], more], 1), members, degree)

    def _beam(self, queries: np.ndarray, entry: np.ndarray, members: np.ndarray, links: np.ndarray, width: int) -> np.ndarray:
        """Rows of the layer, the nearest first: best-first search of all queries in step, `width` kept for each, -1 to fill.

        Each round opens every query's four best unopened members; a query ends when none is left.
        """
        n, rows_all = len(queries), np.arange(len(queries))
        keep = np.full((n, width), -1, np.int64)
        sim = np.full((n, width), -9.0, np.float32)
        opened = np.ones((n, width), bool)
        keep[:, 0], sim[:, 0], opened[:, 0] = entry, np.einsum("nd,nd->n", queries, self.x[members[entry]]), False
        seen = np.zeros((n, len(members) // 8 + 1), np.uint8)
        np.bitwise_or.at(seen, (rows_all, entry >> 3), (1 << (entry & 7)).astype(np.uint8))
        at_once = min(4, width)
        live = rows_all
        while len(live):
            score = np.where(opened[live], -9.0, sim[live])
            pick = np.argpartition(-score, at_once - 1, axis=1)[:, :at_once] if width > at_once else np.tile(np.arange(width), (len(live), 1))
            real = np.take_along_axis(score, pick, 1) > -9.0
            np.put_along_axis(tmp := opened[live], pick, True, 1)
            opened[live] = tmp
            nodes = np.take_along_axis(keep[live], pick, 1)
            nxt = np.where(real[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            nxt = -np.sort(-nxt, axis=1)
            nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = -1
            at = np.maximum(nxt, 0)
            known = (seen[live[:, None], at >> 3] >> (at & 7).astype(np.uint8)) & 1
            nxt = np.where(known == 1, -1, nxt)
            q, col = np.nonzero(nxt >= 0)
            node = nxt[q, col]
            np.bitwise_or.at(seen, (live[q], node >> 3), (1 << (node & 7)).astype(np.uint8))
            s = np.full(nxt.shape, -9.0, np.float32)
            s[q, col] = np.einsum("nd,nd->n", queries[live[q]], self.x[members[node]])
            every = np.concatenate([sim[live], s], 1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :width]
            sim[live] = np.take_along_axis(every, order, 1)
            keep[live] = np.take_along_axis(np.concatenate([keep[live], nxt], 1), order, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], nxt < 0], 1), order, 1)
            live = live[(~opened[live]).any(1)]
        return keep

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, exact=self.exact, **{f"m{i}": m.astype(np.int32) for i, (m, _, _) in enumerate(self.layers)}, **{f"l{i}": x.astype(np.int32) for i, (_, x, _) in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, blob: bytes) -> Graph:
        held = np.load(io.BytesIO(blob))
        self = cls.__new__(cls)
        self.ids, self.exact = held["ids"], held["exact"]
        self.x = self.exact.astype(np.float32)
        self.layers = []
        for i in range(sum(k.startswith("m") for k in held.files)):
            members = held[f"m{i}"].astype(np.int64)
            place = np.full(len(self.ids), -1, np.int64)
            place[members] = np.arange(len(members))
            self.layers.append((members, held[f"l{i}"].astype(np.int64), place))
        return self

    # -- range queries ---------------------------------------------------------------------------------------------

    def links_of(self, vectors: np.ndarray, threshold: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, node) of the found nodes with cosine >= threshold in double precision. Where the whole beam reaches
        the threshold it is widened fourfold, up to the whole shard, and the query runs again."""
        out_q, out_n = [], []
        members, links, place = self.layers[-1]
        todo = np.arange(len(vectors))
        queries = vectors.astype(np.float32)
        while len(todo):
            size = min(width, len(members))
            again = []
            step = int(max(16, min(1024, (64 << 20) // (len(members) // 8 + 40 * size))))
            for low in range(0, len(todo), step):
                rows = todo[low : low + step]
                entry = place[self._entries(queries[rows])]
                found = self._beam(queries[rows], entry, members, links, size)
                node = members[np.maximum(found, 0)]
                sim = np.where(found >= 0, np.einsum("nd,nkd->nk", queries[rows], self.x[node]), -9.0)
                full = (sim >= threshold - _FLOAT_SLACK).all(1) & (size < len(members))
                again.append(rows[full])
                q, k = np.nonzero((sim >= threshold - _FLOAT_SLACK) & ~full[:, None])
                exact = np.einsum("nd,nd->n", vectors[rows[q]], self.exact[node[q, k]])
                good = exact >= threshold
                out_q.append(rows[q[good]])
                out_n.append(node[q, k][good])
            todo = np.concatenate(again)
            width *= 4
        return (np.concatenate(out_q), np.concatenate(out_n)) if out_q else (np.zeros(0, np.int64),) * 2


# -- Spark ---------------------------------------------------------------------------------------------------------


def usable() -> F.Column:
    """False for vectors that are null, zero or hold null or non-finite components, and for null vec_ids."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = F.exists("embedding", lambda c: c != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some, F.lit(False))


def _unit(column: pd.Series) -> np.ndarray:
    v = np.stack(column.to_numpy()).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    graph = Graph(rows["rep"].to_numpy(), _unit(rows["embedding"]))
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "graph": [graph.packed()]})


def _found(graph: Graph, ids: np.ndarray, vectors: np.ndarray, width: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query row, linked id) against a shard's graph; without a width, by comparing the whole shard in blocks."""
    if vectors.shape[1] != graph.exact.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)  # vectors of unequal length link with nothing
    if width is None:
        hits = [np.nonzero(vectors[at : at + 256] @ graph.exact.T >= threshold) for at in range(0, len(vectors), 256)]
        q = np.concatenate([h[0] + 256 * n for n, h in enumerate(hits)])
        node = np.concatenate([h[1] for h in hits])
    else:
        q, node = graph.links_of(vectors, threshold, width)
    other = graph.ids[node]
    apart = other != ids[q]
    return q[apart], other[apart]


def _query(widths: dict[int, int | None], threshold: float):
    def run(graphs: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for blob in graphs["graph"]:
            graph = Graph.unpacked(blob)
            for raw_ids, raw in zip(blocks["ids"], blocks["vectors"], strict=True):
                ids = np.frombuffer(raw_ids, np.int64)
                q, other = _found(graph, ids, np.frombuffer(raw, np.float64).reshape(len(ids), -1), widths.get(graph.exact.shape[1]), threshold)
                if len(q):
                    a, b = star_forest(ids[q], other)
                    u.append(a)
                    v.append(b)
        a, b = np.concatenate(u), np.concatenate(v)
        if len(a):
            a, b = star_forest(a, b)  # one forest a task
        return pd.DataFrame({"u": a, "v": b})

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks: ids and unit vectors of up to QUERY_ROWS rows of equal length as two byte strings."""
    for batch in batches:
        ids = np.asarray(batch.column(0), np.int64)
        vectors = batch.column(1)
        lengths = np.diff(np.asarray(vectors.offsets))
        for d in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == d)
            unit = _unit(pd.Series(list(np.asarray(vectors.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), d))))
            for at in range(0, len(rows), QUERY_ROWS):
                own = slice(at, at + QUERY_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([ids[rows[own]].tobytes()], pa.binary()), pa.array([unit[own].tobytes()], pa.binary()), pa.array([d], pa.int64())], ["ids", "vectors", "width"])


def _audit(sample: list, rows: DataFrame, graphs: DataFrame, width: int, threshold: float) -> tuple[float, int]:
    """(mean recall over the audited queries that have links, their true links) against brute force over all distinct
    vectors, in blocks; a link counts once, whatever its copies."""
    ids = np.array([r["rep"] for r in sample], np.int64)
    vectors = _unit(pd.Series([r["embedding"] for r in sample]))

    def counts(n: np.ndarray, kind: str) -> pa.RecordBatch:
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array([kind] * len(some), pa.string()), pa.array(n[some].astype(np.int64))], ["q", "kind", "n"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, _ = _found(Graph.unpacked(batch.column(0)[row].as_py()), ids, vectors, width, threshold)
                yield counts(np.bincount(q, minlength=len(ids)), "found")

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.diff(np.asarray(batch.column(1).offsets))
            fit = np.flatnonzero(lengths == vectors.shape[1])
            if len(fit):
                own = _unit(pd.Series(list(np.asarray(batch.column(1).take(pa.array(fit)).flatten(), np.float64).reshape(len(fit), -1))))
                hit = (own @ vectors.T >= threshold) & (np.asarray(batch.column(0))[fit][:, None] != ids[None, :])
                yield counts(hit.sum(0), "true")

    kind = "q long, kind string, n long"
    every = graphs.select("graph").mapInArrow(ask, kind).unionByName(rows.select("rep", "embedding").mapInArrow(brute, kind))
    held = {(r["kind"], r["q"]): r["n"] for r in every.groupBy("kind", "q").agg(F.sum("n").alias("n")).collect()}  # two numbers an audited query
    true = {q: n for (k, q), n in held.items() if k == "true"}
    return (float(np.mean([held.get(("found", q), 0) / n for q, n in true.items()])) if true else 1.0), sum(true.values())


def _hashed(bits: int, tables: int = TABLES):
    """(table, key, rep): a vector's side of `bits` random hyperplanes, for each table; the length is part of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, vectors = np.asarray(batch.column(0), np.int64), batch.column(1)
            lengths = np.diff(np.asarray(vectors.offsets))
            for d in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == d)
                unit = _unit(pd.Series(list(np.asarray(vectors.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), d))))
                planes = np.random.default_rng([d, bits]).normal(size=(d, tables, bits))
                sides = np.einsum("nd,dtb->ntb", unit, planes) > 0
                keys = sides @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables), len(rows)) + d * tables, pa.int64()), pa.array(keys.ravel(), pa.int64()), pa.array(np.repeat(reps[rows], tables), pa.int64())], ["table", "key", "rep"]
                )

    return run


def linked_sample(distinct: DataFrame, total: int, threshold: float, most: int) -> DataFrame:
    """(rep, embedding) of up to `most` vectors that have a link, found by hashing alone.

    Of each hash bucket the first and the last row meet, so a bucket costs two numbers however many rows share it; the pairs,
    bounded in hashed order, are verified. What is found doesn't depend on any graph.
    """
    bits = min(40, max(1, total).bit_length() + SPARE_BITS)
    hashed = distinct.select("rep", "embedding").mapInArrow(_hashed(bits), "table long, key long, rep long")
    met = hashed.groupBy("table", "key").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u < v").select("u", "v").distinct()
    few = met.orderBy(F.xxhash64("u", "v"), "u", "v").limit(4 * most)
    one, two = (distinct.select(F.col("rep").alias(c), F.col("embedding").alias(f"_{c}")) for c in "uv")
    near = few.join(one, "u").join(two, "v").filter(F.size("_u") == F.size("_v")).filter(cosine(F.col("_u"), F.col("_v")) >= threshold)
    ends = near.select(F.explode(F.array(F.struct(F.col("u").alias("rep"), F.col("_u").alias("embedding")), F.struct(F.col("v").alias("rep"), F.col("_v").alias("embedding")))).alias("e")).select("e.*")
    return ends.dropDuplicates(["rep"]).limit(most)


def _audited_widths(distinct: DataFrame, graphs: DataFrame, total: int, width: int, threshold: float, recall: float, rows_of_shard: int) -> dict[int, int | None]:
    """By length of vectors the base width at which its audits pass; None where the shards are to be compared in blocks: no
    beam up to the size of a shard passes, or the audited vectors have too few true links to tell. Lengths that aren't
    audited, as too few rows have them, are absent and compared in blocks as well.

    Three of four audited vectors have links by hashing, as far as there are such; the others are the first in hashed order.
    MOST_AUDITED of either kind are collected at most, whatever the number of lengths.
    """
    linked = linked_sample(distinct, total, threshold, MOST_AUDITED).collect()
    plain = distinct.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(MOST_AUDITED).collect()
    known = {r["rep"] for r in linked}
    by_length: dict[int, tuple[list, list]] = {}
    for kind, rows in enumerate((linked, [r for r in plain if r["rep"] not in known])):
        for r in rows:
            by_length.setdefault(len(r["embedding"]), ([], []))[kind].append(r)
    widths: dict[int, int | None] = {}
    for length, (first, second) in by_length.items():
        sample = []
        while first or second:
            sample += [*first[:3], *second[:1]]
            first, second = first[3:], second[1:]
        size, wide = AUDITED, width
        while True:
            reached, true = _audit(sample[:size], distinct, graphs, wide, threshold)
            if true < TRUE_LINKS and size < len(sample):
                size *= 4
            elif true < TRUE_LINKS or reached < recall and wide >= rows_of_shard:
                widths[length] = None
                break
            elif reached >= recall:
                widths[length] = wide
                break
            else:
                wide *= 2
    return widths


def _linked_within(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """For each asking row of the blocks that a task holds, the copies of the held rows of its block that it links with."""
    ids, sums = [], []
    for _, block in rows.groupby(["root", "a", "b", "width"]):
        held, asks = block[block["held"]], block[~block["held"]]
        if held.empty or asks.empty:
            continue
        x, copies, keys = _unit(held["embedding"]), held["copies"].to_numpy(), held["rep"].to_numpy()
        own = asks["rep"].to_numpy()
        y = _unit(asks["embedding"])
        for at in range(0, len(own), 256):
            near = (y[at : at + 256] @ x.T >= threshold) & (keys[None, :] != own[at : at + 256, None])
            ids.append(own[at : at + 256])
            sums.append((near * copies[None, :]).sum(1))
    return pd.DataFrame({"rep": np.concatenate(ids) if ids else [], "n": np.concatenate(sums) if sums else []}).astype("int64")


def component_links(distinct: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(rep, n): the rows that each vector of a component links with, counted exactly. A component is a grid of blocks of
    COUNT_ROWS vectors, and a task takes as many small ones as its share of rows allows."""
    blocks = roots.groupBy("root").agg(F.ceil(F.count("*") / COUNT_ROWS).cast("int").alias("blocks"))
    own = roots.join(blocks, "root").withColumnRenamed("node", "rep").join(distinct, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = F.concat(
        F.transform(every, lambda x: F.struct(F.col("own").alias("a"), x.alias("b"), F.lit(False).alias("held"))),
        F.transform(every, lambda x: F.struct(x.alias("a"), F.col("own").alias("b"), F.lit(True).alias("held"))),
    )
    dealt = own.select("rep", "embedding", "copies", "root", F.size("embedding").alias("width"), F.explode(cells).alias("c")).select("rep", "embedding", "copies", "root", "width", "c.*")
    parts = max(1, -(-2 * own.agg(F.sum("blocks")).first()[0] // COUNT_TASK))
    task = F.pmod(F.xxhash64("root", "a", "b"), F.lit(parts)).alias("task")
    found = dealt.select("*", task).groupBy("task").applyInPandas(lambda rows: _linked_within(rows, threshold), "rep long, n long")
    return found.groupBy("rep").agg(F.sum("n").alias("n"))


def near_duplicate_vectors(rows: DataFrame, threshold: float = THRESHOLD, width: int = EF_SEARCH, recall: float = RECALL, shards: int = SHARDS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Equal vectors meet in one representative before any search, whatever their vec_ids, so a group of copies costs one
    query; its size counts in n_links. Unusable vectors and null vec_ids link with nothing, vectors of unequal length not
    with each other; very long ones are read whole. Repeated rows, and rows of one vec_id, are vectors of their own and
    link. An empty table gives an empty one; further columns are ignored. To the driver go the audited vectors and two
    numbers for each.
    """
    spark = rows.sparkSession
    good = rows.filter(usable()).select("vec_id", "embedding")
    grouped = good.groupBy("embedding").agg(F.min("vec_id").cast("long").alias("first_id"), F.count("*").alias("copies"))
    distinct = materialise(grouped.select(F.monotonically_increasing_id().alias("rep"), "first_id", "embedding", "copies"), "vectors")
    total = distinct.count()
    found = spark.createDataFrame([], "u long, v long")
    if total:
        shards = max(shards, -(-total // SHARD_ROWS))
        dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)) + F.size("embedding").cast("long") * shards)  # a graph for each length
        graphs = materialise(dealt.groupBy("shard").applyInPandas(_build, "shard long, graph binary"), "graphs")
        widths = _audited_widths(distinct, graphs, total, width, threshold, recall, min(total, SHARD_ROWS))
        parts = max(1, -(-total // (QUERY_ROWS * BLOCKS_PER_TASK)))
        blocks = distinct.select("rep", "embedding").repartition(parts * 2, "rep").mapInArrow(_pack, "ids binary, vectors binary, width long")
        spread = graphs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        own_shards = F.sequence(F.col("width") * shards, F.col("width") * shards + shards - 1)  # a block asks all shards of its length
        asked = blocks.select("ids", "vectors", F.pmod(F.xxhash64("ids"), F.lit(parts)).alias("part"), F.explode(own_shards).alias("shard"))
        answered = spread.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(_query(widths, threshold), "u long, v long")
        found = materialise(answered, "links")
    roots = materialise(connected_components(found), "roots")
    counts = component_links(distinct, roots, threshold) if total and not roots.isEmpty() else spark.createDataFrame([], "rep long, n long")
    joined = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = joined.join(least, "root").join(counts, "rep", "left")
    groups = groups.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(groups, "embedding").select("vec_id", "n_links", "component_id")
    lone = rows.filter(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_hnsw_dedup(embeddings: DataFrame) -> DataFrame:
    return near_duplicate_vectors(embeddings)


#: DuckDB's SQL for the whole result: all pairs, then the transitive closure.
SQL = """
WITH RECURSIVE every AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
good AS (
  SELECT r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM every
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.9),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, least(min(x.vec_id), min(y.vec_id)) AS c FROM reach JOIN good x ON x.r = a JOIN good y ON y.r = b GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(m.c, e.vec_id)::BIGINT AS component_id, coalesce(m.c, e.vec_id) = e.vec_id AS kept
FROM every e LEFT JOIN counted c ON c.a = e.r LEFT JOIN least m ON m.a = e.r
"""
