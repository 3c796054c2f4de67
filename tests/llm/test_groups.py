"""SimHash groups (10), vectors (4), exact search (7), components: all against brute force."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import hnsw_dedup, simhash_vp, voronoi_topk
from glyphmill.llm.components import connected_components


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5)]
    nodes = sorted({x for e in edges for x in e})
    roots = brute_components(121, lambda i, j: (i, j) in edges or (j, i) in edges)
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    for x in nodes:
        if any(x in e and e[0] != e[1] for e in edges):
            assert found[x] == roots[x]
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def _texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    out = [" ".join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(50)]
    for base in out[:12]:
        parts = base.split()
        for _ in range(4):
            copy = list(parts)
            copy[rng.randrange(len(copy))] = "changed"
            out.append("\t ".join(copy).upper())
    return [*out, out[0], out[0], "", None, " \n", "One two", "one  TWO", "É é", "é É"]


def test_simhash(spark):
    texts = _texts()
    table = spark.createDataFrame([(i * 3 + 1, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    prints = [brute_fingerprint(t) for t in texts]
    roots = brute_components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    rows = {r["doc_id"]: r for r in simhash_vp.op10_simhash_vp(table).collect()}
    for i, p in enumerate(prints):
        assert rows[i * 3 + 1]["fingerprint"] == f"{p:016x}"
        assert rows[i * 3 + 1]["component_id"] == roots[i] * 3 + 1
    kept = simhash_vp.simhash_dedup(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({x * 3 + 1 for x in roots})


@pytest.mark.parametrize("blocks", [2, 3, 5])
@pytest.mark.parametrize("levels", [1, 4, 8])
def test_shards_lose_no_pair(blocks, levels):
    """Of two fingerprints within the radius, one is held where the other is held or asks; each is held once a block."""
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(3)])
    near = np.unique(near)
    visited, home = [set() for _ in near], [set() for _ in near]
    for block in range(blocks):
        for row, shard, held in zip(*(x.tolist() for x in simhash_vp.shard_keys(near, block, levels, blocks)), strict=True):
            visited[row].add(shard)
            if held:
                home[row].add(shard)
    assert all(len(h) == blocks for h in home)
    for i in range(len(near)):
        for j in range(i):
            if (int(near[i]) ^ int(near[j])).bit_count() <= 4:
                assert visited[i] & home[j] or visited[j] & home[i]


def test_trees_prune_branches():
    """Of unrelated fingerprints, a ball meets few of the tree's occupied shards, and the deeper the tree, the fewer rows."""
    fps = np.random.default_rng(6).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    compared = []
    for levels in (2, 4, simhash_vp.depth(len(fps), 21)):
        row, shard, held = simhash_vp.shard_keys(fps, 1, levels)
        occupied = len(np.unique(shard[held]))
        sizes = dict(zip(*(x.tolist() for x in np.unique(shard[held], return_counts=True)), strict=True))
        compared.append(sum(sizes.get(s, 0) for s in shard.tolist()))
        assert len(row) / len(fps) <= 1 + 22 / 2 + 0.5 and (levels < 4 or np.bincount(row).max() < 0.2 * occupied)
    assert compared[0] > 4 * compared[1] > 8 * compared[2]


def test_tree_links_equal_brute_force():
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 63, 200, dtype=np.uint64), np.uint64(77) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)), np.arange(3000, dtype=np.uint64)]))
    forests = list(simhash_vp.tree_links(fps, fps, 4, pairs=2000))
    u, v = simhash_vp.star_forest(*(np.concatenate([f[i] for f in forests]) for i in (0, 1)))
    roots = dict(zip(u.tolist(), v.tolist(), strict=True))
    linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    for i in range(0, len(fps), 7):
        for j in np.flatnonzero(linked[i]).tolist():
            a, b = int(fps[i].view(np.int64)), int(fps[j].view(np.int64))
            assert roots.get(a, a) == roots.get(b, b)
    far = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    assert not [f for f in simhash_vp.tree_links(far[:1500], far[1500:], 4, pairs=2000) if len(f[0])]


def test_simhash_rows(spark):
    table = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b"), (4, "a b"), (4, "other text of more words here"), (9, None)], "doc_id long, text string")
    rows = simhash_vp.op10_simhash_vp(table).collect()
    assert len(rows) == 6 and {r["component_id"] for r in rows if r["doc_id"] is None} == {4}
    kept = [(r["doc_id"], r["text"]) for r in simhash_vp.simhash_dedup(table).collect()]
    assert sorted(kept, key=str) == sorted([(4, "a b"), (4, "other text of more words here"), (9, None)], key=str)
    assert simhash_vp.op10_simhash_vp(table.limit(0)).count() == 0 and simhash_vp.simhash_dedup(table.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000), (2, "x" * 500_000)], "doc_id long, text string")
    assert {r["component_id"] for r in simhash_vp.op10_simhash_vp(long).collect()} == {1, 2}


@pytest.mark.parametrize("pairs", [50, 1 << 21])
def test_partition_links_equal_brute_force(pairs):
    """Shards of 1 to 300 rows in one partition: the forest joins what brute force joins within shards, but for two rows that
    both only ask."""
    rng = np.random.default_rng(12)
    shard = np.repeat(np.arange(40), [1, 2, 3, 4, 5, 8, 9, 17, 33, 64, 65, 128, 129, 300, *rng.integers(1, 40, 26)])
    fp = np.unique(rng.integers(0, 1 << 11, 4 * len(shard)))[: len(shard)]
    fp = np.resize(rng.permutation(fp), len(shard)) * (1 << 20)
    rows = sorted({(int(s), int(f)) for s, f in zip(shard, fp, strict=True)})
    ids = sorted({f for _, f in rows})
    at = {f: n for n, f in enumerate(ids)}
    held = {r: (r[0] * 7 + r[1] // (1 << 20)) % 3 > 0 for r in rows}
    linked = {(at[a], at[b]) for s, a in rows for t, b in rows if s == t and a != b and (a ^ b).bit_count() <= 4 and (held[s, a] or held[t, b])}
    linked |= {(j, i) for i, j in linked}
    expected = brute_components(len(ids), lambda i, j: (i, j) in linked)
    u, v = simhash_vp.partition_links(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([held[r] for r in rows]), pairs=pairs)
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    assert [root.get(f, f) for f in ids] == [ids[r] for r in expected]


# -- vectors -------------------------------------------------------------------------------------------------------


def _vectors():
    rng = np.random.default_rng(9)
    rows = list(rng.normal(size=(300, 16)))
    for centre in rng.normal(size=(6, 16)):
        rows += list(centre + rng.normal(size=(rng.integers(2, 60), 16)) * 0.12)
    rows += [rows[0], rows[0], rows[1] * 3, rows[1] * -1]
    return [[float(np.float32(x)) for x in r] for r in rows]


BAD = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]


def test_near_duplicate_vectors(spark):
    vectors = [*_vectors(), *BAD]
    table = spark.createDataFrame([(i + 10, v, i % 3, 1.5) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, n_links double")
    good = [i for i, v in enumerate(vectors) if i < len(vectors) - len(BAD)]
    x = np.array([vectors[i] for i in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    roots = brute_components(len(good), lambda i, j: linked[i, j])
    rows = {r["vec_id"]: r for r in hnsw_dedup.op4_hnsw_dedup(table).collect()}
    assert len(rows) == len(vectors)
    found = sum(rows[i + 10]["n_links"] for i in good)
    assert 0.99 * linked.sum() <= found <= linked.sum()
    assert sum(rows[i + 10]["component_id"] != roots[i] + 10 for i in good) <= 0.01 * len(good)
    for i in range(len(good), len(vectors)):
        assert (rows[i + 10]["n_links"], rows[i + 10]["component_id"], rows[i + 10]["kept"]) == (0, i + 10, True)


def test_vector_rows(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    rows = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in hnsw_dedup.op4_hnsw_dedup(table).collect()))
    assert rows == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert hnsw_dedup.op4_hnsw_dedup(table.limit(0)).count() == 0


def test_rows_of_one_id_are_vectors_of_their_own(spark, monkeypatch):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.05]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0])], "vec_id long, embedding array<float>")
    expected = [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3)]
    found = [sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in hnsw_dedup.op4_hnsw_dedup(table).collect())]
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings AS SELECT * FROM (VALUES (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.05])) t(vec_id, embedding)")
    assert sorted(r[:3] for r in con.sql(hnsw_dedup.SQL).fetchall()) == expected[:3]
    # audits that can't pass end in a comparison of whole shards, in blocks of any size
    monkeypatch.setattr(hnsw_dedup, "_audit", lambda *a: (0.0, 10**6))
    monkeypatch.setattr(hnsw_dedup, "COUNT_ROWS", 1)
    found.append(sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in hnsw_dedup.op4_hnsw_dedup(table).collect()))
    assert found == [expected, expected]


def test_graph_recall_on_a_dense_group():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1500, 32)), rng.normal(size=(1, 32)) + rng.normal(size=(700, 32)) * 0.05])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw_dedup.Graph.unpacked(hnsw_dedup.Graph(np.arange(len(x)), x).packed())
    q, node = graph.links_of(x, 0.9, 32)
    assert len(q) >= 0.999 * (x @ x.T >= 0.9).sum()
    assert len(set(zip(q.tolist(), node.tolist(), strict=True))) == len(q)


def test_top_inner_products(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(np.float32(x)) for x in r] for r in np.concatenate([rng.normal(size=(150, 8)), np.tile(rng.normal(size=(1, 8)), (12, 1))])] + [[1e-3] * 8, None, [float("nan")] * 8]
    table = pd.DataFrame({"vec_id": range(len(vectors)), "embedding": vectors})
    frame = spark.createDataFrame([(i, v, 7) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score int")
    rows = sorted(map(tuple, voronoi_topk.op7_voronoi_topk(frame).select("query_id", "rank", "vec_id", "score").collect()))
    con = duckdb.connect()
    con.register("frame", table[table.embedding.notna()].assign(embedding=lambda d: d.embedding.map(lambda v: np.array(v, np.float32))))
    con.sql("CREATE VIEW embeddings AS SELECT vec_id, embedding::FLOAT[] AS embedding FROM frame")
    assert rows == sorted(con.sql(voronoi_topk.SQL).fetchall())
    assert {r[0] for r in rows} == {0, 50, 100, 150}


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_top_of_few(spark, block_rows):
    """Rows are queries and candidates, whether they share an id or not; only the query's own row is left out."""
    frame = spark.createDataFrame([(50, [1.0, 0.0]), (51, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0]), (None, [2.0, 2.0])], "vec_id long, embedding array<float>")
    rows = sorted(tuple(r) for r in voronoi_topk.top_inner_products(frame, "vec_id % 50 = 0", block_rows=block_rows, query_rows=1).collect())
    one = [(50, 1, 50, 65536), (50, 2, 51, 65536), (50, 3, 50, 0)]
    assert rows == sorted([*one, *one, (50, 1, 50, 0), (50, 2, 50, 0), (50, 3, 51, 0)])
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings AS SELECT * FROM (VALUES (50, [1.0, 0.0]), (51, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0]), (NULL, [2.0, 2.0])) t(vec_id, embedding)")
    assert sorted(con.sql(voronoi_topk.SQL).fetchall()) == rows
    assert voronoi_topk.op7_voronoi_topk(frame.limit(0)).count() == 0
    assert voronoi_topk.op7_voronoi_topk(frame.filter("vec_id = 51")).count() == 0


def test_bounds_prune_clustered_data(spark):
    """Tight clusters: groups get no data but the near ones; results stay exact."""
    rng = np.random.default_rng(11)
    centres = np.eye(8) * 3
    vectors = np.concatenate([c + rng.normal(size=(60, 8)) * 0.01 for c in centres])
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert voronoi_topk.needed_share(frame, "vec_id % 50 = 0", pivots=24) < 0.3
    rows = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in voronoi_topk.top_inner_products(frame, "vec_id % 50 = 0", pivots=24, block_rows=25, query_rows=1).collect()}
    whole = np.floor(256 * vectors).astype(np.int64)
    for q in range(0, len(vectors), 50):
        score = whole @ whole[q]
        best = sorted((-int(score[i]), i) for i in range(len(vectors)) if i != q)[:5]
        assert [rows[(q, n + 1)] for n in range(5)] == [(i, -s) for s, i in best]


def test_large_components_are_exact():
    q, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 1.0], [2.0**40, 2.0]])
    assert voronoi_topk.inner_products(q, x).tolist() == [[2**80 + 1, 2**80 + 2]]


def test_huge_components_and_other_lengths(spark):
    """Scores beyond a long saturate and tie; vectors of another length than most, and those without a norm, take no part."""
    rows = [(0, [1e10, 1e10]), (1, [1e10, 2e10]), (2, [3e10, 1e10]), (3, [-1e10, -1e10]), (4, [1.5, 0.25]), (5, [1.0]), (6, [1e300, 0.0]), (7, [1e17, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    found = [(r["rank"], r["vec_id"], r["score"]) for r in voronoi_topk.op7_voronoi_topk(df).orderBy("rank").collect()]
    top = (1 << 63) - 1
    small = (384 + 64) * 256 * 10**10
    assert found == [(1, 1, top), (2, 2, top), (3, 7, top), (4, 4, small), (5, 3, -top - 1)]


def _far_apart(n, pairs, seed=3):
    """Scattered vectors with a few planted near pairs: (rows, the pairs' ids)."""
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(n, 24))
    for a, b in pairs:
        v[b] = v[a] + 0.05 * draw.normal(size=24)
    return [(i, x.tolist(), 0) for i, x in enumerate(v)]


def test_rare_links_are_found(spark):
    """Two near pairs in 6,000 vectors: too few links to measure a beam's recall, so the shards are compared in blocks."""
    pairs = [(17, 4211), (900, 5999)]
    df = spark.createDataFrame(_far_apart(6000, pairs), "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw_dedup.op4_hnsw_dedup(df).filter("n_links > 0").collect()}
    assert found == {x: (1, a) for a, b in pairs for x in (a, b)}


def test_audits_see_a_broken_graph(spark):
    """Graphs that lack a third of the vectors: the audits, which other means chose, don't pass at any width."""
    pairs = [(i, 1000 + i) for i in range(400)]
    df = spark.createDataFrame([(i, v) for i, v, _ in _far_apart(2000, pairs)], "rep long, embedding array<double>")
    linked = {r["rep"] for r in hnsw_dedup.linked_sample(df, 2000, 0.9, 3200).collect()}
    assert len(linked) > 400 and linked <= {x for p in pairs for x in p}

    def graphs(rows):
        return rows.withColumn("shard", F.col("rep") % 2).groupBy("shard").applyInPandas(hnsw_dedup._build, "shard long, graph binary")

    assert hnsw_dedup._audited_widths(df, graphs(df), 2000, 32, 0.9, 0.99, 2000)[24] is not None
    assert hnsw_dedup._audited_widths(df, graphs(df.filter("rep % 3 > 0")), 2000, 32, 0.9, 0.99, 64) == {24: None}
