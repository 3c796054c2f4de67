"""SimHash near-duplicates (operator 10): vantage-point trees over 64-bit fingerprints.

One tree on whole fingerprints can't prune at a radius of 4: distances between unrelated fingerprints concentrate at 32 +- 4,
so a ball crosses two thirds of all boundaries. The fingerprint is therefore cut into three bit blocks; of two fingerprints
within 4 bits one block at least is within 4 // 3 = 1 bit. Each block has a vantage-point tree: a level splits by the Hamming
distance to its vantage point, one branch a distance, and a leaf is a shard. A fingerprint is held by the one shard of its
own path and asks in every other shard that its ball of radius 1 overlaps; all other branches are pruned by the triangle
bound, as no member of the ball has their distance. The tree is as deep as the rows need.

Inside a shard with many rows a second tree grows on whole fingerprints, whose vantage points are rows of the shard: asking
rows go down every side of a boundary that lies within 4 bits. Pairs are linked by their exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._common import materialise, slices, texts
from glyphmill.llm.components import connected_components, star_forest

SHINGLE, SEED, RADIUS, BLOCKS = 4, 42, 4, 3
#: Rows of a shard that the depth of the trees aims at, the most levels, and dealt rows of a task, about.
LEAF_ROWS, MOST_LEVELS, TASK_ROWS = 16, 10, 400_000
#: Pairs that are compared at once; a shard of more pairs grows a tree of its own.
PAIRS = 1 << 21


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of the whole text, repeats included; A-Z lower-cased."""
    joined = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1]).tolist()
    ends = np.concatenate([gaps, [len(joined)]]).tolist()
    count = max(1, len(starts) - width + 1)
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    last = ends[width - 1 :] if len(ends) >= width else ends[-1:]
    return np.fromiter((digest(view[s:e], SEED) for s, e in zip(starts, last, strict=False)), np.uint64, count)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero if there is none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            found = [fingerprint(shingle_hashes(t)) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())], ["doc_id", "text_hash", "fp"])


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) for every row; the 64 bits of fp as a signed long."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


# -- shards: a vantage-point tree for each block -------------------------------------------------------------------


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block; they cover 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:], strict=False)]


def vantage_points(width: int, levels: int) -> list[int]:
    """One vantage point a level. They are rows of a Hadamard matrix as bits, so the distances to them are uncorrelated: a
    branch of one level says as little as possible about the next one's. Rows of one bit come first, which tell bits apart."""
    rows = sorted(range(1 << max(1, (width - 1).bit_length())), key=lambda r: (r.bit_count(), r))
    return [sum(((i & r).bit_count() & 1) << i for i in range(width)) for r in rows[:levels]]


def depth(rows: int, width: int) -> int:
    """Levels that bring a shard to about LEAF_ROWS rows: a first level has about sqrt(2 pi e width / 4) branches, a further
    one half of that, as all distances of a value share their parity."""
    branches = math.sqrt(2 * math.pi * math.e * width / 4)
    return min(MOST_LEVELS, 1 + max(1, math.ceil(math.log(max(1.0, rows / LEAF_ROWS / branches)) / math.log(branches / 2))))


def paths(values: np.ndarray, width: int, points: list[int]) -> np.ndarray:
    """The leaf of each value: its distances to the vantage points, as the digits of a number."""
    out = np.zeros(values.shape, np.int64)
    for point in points:
        out = out * (width + 1) + np.bitwise_count(values ^ np.uint64(point))
    return out


def shard_keys(fps: np.ndarray, block: int, levels: int, blocks: int = BLOCKS, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, held): the shard that holds each fingerprint, and the later ones that its ball in the block overlaps.

    Overlap is mutual, so of two shards that the balls of two rows overlap only the later one is asked.
    """
    shift, width = block_bounds(blocks)[block]
    values = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    points = vantage_points(width, levels)
    own = paths(values, width, points)
    flips = [sum(1 << i for i in bits) for n in range(1, radius // blocks + 1) for bits in combinations(range(width), n)]
    if not flips:
        return np.arange(len(fps)), own * blocks + block, np.ones(len(fps), bool)
    ball = np.sort(paths(values[:, None] ^ np.array(flips, np.uint64)[None, :], width, points), axis=1)
    fresh = ball > own[:, None]
    fresh[:, 1:] &= ball[:, 1:] != ball[:, :-1]
    row, at = np.nonzero(fresh)
    rows = np.concatenate([np.arange(len(fps)), row])
    shard = np.concatenate([own, ball[row, at]]) * blocks + block
    return rows, shard, np.arange(len(rows)) < len(fps)


def _deal(levels: int, blocks: int, radius: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = np.asarray(batch.column(0))
            for block in range(blocks):
                rows, shard, held = shard_keys(signed.view(np.uint64), block, levels, blocks, radius)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(signed[rows]), pa.array(held)], ["shard", "fp", "held"])

    return deal


# -- inside a shard ------------------------------------------------------------------------------------------------


def tree_links(held: np.ndarray, asks: np.ndarray, radius: int = RADIUS, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forests of the links between held and asking fingerprints (uint64), by a vantage-point tree over the held ones.

    A node splits its rows at the median distance to the vantage point that spreads them most; the asking rows go to both
    sides where the boundary is within the radius. A node is compared, in pieces, when it is small or can't be split.
    """
    stack = [(held, asks)]
    while stack:
        held, asks = stack.pop()
        if not len(held) or not len(asks):
            continue
        if len(held) * len(asks) > pairs and len(held) > 1:
            spread = [np.bitwise_count(held ^ held[at]).astype(np.int16) for at in (0, len(held) // 2, len(held) - 1)]
            best = int(np.argmax([d.std() for d in spread]))
            point, d = held[(0, len(held) // 2, len(held) - 1)[best]], spread[best]
            middle = int(np.median(d))
            if middle == d.max():
                middle -= 1
            near = d <= middle
            far_asks = np.bitwise_count(asks ^ point).astype(np.int16)
            low, high = far_asks <= middle + radius, far_asks > middle - radius
            work = int(near.sum()) * int(low.sum()) + int((~near).sum()) * int(high.sum())
            if 0 < near.sum() < len(held) and work < 0.95 * len(held) * len(asks):
                stack += [(held[near], asks[low]), (held[~near], asks[high])]
                continue
        step = max(1, pairs // len(held))
        for at in range(0, len(asks), step):
            part = asks[at : at + step]
            a, b = np.nonzero(np.bitwise_count(part[:, None] ^ held[None, :]) <= radius)
            u, v = part[a].view(np.int64), held[b].view(np.int64)
            apart = u != v
            if apart.any():
                yield star_forest(u[apart], v[apart])


def partition_links(shard: np.ndarray, fp: np.ndarray, held: np.ndarray, radius: int = RADIUS, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of all shards of a partition: each row against the held rows of its shard before it."""
    order = np.lexsort((fp, ~held, shard))
    shard, fp, held = shard[order], fp[order], held[order]
    n = len(shard)
    if not n:
        return fp, fp
    first = np.concatenate([[True], shard[1:] != shard[:-1]])
    starts = np.flatnonzero(first)
    number = np.cumsum(first) - 1
    rows_held = np.bincount(number, held, len(starts)).astype(np.int64)
    sizes = np.diff(np.append(starts, n))
    partners = np.minimum(np.arange(n) - starts[number], rows_held[number])
    large = np.bincount(number, partners, len(starts)) > pairs
    found = []
    for own in np.flatnonzero(large).tolist():
        rows = fp[starts[own] : starts[own] + sizes[own]].view(np.uint64)
        found += tree_links(rows[: rows_held[own]], rows, radius, pairs)
    partners[large[number]] = 0
    ends = np.cumsum(partners)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs, "right")))
        times = partners[at:to]
        a = np.repeat(np.arange(at, to), times)
        b = starts[number[a]] + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
        near = np.bitwise_count(fp[a].view(np.uint64) ^ fp[b].view(np.uint64)) <= radius
        if near.any():
            found.append(star_forest(fp[a[near]], fp[b[near]]))
        at = to
    u, v = (np.concatenate([x[i] for x in found]) if found else fp[:0] for i in (0, 1))
    return star_forest(u, v)


def _link(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(3)) for b in batches if b.num_rows]
        if parts:
            u, v = partition_links(*(np.concatenate([x[i] for x in parts]) for i in range(3)), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return link


def fingerprint_components(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root) for every distinct fingerprint that links with another one; root names its component."""
    rows = fps.count()
    width = 64 // blocks
    levels = depth(rows, width)
    dealt_rows = rows * blocks * (1 + (width // 2 if radius >= blocks else 0))
    parts = max(1, -(-dealt_rows // TASK_ROWS))
    dealt = fps.select("fp").distinct().mapInArrow(_deal(levels, blocks, radius), "shard long, fp long, held boolean")
    edges = dealt.repartition(parts, "shard").mapInArrow(_link(radius), "u long, v long")
    return connected_components(edges).select(F.col("node").alias("fp"), "root")


def simhash_components(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row per input row: doc_id, text_hash, fp, component_id, survivor.

    Copies meet in one fingerprint first, so groups of copies never form pairs. Null texts count as empty (fingerprint
    zero, linked like any other); null doc_ids count last; an empty table gives an empty one; further columns are
    ignored. component_id is the smallest doc_id of the component; survivor marks the rows of its representative, the
    smallest (doc_id, text_hash).
    """
    rows = materialise(fingerprint_rows(docs), "fingerprints")
    per_fp = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    roots = fingerprint_components(rows, radius, blocks)
    grouped = per_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    grouped = materialise(grouped, "fingerprint-groups")
    first = grouped.groupBy("root").agg(F.min("first").alias("first"))
    by_fp = grouped.select("fp", "root").join(first, "root").select("fp", "first")
    return rows.join(by_fp, "fp").select(
        "doc_id",
        "text_hash",
        "fp",
        F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("survivor"),
    )


def simhash_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that represent their component: one document of each group, columns as they came.

    Texts are shuffled once: the join and the removal of repeated rows share their key, a row's 128-bit hash.
    """
    key = {"__gm_a": F.xxhash64("doc_id", F.col("doc_id").isNull(), "text_hash"), "__gm_b": F.xxhash64(F.lit(7), "text_hash", "doc_id")}
    keep = simhash_components(docs, radius).filter("survivor").select(*(k.alias(n) for n, k in key.items())).distinct()
    hashed = docs.withColumn("__gm_h", F.xxhash64("text"))
    hashed = hashed.withColumns({"__gm_a": F.xxhash64("doc_id", F.col("doc_id").isNull(), "__gm_h"), "__gm_b": F.xxhash64(F.lit(7), "__gm_h", "doc_id")}).drop("__gm_h")
    return hashed.join(keep, ["__gm_a", "__gm_b"], "left_semi").dropDuplicates(["__gm_a", "__gm_b"]).select(*docs.columns)


def op10_simhash_vp(docs: DataFrame) -> DataFrame:
    found = simhash_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
