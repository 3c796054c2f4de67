"""Variable-capacity best-fit packing (operator 6).

Documents are sequences of whitespace-separated words; one of more than the largest capacity is cut into full pieces and a
rest. Lengths are at most the largest capacity, so the packing of any number of pieces is planned on their histogram, which
has at most that many rows: a bin is opened at the size that costs least for each word it will hold, filled by best fit,
and downsized to the smallest size that holds its contents; the pattern is then repeated as often as the counts allow.
Pieces take the planned places by their rank among pieces of equal length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm._common import materialise
from glyphmill.llm.curriculum_mix import words

#: Permitted sequence lengths, and what opening a bin costs beside its length, in words.
CAPACITIES, OPENING = (512, 1024, 2048, 4096, 8192), 32
#: Pieces of a rank group (equal lengths that one window sorts), about.
GROUP_ROWS = 1_000


class Plan:
    """Places by length: for each length, arrays (first rank, copies in a bin, first bin, offset, stride of one copy)."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, per bin, first bin, offset, bins
        self.bins: list[tuple[int, int, int]] = []  # first bin, how many, capacity
        self.n_bins = 0


def _fill(space: int, lengths: list[int], counts: dict[int, int], first: int) -> list[tuple[int, int]]:
    """Best fit into a bin that holds `first`: again and again the longest piece that fits, as often as it does."""
    used = [(first, 1)]
    at = len(lengths)
    space -= first
    while space > 0:
        at = bisect.bisect_right(lengths, space, 0, at) - 1
        if at < 0:
            break
        length = lengths[at]
        n = min(space // length, counts[length] - (length == first))
        if n:
            used.append((length, n))
            space -= n * length
    return used


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, opening: int = OPENING) -> Plan:
    """Pack counts[length] pieces of each length; lengths are 1 to the largest capacity."""
    sizes = sorted(capacities)
    counts = {n: c for n, c in histogram.items() if n > 0 and c > 0}
    lengths = sorted(counts)
    out, taken = Plan(), dict.fromkeys(counts, 0)
    while lengths:
        largest = lengths[-1]
        best = None
        for size in sizes[bisect.bisect_left(sizes, largest) :]:
            used = _fill(size, lengths, counts, largest)
            held = sum(length * n for length, n in used)
            fitted = sizes[bisect.bisect_left(sizes, held)]  # downsized to its contents
            cost = (fitted + opening) / held
            if best is None or cost < best[0] - 1e-12:
                best = (cost, fitted, used)
        _, capacity, used = best
        need: dict[int, int] = {}
        for length, n in used:
            need[length] = need.get(length, 0) + n
        times = min(counts[length] // n for length, n in need.items())
        offset = 0
        for length, n in sorted(need.items(), reverse=True):
            out.rows.append((length, taken[length], n, out.n_bins, offset, times))
            offset += length * n
            taken[length] += n * times
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
                lengths.pop(bisect.bisect_left(lengths, length))
        out.bins.append((out.n_bins, times, capacity))
        out.n_bins += times
    return out


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """doc_id, piece, start, length: one row for each piece of each document; a row without words has one piece of length 0."""
    sized = docs.select("doc_id", words().alias("n"))
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(n - 1) div {largest}")))
    dealt = sized.select("doc_id", "n", F.explode(cut).alias("piece"))
    return dealt.select("doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("length"))


def _placed(planned: Plan):
    table = np.array(sorted(planned.rows), np.int64).reshape(-1, 6)
    starts = np.array([b[0] for b in planned.bins], np.int64)
    capacity = np.array([b[2] for b in planned.bins], np.int64)
    # one key orders (length, first rank): ranks stay below 2^45 and lengths below 2^17
    keys = (table[:, 0] << 45) | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column(3), np.int64), np.asarray(batch.column(4), np.int64)
            row = table[np.maximum(0, np.searchsorted(keys, (length << 45) | rank, "right") - 1)] if len(table) else np.zeros((len(length), 6), np.int64)
            k = rank - row[:, 1]
            per = np.maximum(1, row[:, 2])
            bin_id = row[:, 3] + k // per
            offset = row[:, 4] + (k % per) * length
            size = capacity[np.searchsorted(starts, bin_id, "right") - 1] if len(starts) else np.zeros(len(length), np.int64)
            none = length == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(bin_id, mask=none), pa.array(offset, mask=none), pa.array(size, mask=none)],
                ["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "capacity"],
            )

    return place


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, opening: int = OPENING) -> DataFrame:
    """doc_id, piece, start, length (in words), bin_id, bin_offset, capacity of every piece of every document.

    Null and wordless texts have one piece of length 0 in no bin (nulls). Repeated rows and null doc_ids are packed like
    others; further columns are ignored; an empty table gives an empty one. The driver holds the histogram and the plan:
    at most the largest capacity's number of lengths. Ranks among equal lengths are counts by hash group, then a window
    within the group. Each length has as many groups as its pieces need, so a common length is spread over all tasks and
    rare ones take a group each.
    """
    largest = max(capacities)
    cut = materialise(pieces(docs, largest), "pieces")
    histogram = dict(cut.groupBy("length").count().collect())  # one row a length
    planned = plan(histogram, capacities, opening)
    groups = cut.sparkSession.createDataFrame([(n, -(-count // GROUP_ROWS)) for n, count in histogram.items()], "length long, groups long")
    cut = cut.join(F.broadcast(groups), "length").withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), "groups"))
    per_group = cut.groupBy("length", "g").count()
    earlier = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_group.select(F.col("length").alias("_l"), F.col("g").alias("_g"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("_l", "_g").orderBy("doc_id", "piece")
    ranked = cut.join(bases, (F.col("length") == F.col("_l")) & (F.col("g") == F.col("_g"))).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = ranked.select("doc_id", "piece", "start", "length", "rank")
    return rows.mapInArrow(_placed(planned), f"doc_id {kind}, piece long, start long, length long, bin_id long, bin_offset long, capacity long")


def op6_bestfit_pack(docs: DataFrame) -> DataFrame:
    return pack(docs)
