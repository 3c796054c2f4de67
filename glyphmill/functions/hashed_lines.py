"""Lines whose characters are picked by hash, a batch of lines at a time in arrays.

A character costs one or two MD5 digests. As expressions over arrays they are worked out one by one and uncompiled; here the
digests of a batch are taken together, in unsigned numpy arrays.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Fixed values of MD5: its start, constants and turns; the bytes of a block, of which eight hold the length and one ends the text.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_BLOCK, _ROOM = 64, 55
#: Characters that are worked on at once, but for a longer line.
CHARACTERS = 1 << 15


def _digest_starts(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of texts of one block each, padded."""
    words = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(len(blocks), x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, k = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, k = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, k = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, k = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[k]
        f += np.uint32(_ADDED[i])
        turned = f << np.uint32(_TURNS[i])
        f >>= np.uint32(32 - _TURNS[i])
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


class Keys:
    """Texts that the hashed keys of some rows begin with."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.sizes = texts, np.array([len(x) for x in texts], np.int64)
        self.padded = np.array(texts, f"S{_BLOCK}").view(np.uint8).reshape(-1, _BLOCK) if len(texts) and self.sizes.max() <= _BLOCK else None

    def uniform(self, rows: np.ndarray, marks: np.ndarray, numbers: np.ndarray | None = None) -> np.ndarray:
        """For each of rows a number in [0, 1): numeric.hashed_uniform of the row's text, the mark (a row of bytes, or one for
        all) and the number, if there are numbers."""
        n = len(rows)
        marks = np.broadcast_to(marks, (n, marks.shape[-1]))
        places = np.ones(n, np.int64) if numbers is not None else np.zeros(n, np.int64)
        if numbers is not None:
            for k in range(1, len(str(numbers.max(initial=0)))):
                places += numbers >= 10**k
        start = self.sizes[rows]
        end = start + marks.shape[1] + places
        if self.padded is None or end.max(initial=0) > _ROOM:
            tails = [b"%d" % x for x in numbers.tolist()] if numbers is not None else [b""] * n
            firsts = [hashlib.md5(self.texts[r] + m.tobytes() + x).digest()[:7] for r, m, x in zip(rows.tolist(), marks, tails, strict=True)]
            return np.array([int.from_bytes(x) >> 4 for x in firsts], np.float64) / float(1 << 52)
        blocks, every = self.padded[rows], np.arange(n)
        for j in range(marks.shape[1]):
            blocks[every, start + j] = marks[:, j]
        for k in range(int(places.max(initial=0))):
            own = np.flatnonzero(places > k)
            blocks[own, end[own] - 1 - k] = 48 + numbers[own] // 10**k % 10
        blocks[every, end] = 128
        blocks[:, 56], blocks[:, 57] = 8 * end & 255, 8 * end >> 8
        a, b = (x.byteswap().astype(np.uint64) for x in _digest_starts(blocks))
        return ((a << np.uint64(20)) | (b >> np.uint64(12))).astype(np.float64) / float(1 << 52)


def _mark(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each of its counted things, and the thing's 0-based place in the row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def line_texts(classes: list[str | None], lengths: np.ndarray, keys: list[bytes], first: str, second: str, share: float) -> list[str]:
    """A line for each row: of one pool, or mixed from runs of up to four characters."""
    held = Keys(keys)
    pure = np.array([0 if c == "pure_yi" else 1 if c == "pure_common" else 2 for c in classes], np.int8)
    lengths = np.where(pure == 2, np.maximum(lengths, 1), np.maximum(lengths, 0))
    rows, place = _counted(lengths)
    of_first, letters = pure[rows] == 0, np.full(len(rows), ord("c"), np.uint8)
    mixed = np.flatnonzero(pure == 2)
    if len(mixed):
        widths = np.ones(len(pure), np.int64)
        widths[mixed] = 1 + np.floor(held.uniform(mixed, _mark("width")) * 4).astype(np.int64)
        counts = np.where(pure == 2, (lengths - 1) // widths + 1, 0)
        run_rows, run = _counted(counts)
        drawn = held.uniform(run_rows, _mark("run:"), run) < share
        own = np.flatnonzero(pure[rows] == 2)
        of_first[own] = drawn[(np.cumsum(counts) - counts)[rows[own]] + place[own] // widths[rows[own]]]
        letters[own] = np.where(of_first[own], ord("a"), ord("b"))
    u = held.uniform(rows, np.stack([letters, np.full(len(rows), ord(":"), np.uint8)], axis=1), place + 1)
    points = np.array([ord(c) for c in first + second], "<u4")
    sizes = np.where(of_first, len(first), len(second))
    kept = np.flatnonzero(sizes)  # an empty pool gives no characters
    at = np.floor(u[kept] * sizes[kept]).astype(np.int64) + np.where(of_first[kept], 0, len(first))
    text = points[at].tobytes().decode("utf-32-le")
    ends = np.cumsum(np.bincount(rows[kept], minlength=len(pure))).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def sampled_line(script_class: Column, length: Column, first: str, second: str, share: float, key: Column) -> Column:
    """The rows' lines; key is the text that their hashed keys begin with."""

    @arrow_udf(T.StringType())
    def lines(classes: pa.Array, lengths: pa.Array, keys: pa.Array) -> pa.Array:
        out: list[str] = []
        counts = lengths.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(np.cumsum(counts) // CHARACTERS, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            own = [x.slice(a, b - a).to_pylist() for x in (classes, keys)]
            out += line_texts(own[0], counts[a:b], [k.encode() for k in own[1]], first, second, share)
        return pa.array(out, pa.string())

    return lines(script_class.cast("string"), F.greatest(length, F.lit(0)).cast("long"), key)
