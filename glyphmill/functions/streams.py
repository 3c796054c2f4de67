"""Chance as a seed tree: every path from a root seed names a stream, and a stream's numbers are a function of their counter.

The root seed and the path are mixed into a 128-bit key as numpy's SeedSequence(seed, spawn_key=path) does, and a key and a
counter into 256 bits as numpy's Philox does (Philox 4x64 of ten rounds, Salmon et al. 2011), so any row computes any draw of
any stream by itself, and numpy's generators give the same numbers. The words of a batch of rows are computed together, in
arrays of unsigned integers; columns hold a 64-bit word as its two 32-bit halves in longs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# The constants of the seed mixing and of the generator.
MIX_A, MULTIPLY_A, MIX_B, MULTIPLY_B = 0x43B0D7E5, 0x931E8875, 0x8B51F9DD, 0x58F38DED
MIX_LEFT, MIX_RIGHT = 0xCA01F9DD, 0x4973F715
PHILOX_M = (0xD2E7470EE14C6C93, 0xCA5A826395121157)
PHILOX_W = (0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B)

POOL, ROUNDS, WORD = 4, 10, 0xFFFFFFFF
_LOW, _HALF = np.uint64(WORD), np.uint64(32)


def _words(value: int) -> list[int]:
    out = [value & WORD]
    while value := value >> 32:
        out.append(value & WORD)
    return out


def _mixed(words: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The four 32-bit key words that arrays of entropy words, of a row each, are mixed into; products wrap at 32 bits."""
    constant = MIX_A

    def hashed(x: np.ndarray, factor: int) -> np.ndarray:
        nonlocal constant
        x = x ^ np.uint32(constant)
        constant = constant * factor & WORD
        x = x * np.uint32(constant)
        return x ^ x >> np.uint32(16)

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x = x * np.uint32(MIX_LEFT) - y * np.uint32(MIX_RIGHT)
        return x ^ x >> np.uint32(16)

    pool = [hashed(words[i] if i < len(words) else np.zeros_like(words[0]), MULTIPLY_A) for i in range(POOL)]
    for s in range(POOL):
        for d in range(POOL):
            if s != d:
                pool[d] = joined(pool[d], hashed(pool[s], MULTIPLY_A))
    for word in words[POOL:]:
        for d in range(POOL):
            pool[d] = joined(pool[d], hashed(word, MULTIPLY_A))
    constant = MIX_B
    return [hashed(x, MULTIPLY_B) for x in pool]


def _wide(x: np.ndarray, constant: int) -> tuple[np.ndarray, np.ndarray]:
    """The high and the low 64 bits of the product of 64-bit numbers and a constant, from products of 32-bit halves."""
    low, high, a, b = x & _LOW, x >> _HALF, np.uint64(constant & WORD), np.uint64(constant >> 32)
    middle = high * a + (low * a >> _HALF)
    other = low * b + (middle & _LOW)
    return high * b + (middle >> _HALF) + (other >> _HALF), x * np.uint64(constant)


def _block(key: Sequence[np.ndarray], counter: np.ndarray) -> list[np.ndarray]:
    """The four 64-bit words of a block for each row. key: the two 64-bit words; counter: the block's number, from 0."""
    c = [counter + np.uint64(1), *(np.zeros_like(counter) for _ in range(3))]
    k = list(key)
    for _ in range(ROUNDS):
        (h0, l0), (h1, l1) = (_wide(c[2 * i], m) for i, m in enumerate(PHILOX_M))
        c = [h1 ^ c[1] ^ k[0], l1, h0 ^ c[3] ^ k[1], l0]
        k = [x + np.uint64(w) for x, w in zip(k, PHILOX_W, strict=True)]
    return c


def _whole(words: Sequence[np.ndarray]) -> list[np.ndarray]:
    """64-bit words of 32-bit ones, the low half of each first."""
    return [words[i].astype(np.uint64) + (words[i + 1].astype(np.uint64) << _HALF) for i in range(0, len(words), 2)]


def _given(columns: Sequence[pa.Array]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of longs as arrays, and which rows have a null among them."""
    absent = reduce(np.logical_or, (c.is_null().to_numpy(zero_copy_only=False) for c in columns))
    return [c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], absent


def _lists(flat: pa.Array, absent: np.ndarray) -> pa.Array:
    """Lists of POOL elements, null for the rows that have a null."""
    made = pa.ListArray.from_arrays(np.arange(len(absent) + 1, dtype=np.int32) * POOL, flat)
    return pc.if_else(pa.array(~absent), made, pa.scalar(None, made.type))


def _entropy(seed: int, path: Sequence[Column | int]) -> tuple[list[int | None], list[Column]]:
    """The seed's and the path's words, None for those that columns give, and these columns."""
    given = _words(seed)
    if path:
        given += [0] * (POOL - len(given))
    return [*given, *(None if isinstance(p, Column) else p for p in path)], [p.cast("long") for p in path if isinstance(p, Column)]


def _filled(words: Sequence[int | None], steps: Sequence[np.ndarray], n: int) -> list[np.ndarray]:
    found = iter(steps)
    return [next(found).astype(np.uint32) if w is None else np.full(n, w, np.uint32) for w in words]


def stream_key(seed: int, *path: Column | int) -> Column:
    """The key of the stream at `path` below the root seed: four 32-bit words, the low half of each 64-bit one first.

    Path steps are integers from 0 up to 2^32 - 1. Streams of different paths are independent, however near their steps.
    """
    words, columns = _entropy(seed, path)
    if not columns:
        return F.array(*(F.lit(int(w[0])).cast("long") for w in _mixed(_filled(words, (), 1))))

    @arrow_udf(T.ArrayType(T.LongType()))
    def key(*steps: pa.Array) -> pa.Array:
        own, absent = _given(steps)
        made = _mixed(_filled(words, own, len(absent)))
        return _lists(pa.array(np.stack(made, 1).ravel().astype(np.int64)), absent)

    return key(*columns)


@arrow_udf(T.ArrayType(T.StructType().add("low", T.LongType()).add("high", T.LongType())))
def _blocks(k0: pa.Array, k1: pa.Array, k2: pa.Array, k3: pa.Array, counter: pa.Array) -> pa.Array:
    (*key, at), absent = _given((k0, k1, k2, k3, counter))
    flat = np.stack(_block(_whole(key), at.astype(np.uint64)), 1).ravel()
    halves = (pa.array(x.astype(np.int64)) for x in (flat & _LOW, flat >> _HALF))
    return _lists(pa.StructArray.from_arrays(list(halves), ["low", "high"]), absent)


def philox(key: Column, counter: Column) -> Column:
    """Block `counter` (from 0) of the stream of `key`: four 64-bit words as structs (low, high)."""
    return _blocks(*(F.get(key, F.lit(i)).cast("long") for i in range(POOL)), counter.cast("long"))


def uniforms(block: Column) -> Column:
    """The four numbers in [0, 1) of a block, from the upper 53 bits of each word."""
    return F.transform(block, lambda w: (w["high"] * (1 << 21) + F.shiftright(w["low"], 11)).cast("double") / float(1 << 53))


def stream_uniform(seed: int, n: Column | int, *path: Column | int) -> Column:
    """Draw n (from 0) of the stream at `path`: numpy's Generator(Philox(SeedSequence(seed, spawn_key=path))).random()."""
    words, columns = _entropy(seed, path)

    @arrow_udf(T.DoubleType())
    def draw(n: pa.Array, *steps: pa.Array) -> pa.Array:
        (at, *own), absent = _given((n, *steps))
        key = _whole(_mixed(_filled(words, own, len(at))))
        drawn = np.choose(at % POOL, _block(key, (at // POOL).astype(np.uint64)))
        return pa.array((drawn >> np.uint64(11)).astype(np.float64) / float(1 << 53), mask=absent)

    return draw((n if isinstance(n, Column) else F.lit(n)).cast("long"), *columns)
