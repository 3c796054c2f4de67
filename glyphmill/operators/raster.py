"""Rasters as columns: checks, filters, degradations, shape features and residual marks. Rows hold a width and a flat array
of grey values or of ink; each function works on one row's raster in Arrow batches, so a task holds one batch of images.

Fonts and drawing are outside the library: images come in as arrays or bytes (sources/images).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

# The extrema that a page with ink on paper must reach.
DARK, LIGHT = 220, 225


def _grid(flat: np.ndarray, width: int) -> np.ndarray:
    return np.asarray(flat, np.int16).reshape(-1, int(width))


def _window(grid: np.ndarray, reduce) -> np.ndarray:
    padded = np.pad(grid, 1, mode="edge")
    h, w = grid.shape
    return reduce(np.stack([padded[y : y + h, x : x + w] for y in range(3) for x in range(3)]), 0)


@pandas_udf(T.ArrayType(T.IntegerType()))
def spread_ink(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """The darkest of each 3 x 3 neighbourhood."""
    return pd.Series([_window(_grid(p, w), np.min).ravel().astype(np.int32) for p, w in zip(pixels, width, strict=True)])


@pandas_udf(T.ArrayType(T.IntegerType()))
def thin_ink(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """The lightest of each 3 x 3 neighbourhood."""
    return pd.Series([_window(_grid(p, w), np.max).ravel().astype(np.int32) for p, w in zip(pixels, width, strict=True)])


@arrow_udf(T.StringType())
def pixel_digest(pixels: pa.Array) -> pa.Array:
    """The SHA-256 of the values, from 0 to 255, as bytes."""
    return pa.array([None if p.values is None else hashlib.sha256(p.values.to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()).hexdigest() for p in pixels], pa.string())


def binarized(pixels: Column, threshold: Column | int) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.transform(pixels, lambda p: F.when(p < limit, 0).otherwise(255))


def blank_images(rows: DataFrame, key: str, pixels: str) -> DataFrame:
    """Rows without ink or without paper: the darkest pixel is too light or the lightest too dark."""
    low, high = F.array_min(pixels), F.array_max(pixels)
    return rows.select(key, low.alias("low"), high.alias("high")).filter((F.col("low") > DARK) | (F.col("high") < LIGHT))


@pandas_udf(T.StructType().add("changed", T.LongType()).add("outside", T.LongType()))
def _changed(a: pd.Series, b: pd.Series, width: pd.Series, boxes: pd.Series, reach: pd.Series) -> pd.DataFrame:
    out = []
    for left, right, w, own, far in zip(a, b, width, boxes, reach, strict=True):
        differs = _grid(left, w) != _grid(right, w)
        allowed = np.zeros_like(differs)
        for x0, y0, x1, y1 in (list(map(int, box)) for box in own):
            allowed[max(0, y0 - far) : y1 + far, max(0, x0 - far) : x1 + far] = True
        out.append((int(differs.sum()), int((differs & ~allowed).sum())))
    return pd.DataFrame(out, columns=["changed", "outside"])


def changed_pixels(rows: DataFrame, key: str, reach: int = 4) -> DataFrame:
    """(key, changed, outside) of two variants a and b of a page: pixels that differ, and those outside the target boxes
    (x0, y0, x1, y1), each widened by `reach`. A valid pair has changed > 0 and outside = 0."""
    found = _changed(F.col("a"), F.col("b"), F.col("width"), F.col("boxes"), F.lit(reach))
    return rows.select(key, found.alias("_f")).select(key, "_f.changed", "_f.outside")


# -- degradations: separable linear maps and rotation -----------------------------------------------------------------


@lru_cache(512)
def blur_matrix(size: int, sigma: float) -> np.ndarray:
    """Row i has the weights of a Gaussian of the given deviation around i, to three deviations; beyond an edge counts the
    edge's pixel."""
    if sigma <= 0:
        return np.eye(size)
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    at = np.clip(np.arange(size)[:, None] + np.arange(-reach, reach + 1), 0, size - 1)
    out = np.zeros((size, size))
    np.add.at(out, (np.repeat(np.arange(size), len(weights)), at.ravel()), np.tile(weights / weights.sum(), size))
    return out


@lru_cache(512)
def resize_matrix(size: int, target: int) -> np.ndarray:
    """Bilinear resampling of a line of `size` pixels to `target`: a triangle around each target pixel's centre, widened by
    the scale where the line shrinks."""
    scale = size / target
    support = max(1.0, scale)
    centres = (np.arange(target) + 0.5) * scale
    weights = np.maximum(0.0, 1.0 - np.abs(np.arange(size)[None, :] + 0.5 - centres[:, None]) / support)
    return weights / weights.sum(1, keepdims=True)


def _rows(change, *columns: pd.Series) -> pd.Series:
    """change(grid, the row's other values) for each raster of (pixels, width, ...)."""
    return pd.Series([np.asarray(change(np.asarray(p, np.float64).reshape(-1, int(w)), *more), np.float64).ravel() for p, w, *more in zip(*columns, strict=True)])


def _separable(grid: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    return down @ grid @ across.T


@pandas_udf(T.ArrayType(T.DoubleType()))
def blurred(pixels: pd.Series, width: pd.Series, sigma: pd.Series) -> pd.Series:
    return _rows(lambda g, s: _separable(g, blur_matrix(g.shape[0], float(s)), blur_matrix(g.shape[1], float(s))), pixels, width, sigma)


@pandas_udf(T.ArrayType(T.DoubleType()))
def resampled(pixels: pd.Series, width: pd.Series, scale: pd.Series, least: pd.Series) -> pd.Series:
    """Shrunk by the scale, to `least` pixels a side at the smallest, and brought back."""

    def there_and_back(size: int, s: float, low: int) -> np.ndarray:
        small = max(int(low), int(size * float(s)))
        return resize_matrix(small, size) @ resize_matrix(size, small)

    return _rows(lambda g, s, low: _separable(g, there_and_back(g.shape[0], s, low), there_and_back(g.shape[1], s, low)), pixels, width, scale, least)


def _rotated(grid: np.ndarray, degrees: float, fill: float) -> np.ndarray:
    height, width = grid.shape
    turn, cy, cx = np.deg2rad(float(degrees)), height / 2, width / 2
    y, x = np.indices(grid.shape) + 0.5
    from_x = np.cos(turn) * (x - cx) - np.sin(turn) * (y - cy) + cx
    from_y = np.sin(turn) * (x - cx) + np.cos(turn) * (y - cy) + cy
    inside = (from_x >= 0) & (from_x < width) & (from_y >= 0) & (from_y < height)
    left, top = np.floor(from_x - 0.5), np.floor(from_y - 0.5)
    dx, dy = from_x - 0.5 - left, from_y - 0.5 - top
    at = lambda yy, xx: grid[np.clip(yy, 0, height - 1).astype(int), np.clip(xx, 0, width - 1).astype(int)]
    mixed = (1 - dy) * ((1 - dx) * at(top, left) + dx * at(top, left + 1)) + dy * ((1 - dx) * at(top + 1, left) + dx * at(top + 1, left + 1))
    return np.where(inside, mixed, float(fill))


@pandas_udf(T.ArrayType(T.DoubleType()))
def rotated(pixels: pd.Series, width: pd.Series, degrees: pd.Series, fill: pd.Series) -> pd.Series:
    """Turned counter-clockwise about the centre, bilinear, with `fill` where the source lies outside."""
    return _rows(_rotated, pixels, width, degrees, fill)


def degraded(rows: DataFrame, pixels: str, width: str, sigma: Column, scale: Column, degrees: Column, fill: float, least: int = 8) -> DataFrame:
    """rows with columns blurred, resampled and rotated, arrays of doubles. A row's raster must be whole lines of its width;
    a raster is held by one task, a batch of them at a time."""
    p, w = F.col(pixels), F.col(width)
    return rows.select("*", blurred(p, w, sigma).alias("blurred"), resampled(p, w, scale, F.lit(least)).alias("resampled"), rotated(p, w, degrees, F.lit(fill)).alias("rotated"))


# -- prints: old print, faded ink, paper, orientation and side ------------------------------------------------------------

# An old print's scale, blur and contrast; the contrast below which ink can't be read; the change that counts.
PRINT_SCALE, PRINT_BLUR, PRINT_CONTRAST = 0.92, 0.55, 0.92
READABLE, SEEN = 40.0, 2.0


def _contrasted(pixels: Column, middle: Column, factor: Column) -> Column:
    return F.transform(pixels, lambda p: F.least(F.lit(255.0), F.greatest(F.lit(0.0), middle + (p - middle) * factor)))


def old_print(pixels: Column, width: Column, least: int = 8) -> Column:
    """A raster as a mild old print: shrunk a little and brought back, blurred, paler about the middle grey."""
    soft = blurred(resampled(pixels, width, F.lit(PRINT_SCALE), F.lit(least)), width, F.lit(PRINT_BLUR))
    return _contrasted(soft, F.lit(128.0), F.lit(PRINT_CONTRAST))


def _quantile(values: Column, share: float) -> Column:
    """The quantile of an array, linear between neighbours; null for an empty one."""
    ordered = F.sort_array(values)
    at = F.greatest(F.lit(0.0), (F.size(values) - 1) * F.lit(share))
    low = F.get(ordered, F.floor(at).cast("int"))
    return low + (F.get(ordered, F.ceil(at).cast("int")) - low) * (at - F.floor(at))


def faded_ink(rows: DataFrame, key: str, pixels: str, mask: str, width: str, sigma: Column, contrast: Column) -> DataFrame:
    """(key, variant, changed, readable, problem): the raster blurred and paler about its mean grey, what changed of the ink, and
    whether it can still be read.

    changed counts pixels of ink that moved by SEEN grey values or more; readable is the median of the paper less the first
    quartile of the ink. A variant that changes nothing, or whose ink stands out by less than READABLE, is a problem and stays
    among the rows; so does a mask without ink or without paper, whose readable is null.
    """
    soft = rows.select(key, F.col(pixels).alias("_p"), F.col(mask).alias("_m"), contrast.cast("double").alias("_c"), blurred(F.col(pixels), F.col(width), sigma).alias("_s"))
    mean = F.floor(F.aggregate("_s", F.lit(0.0), lambda total, p: total + p) / F.size("_s") + 0.5)
    made = soft.withColumn("_mean", mean.cast("double")).withColumn("variant", _contrasted(F.col("_s"), F.col("_mean"), F.col("_c")))
    cells = F.arrays_zip(F.col("_p").alias("p"), F.col("_m").alias("m"), F.col("variant").alias("v"))
    ink = F.filter(cells, lambda c: c["m"] > 0)
    paper = F.transform(F.filter(cells, lambda c: c["m"] <= 0), lambda c: c["v"])
    made = made.withColumn("changed", F.size(F.filter(ink, lambda c: F.abs(c["p"] - c["v"]) >= SEEN)).cast("long"))
    made = made.withColumn("readable", _quantile(paper, 0.5) - _quantile(F.transform(ink, lambda c: c["v"]), 0.25))
    problem = (
        F.when(F.size(ink) == 0, "no ink").when(F.size(paper) == 0, "no paper").when(F.col("changed") == 0, "nothing changed").when(F.col("readable") < READABLE, "not readable")
    )
    return made.withColumn("problem", problem).select(key, "variant", "changed", "readable", "problem")


@lru_cache(512)
def lanczos_matrix(size: int, target: int) -> np.ndarray:
    """Resampling of a line of `size` pixels to `target` by a sinc of three lobes, widened where the line shrinks."""
    scale = max(1.0, size / target)
    far = (np.arange(size)[None, :] + 0.5 - (np.arange(target)[:, None] + 0.5) * size / target) / scale
    weights = np.where(np.abs(far) < 3, np.sinc(far) * np.sinc(far / 3), 0.0)
    return weights / weights.sum(1, keepdims=True)


#: How a raster is turned upright, by the orientation that its camera noted; any other number leaves it.
_UPRIGHT = {2: lambda g: g[:, ::-1], 3: lambda g: g[::-1, ::-1], 4: lambda g: g[::-1], 5: lambda g: g.T, 6: lambda g: g[::-1].T, 7: lambda g: g[::-1, ::-1].T, 8: lambda g: g.T[::-1]}


@pandas_udf(T.StructType().add("pixels", T.ArrayType(T.DoubleType())).add("width", T.IntegerType()).add("height", T.IntegerType()))
def upright_within(pixels: pd.Series, width: pd.Series, orientation: pd.Series, most: pd.Series) -> pd.DataFrame:
    """A raster turned upright and shrunk until its longer side is at most `most` pixels (0 or less: as it is). It is never
    enlarged; a side keeps one pixel at least. A null orientation is upright."""
    out = []
    for p, w, turn, side in zip(pixels, width, orientation, most, strict=True):
        grid = np.asarray(p, np.float64).reshape(-1, int(w))
        grid = _UPRIGHT.get(0 if pd.isna(turn) else int(turn), lambda g: g)(grid)
        longer = max(grid.shape)
        if 0 < side < longer:
            small = [max(1, int(n * (side / longer))) for n in grid.shape]
            grid = np.clip(_separable(grid, lanczos_matrix(grid.shape[0], small[0]), lanczos_matrix(grid.shape[1], small[1])), 0, 255)
        out.append((grid.ravel(), grid.shape[1], grid.shape[0]))
    return pd.DataFrame(out, columns=["pixels", "width", "height"])


class Paper(NamedTuple):
    """A kind of paper: ranges of its base tone, of the drift from edge to edge down and across, and of the fibres' deviation;
    the darkest and lightest tone; what red, green and blue lose of it."""

    base: tuple[int, int]
    down: float
    across: float
    fibre: tuple[float, float]
    tones: tuple[int, int]
    tint: tuple[int, int, int]


# A worn page and a clean sheet.
PAGE = Paper((238, 252), 8.0, 6.0, (1.5, 4.0), (200, 255), (0, 0, 0))
SHEET = Paper((244, 250), 3.0, 2.0, (0.8, 0.8), (232, 255), (0, 1, 3))

#: Values of the sheets that are sent on together.
SHEETS = 1 << 20

_PAPER = "k long, width int, height int, channels int, pixels array<int>"
_PAPERS = pa.schema([("k", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.list_(pa.int32()))])


def paper_pixels(draw: np.random.Generator, width: int, height: int, paper: Paper) -> np.ndarray:
    """Height x width x 3 values: a base tone, a linear drift down and across, normal noise a pixel; cut off, then tinted."""
    base = float(draw.integers(paper.base[0], paper.base[1] + 1))
    top, bottom = draw.uniform(-paper.down, paper.down, 2)
    left, right = draw.uniform(-paper.across, paper.across, 2)
    grey = base + np.linspace(top, bottom, height)[:, None] + np.linspace(left, right, width)[None, :]
    grey = grey + draw.normal(0, draw.uniform(*paper.fibre), (height, width))
    whole = np.clip(grey, *paper.tones).astype(np.int32)
    return np.clip(whole[:, :, None] - np.array(paper.tint, np.int32), 0, 255)


def paper_backgrounds(rows: DataFrame, key: str, width: str, height: str, seed: int, paper: Paper = PAGE) -> DataFrame:
    """(key, width, height, channels, pixels) of a sheet for each row, as write_images takes them.

    Chance is the stream of (seed, key), so a sheet depends on its key and size alone, whatever task makes it; key is an integer
    from 0 to 2^32 - 1. A task holds sheets of SHEETS values in all, or one larger one.
    """

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        keys, widths, heights, sheets = zip(*held, strict=True)
        ends = np.cumsum([0, *(x.size for x in sheets)], dtype=np.int32)
        pixels = pa.ListArray.from_arrays(ends, np.concatenate(sheets).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(x, pa.int32()) for x in (widths, heights, [3] * len(held))), pixels], schema=_PAPERS)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for k, w, h in zip(*(batch.column(c).to_pylist() for c in ("k", "w", "h")), strict=True):
                if held and size + 3 * w * h > SHEETS:
                    yield batch_of(held)
                    held, size = [], 0
                draw = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed, spawn_key=(k,))))
                held.append((k, w, h, paper_pixels(draw, w, h, paper).ravel()))
                size += 3 * w * h
        if held:
            yield batch_of(held)

    given = rows.select(F.col(key).cast("long").alias("k"), F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h"))
    return given.mapInArrow(run, _PAPER).withColumnRenamed("k", key)

# -- masks: centring, views, features -----------------------------------------------------------------------------------


def _shifted(mask: np.ndarray, down: int, across: int) -> np.ndarray:
    height, width = mask.shape
    out = np.zeros_like(mask)
    y0, y1, x0, x1 = max(0, down), min(height, height + down), max(0, across), min(width, width + across)
    if y0 < y1 and x0 < x1:
        out[y0:y1, x0:x1] = mask[y0 - down : y1 - down, x0 - across : x1 - across]
    return out


def _moments(mask: np.ndarray) -> tuple[float, float | None, float | None, int, int]:
    """Ink, its centre (x, y), and the shift (x, y) that brings the centre to the middle pixel, halves to the even one."""
    total = float(mask.sum())
    if total <= 0:
        return total, None, None, 0, 0
    y, x = np.indices(mask.shape)
    cx, cy = float((mask * x).sum()) / total, float((mask * y).sum()) / total
    return total, cx, cy, round((mask.shape[1] - 1) / 2 - cx), round((mask.shape[0] - 1) / 2 - cy)


def _centred(mask: np.ndarray) -> np.ndarray:
    *_, across, down = _moments(mask)
    return _shifted(mask, down, across)


@pandas_udf(T.StructType().add("ink", T.DoubleType()).add("center_x", T.DoubleType()).add("center_y", T.DoubleType()).add("shift_x", T.IntegerType()).add("shift_y", T.IntegerType()))
def mask_moments(mask: pd.Series, width: pd.Series) -> pd.DataFrame:
    """The ink of a mask (0 to 1 a pixel), its centre of mass and the shift that centres it; an empty mask has no centre."""
    return pd.DataFrame([_moments(np.asarray(m, np.float64).reshape(-1, int(w))) for m, w in zip(mask, width, strict=True)], columns=["ink", "center_x", "center_y", "shift_x", "shift_y"])


@pandas_udf(T.ArrayType(T.DoubleType()))
def centred_mask(mask: pd.Series, width: pd.Series) -> pd.Series:
    """The mask moved so that its centre of mass stands in the middle; what leaves the frame is lost."""
    return _rows(_centred, mask, width)


def _views(mask: np.ndarray) -> list[np.ndarray]:
    """The mask, a soft one, a coarse one, a heavy and a light one, each centred; views without ink are left out."""
    height, width = mask.shape
    half = [resize_matrix(max(1, n // 2), n) @ resize_matrix(n, max(1, n // 2)) for n in (height, width)]
    seen = [mask, _separable(mask, blur_matrix(height, 0.65), blur_matrix(width, 0.65)), _separable(mask, *half), _window(mask, np.max), _window(mask, np.min)]
    return [_centred(v) for v in seen if v.max() > 0]


def _feature(mask: np.ndarray) -> np.ndarray:
    height, width = mask.shape
    coarse = _separable(mask, resize_matrix(height, max(1, height // 2)), resize_matrix(width, max(1, width // 2)))
    v = np.concatenate([mask.ravel(), 0.7 * coarse.ravel(), 0.8 * np.concatenate([mask.sum(0), mask.sum(1)]) / max(1, height)])
    return v / (np.linalg.norm(v) + 1e-8)


@pandas_udf(T.ArrayType(T.DoubleType()))
def shape_features(mask: pd.Series, width: pd.Series) -> pd.Series:
    """A unit vector of a mask's shape: the mean over its views of pixels, 0.7 times their half-size means and 0.8 times
    their row and column sums, each view's vector brought to length 1. A mask without ink has zeros."""

    def averaged(grid: np.ndarray) -> np.ndarray:
        made = [_feature(v) for v in _views(grid)] or [_feature(grid)]
        mean = np.mean(made, axis=0)
        return mean / (np.linalg.norm(mean) + 1e-8)

    return _rows(averaged, mask, width)


# -- residual marks in the empty space ----------------------------------------------------------------------------------

MARKS = "marks array<struct<x:int,y:int,rx:int,ry:int,shade:int>>, wanted int, pixels array<int>"


def _ellipse(x: int, y: int, rx: int, ry: int) -> tuple[np.ndarray, np.ndarray]:
    dy, dx = np.mgrid[-ry : ry + 1, -rx : rx + 1]
    inside = (dx / rx) ** 2 + (dy / ry) ** 2 <= 1.0
    return y + dy[inside], x + dx[inside]


def place_marks(mask: np.ndarray, draw: np.random.Generator, wanted: tuple[int, int], tries: int, edge: int, reach: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Up to the drawn number of ellipses near the ink that touch neither ink nor each other, in `tries` draws at most.

    A summed-area table of the ink tells at once whether an ellipse's box is free of it; only boxes that aren't are looked at
    pixel by pixel. Each try takes five numbers of the stream, whatever comes of it, so a mark depends on its try alone.
    """
    height, width = mask.shape
    count = int(draw.integers(wanted[0], wanted[1] + 1))
    table = np.zeros((height + 1, width + 1), np.int64)
    table[1:, 1:] = mask.cumsum(0).cumsum(1)
    ys, xs = np.nonzero(mask)
    box = (xs.min(), ys.min(), xs.max(), ys.max()) if len(xs) else (edge, edge, width - 1 - edge, height - 1 - edge)
    left, top = max(edge, box[0] - reach), max(edge, box[1] - reach)
    right, bottom = min(width - 1 - edge, box[2] + reach), min(height - 1 - edge, box[3] + reach)
    taken, marks = np.zeros_like(mask), []
    if right < left or bottom < top:
        return count, marks
    drawn = draw.integers([left, top, 1, 1, 30], [right + 1, bottom + 1, 6, 5, 116], size=(tries, 5))
    for x, y, rx, ry, shade in drawn.tolist():
        if len(marks) == count:
            break
        x0, y0, x1, y1 = x - rx, y - ry, x + rx, y + ry
        if x0 < 0 or y0 < 0 or x1 >= width or y1 >= height:
            continue
        own = _ellipse(x, y, rx, ry)
        ink = table[y1 + 1, x1 + 1] - table[y0, x1 + 1] - table[y1 + 1, x0] + table[y0, x0]
        if ink and mask[own].any() or taken[own].any():
            continue
        taken[own] = True
        marks.append((x, y, rx, ry, shade))
    return count, marks


def residual_marks(rows: DataFrame, key: str, pixels: str, mask: str, width: str, seed: int, wanted: tuple[int, int] = (10, 18), tries: int = 2400, edge: int = 8, reach: int = 18) -> DataFrame:
    """(key, marks, wanted, pixels): the raster with grey ellipses in its empty space, near the ink.

    Chance is the stream of (seed, key) as in functions/streams, so reruns agree; key is an integer from 0 to 2^32 - 1. A row
    with fewer marks than wanted found no room in `tries` draws; it is kept, and the caller judges it.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                w = row["w"]
                grid, ink = np.array(row["p"], np.int32).reshape(-1, w), np.asarray(row["m"]).reshape(-1, w) > 0
                draw = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed, spawn_key=(row["k"],))))
                count, marks = place_marks(ink, draw, wanted, tries, edge, reach)
                for x, y, rx, ry, shade in marks:
                    grid[_ellipse(x, y, rx, ry)] = shade
                yield pa.RecordBatch.from_pylist([{"k": row["k"], "marks": [dict(zip(("x", "y", "rx", "ry", "shade"), m, strict=True)) for m in marks], "wanted": count, "pixels": grid.ravel()}], schema=_MARKED)

    given = rows.select(F.col(key).cast("long").alias("k"), F.col(pixels).alias("p"), F.col(mask).alias("m"), F.col(width).cast("int").alias("w"))
    return given.mapInArrow(run, f"k long, {MARKS}").withColumnRenamed("k", key)


_MARKED = pa.schema([("k", pa.int64()), ("marks", pa.list_(pa.struct([(c, pa.int32()) for c in ("x", "y", "rx", "ry", "shade")]))), ("wanted", pa.int32()), ("pixels", pa.list_(pa.int32()))])
