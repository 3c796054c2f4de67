"""Rasters against hand-made images."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import raster

PAPER = [255] * 9
DOT = [255, 255, 255, 255, 0, 255, 255, 255, 255]


def test_ink_filters(spark):
    rows = spark.createDataFrame([(3, DOT)], "width int, pixels array<int>")
    made = rows.select(raster.spread_ink("pixels", "width").alias("s"), raster.thin_ink("pixels", "width").alias("t"), raster.binarized(F.col("pixels"), 128).alias("b")).first()
    assert made["s"] == [0] * 9 and made["t"] == PAPER and made["b"] == DOT


def test_blank_images(spark):
    rows = spark.createDataFrame([(1, DOT), (2, PAPER), (3, [0] * 9)], "id int, pixels array<int>")
    assert sorted(r["id"] for r in raster.blank_images(rows, "id", "pixels").collect()) == [2, 3]


def test_changed_pixels(spark):
    page = [255] * 100
    near, far = list(page), list(page)
    near[55] = 0
    far[55] = far[99] = 0
    rows = spark.createDataFrame([(1, page, near, 10, [[5, 5, 6, 6]]), (2, page, far, 10, [[5, 5, 6, 6]]), (3, page, page, 10, [])], "id int, a array<int>, b array<int>, width int, boxes array<array<int>>")
    assert {tuple(r) for r in raster.changed_pixels(rows, "id", 2).collect()} == {(1, 1, 0), (2, 2, 1), (3, 0, 0)}


def test_features_are_normalised(spark):
    rows = spark.createDataFrame([(4, [0.0, 1.0] * 8)], "width int, mask array<double>")
    v = rows.select(raster.shape_features("mask", "width").alias("v")).first()["v"]
    assert len(v) == 16 + 4 + 8 and abs(sum(x * x for x in v) - 1) < 1e-6
