"""Line numbers, image files, the asset store, fonts, sizes, rasters, seed streams and unique attempts against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glyphmill.functions import streams
from glyphmill.operators import fonts, planning, raster
from glyphmill.plans import rendering
from glyphmill.sources import files, images


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


# -- line numbers -------------------------------------------------------------------------------------------------------


def _lines(seed, n):
    draw = random.Random(seed)
    return ["x" * draw.choice([0, 1, 5, 300]) + f"é{i}" * draw.randrange(3) for i in range(n)]


def test_line_numbers_over_splits(spark, tmp_path, small_splits):
    kept = {}
    for name, end in (("a.txt", "\n"), ("b.txt", "\r\n"), ("c.txt", "\n"), ("empty.txt", "\n")):
        kept[name] = [] if name == "empty.txt" else _lines(name, 200)
        (tmp_path / name).write_bytes("".join(line + end for line in kept[name]).encode())
    (tmp_path / "d.txt").write_text("no end")
    kept["d.txt"] = ["no end"]
    rows = files.read_numbered_lines(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 3
    found = {}
    for r in rows.collect():
        found.setdefault(os.path.basename(r["path"]), {})[r["line"]] = r["value"]
    for name, lines in kept.items():
        assert [v for _, v in sorted(found.get(name, {}).items())] == lines and sorted(found.get(name, {})) == list(range(1, len(lines) + 1))


def test_strict_lines_name_the_line(spark, tmp_path, small_splits):
    lines = ['{"a": 1}', "", "  \t", " ", *['{"a": 2}'] * 60, "[1]", "3", '"{}"', "{", "null", '{"a": 3}', '{"a": 1} {"a": 2}', '{"a": 1}],[2', '"a": 1', '{"a": 1},"b": 2', "{'a': 1}", '{"a": 1}}', '{"a": [1, {"b": null}], "a": 2}', " {} "]
    (tmp_path / "bad.jsonl").write_text("\n".join(lines))
    problems = {(r["line"], r["problem"]) for r in files.json_line_problems(spark, str(tmp_path)).collect()}
    assert problems == {(65, "not a JSON object"), (66, "not a JSON object"), (67, "not a JSON object"), (68, "not valid JSON"), (69, "not a JSON object"), *((n, "not valid JSON") for n in range(71, 77))}
    with pytest.raises(PySparkException, match=r"bad\.jsonl:[67][0-9]: "):
        files.read_json_lines_strict(spark, str(tmp_path), "a int").collect()
    (tmp_path / "bad.jsonl").write_text("\n".join(lines[:64]))
    assert {tuple(r) for r in files.read_json_lines_strict(spark, str(tmp_path), "a int").groupBy("a").count().collect()} == {(1, 1), (2, 60)}


# -- images ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (40, 7), (4, 6, 3)])
def test_png_round_trip(shape):
    pixels = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    data = images.encode_png(pixels)
    assert np.array_equal(images.decode_png(data), pixels) and images.encode_png(pixels.copy()) == data
    with pytest.raises(ValueError, match="damaged"):
        images.decode_png(data[:45] + bytes([data[45] ^ 1]) + data[46:])


def test_png_predictors():
    """Rows as other encoders filter them: left, above, mean and Paeth, worked out here by the format's definition."""
    import struct
    import zlib

    pixels = np.random.default_rng(2).integers(0, 256, (5, 9, 3)).astype(np.uint8)
    flat = pixels.reshape(5, -1).astype(int)
    rows = []
    for y in range(5):
        line = []
        for i in range(27):
            a, b, c = flat[y, i - 3] if i > 2 else 0, flat[y - 1, i] if y else 0, flat[y - 1, i - 3] if y and i > 2 else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((flat[y, i] - [0, a, b, (a + b) // 2, near][y]) % 256)
        rows.append(bytes([y, *line]))
    header = struct.pack(">IIBBBBB", 9, 5, 8, 2, 0, 0, 0)
    chunk = images._chunk
    assert np.array_equal(images.decode_png(images.PNG_START + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")), pixels)


def test_images_are_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(2500).select(F.col("id").cast("string").alias("name"), F.lit(2).alias("width"), F.lit(None).cast("int").alias("channels"), F.array((F.col("id") % 256).cast("int"), F.lit(1), F.lit(2), F.lit(3)).alias("pixels")).repartition(3)
    images.write_images(rows, path)
    manifest = {r["name"]: r for r in images.read_image_manifest(spark, path).collect()}
    assert len(manifest) == 2500 and {(r["width"], r["height"]) for r in manifest.values()} == {(2, 2)}
    found = images.decoded(images.read_image_files(spark, path)).collect()
    shown = {r["file"]: r["pixels"] for r in found}
    assert all(shown[r["file"]] == [int(n) % 256, 1, 2, 3] for n, r in manifest.items())
    with open(f"{path}/{manifest['7']['file']}", "rb") as f:
        assert hashlib.sha256(f.read()).hexdigest() == manifest["7"]["digest"]
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="not a raster"):
        images.write_images(rows.withColumn("pixels", F.when(F.col("name") == "77", F.array(F.lit(999), F.lit(1))).otherwise(F.col("pixels"))), path)
    assert sorted(os.listdir(path)) == before


def test_tasks_that_outlive_an_abort_leave_nothing(tmp_path, monkeypatch):
    path, other = str(tmp_path / "out"), images.PngSink({"path": str(tmp_path / "out")}).writer(None, False)
    batch = pa.RecordBatch.from_pylist([{"name": "a", "width": 1, "channels": 1, "pixels": [7]}])
    writer = images.PngSink({"path": path}).writer(None, False)

    def batches():
        yield batch
        writer.abort([])
        yield batch

    monkeypatch.setattr(images, "FOLDER", 1)
    for rows in (batches(), iter([batch])):  # one that is writing, and one that has yet to begin
        with pytest.raises(OSError):
            writer.write(rows)
    other.commit([other.write(iter([batch]))])  # another run's images are left alone
    assert len(os.listdir(path)) == 1 and not os.listdir(path)[0].startswith("_")


def test_equal_contents_are_one_object(spark, tmp_path):
    root = str(tmp_path / "store")
    assets = spark.range(300).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") == 5, None).otherwise((F.col("id") % 7).cast("string").cast("binary")).alias("content")).repartition(6)
    for _ in range(2):  # a second run finds all its objects there
        manifest = images.store_assets(assets, root).collect()
        assert len(manifest) == 300 and len({r["digest"] for r in manifest}) == 8
    held = [f for _, _, names in os.walk(root) for f in names if not f.startswith(".")]
    assert sorted(held) == sorted({r["digest"] for r in manifest})
    assert {(r["digest"], bytes(r["content"])) for r in images.read_objects(spark, root).collect()} == {(hashlib.sha256(x).hexdigest(), x) for x in [b"", *(str(i).encode() for i in range(7))]}


def test_objects_are_listed_by_tasks(spark, tmp_path):
    root = str(tmp_path / "store")
    images.store_assets(spark.range(900).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") > 0, F.col("id").cast("string").cast("binary")).alias("content")), root)
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("objects", "")
    held = images.read_objects(spark, root)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert not tracker.getJobIdsForGroup("objects")  # a scan of files lists them before it is a table
    assert held.rdd.getNumPartitions() <= 256
    assert {(r["digest"], bytes(r["content"])) for r in held.collect()} == {(hashlib.sha256(x).hexdigest(), x) for x in [b"", *(str(i).encode() for i in range(1, 900))]}
    assert images.read_objects(spark, str(tmp_path / "none")).count() == 0


def test_links_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["images/x"]), ("b", ["images/y"])], "id string, images array<string>")
    content = spark.createDataFrame([("images/x", b"1"), ("images/y", b"2")], "path string, content binary")
    linked = images.link_assets(rows, "id", "images", content, str(tmp_path / "s"))
    assert {(r["key"], r["length"]) for r in linked.collect()} == {("a", 1), ("b", 1)}
    with pytest.raises(ValueError, match="repeated bytes"):
        images.link_assets(rows, "id", "images", content.withColumn("content", F.lit(b"1")), str(tmp_path / "s"))


# -- fonts ----------------------------------------------------------------------------------------------------------------


def test_coverage_equals_a_nested_loop(spark):
    draw = random.Random(3)
    segments = [(draw.choice(["cjk", "yi"]), draw.randrange(4), a := draw.randrange(0, 70000), a + draw.choice([-1, 0, 3, 700, 30000])) for _ in range(60)]
    points = [draw.randrange(1, 0x110000) for _ in range(200)] + [draw.randrange(1, 70000) for _ in range(300)]
    df = spark.createDataFrame([(p,) for p in sorted(set(points))], "codepoint int")
    found = {(r["codepoint"], r["kind"]): r["fonts"] for r in fonts.covering_fonts(df, spark.createDataFrame(segments, "kind string, font int, first int, last int")).collect()}
    expected = {}
    for p in set(points):
        for kind in ("cjk", "yi"):
            if own := sorted({f for k, f, a, b in segments if k == kind and a <= p <= b}):
                expected[p, kind] = own
    assert found == expected


def test_fonts_are_chosen_by_kind(spark):
    segments = spark.createDataFrame([("cjk", 0, 0, 0x9FFF), ("cjk", 1, 0xA000, 0xA000), ("yi", 2, 0xA001, 0xA4CF), ("circled", 3, 0x2460, 0x2461)], "kind string, font int, first int, last int")
    rows = [(1, 0, "a", None), (1, 1, "ꀀ", None), (1, 2, "ꀁ", None), (1, 3, "①", None), (1, 4, "⑳", None), (1, 5, "￿", None), (1, 6, "ꀁ", 2), (1, 7, "ꀁ", 1), (1, 8, "①", 3)]
    chars = spark.createDataFrame(rows, "key long, position int, char string, forced int")
    found = {r["position"]: (r["kind"], r["font"], r["problem"]) for r in fonts.chosen_fonts(chars, segments, 1).collect()}
    assert found == {0: ("cjk", 0, None), 1: ("cjk", 1, None), 2: ("yi", 2, None), 3: ("circled", 3, None), 4: ("circled", None, "uncovered"), 5: ("cjk", None, "uncovered"), 6: ("yi", 2, None), 7: ("yi", None, "forced font lacks it"), 8: ("circled", 3, None)}


def test_sizes_equal_a_linear_search(spark):
    draw = random.Random(4)
    widths, other = {300: "il. ", 501: "ab", 1000: "中"}, 777
    rows = [("".join(draw.choice("il. abcd中Z") for _ in range(draw.randrange(60))), draw.randrange(0, 900), draw.choice([9, 10, 11, 24, 60])) for _ in range(200)] + [("", 0, 30), (None, 5, 20)]
    df = spark.createDataFrame(rows, "text string, width int, size int")
    found = [r["s"] for r in df.select(fonts.fitting_size(F.col("text"), F.col("width"), F.col("size"), widths, other).alias("s")).collect()]
    unit = {c: u for u, cs in widths.items() for c in cs}
    expected = []
    for text, width, size in rows:
        fits = [s for s in range(size, 9, -1) if sum(100 * ((unit.get(c, other) * s + 500) // 1000) + 6 * s for c in text or "") <= 100 * width]
        expected.append(fits[0] if fits else None)
    assert found == expected


# -- rasters ----------------------------------------------------------------------------------------------------------------


def test_linear_maps_keep_flat_images_and_ink(spark):
    df = spark.createDataFrame([(1, [100] * 35, 7), (2, [0] * 31 + [255] + [0] * 31, 7)], "id int, pixels array<int>, width int")
    flat, dot = raster.degraded(df, "pixels", "width", F.lit(0.8), F.lit(0.5), F.lit(30.0), 100.0, 2).orderBy("id").collect()
    for c in ("blurred", "resampled", "rotated"):
        assert np.allclose(flat[c], 100)
    blurred = np.array(dot["blurred"]).reshape(9, 7)
    assert np.isclose(blurred.sum(), 255) and blurred.argmax() == 31 and np.allclose(blurred, blurred[::-1]) and np.allclose(blurred, blurred[:, ::-1])
    x = np.arange(-3, 4)
    kernel = np.exp(-0.5 * (x / 0.8) ** 2) / np.exp(-0.5 * (x / 0.8) ** 2).sum()
    assert np.allclose(blurred[4], 255 * kernel[3] * kernel)
    quarter = raster._rotated(np.arange(16.0).reshape(4, 4), 90, 0)
    assert np.allclose(quarter, np.rot90(np.arange(16.0).reshape(4, 4)))


def _bare_paper(seed, key, width, height, paper):
    """The sheet value by value, from the same stream."""
    draw = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed, spawn_key=(key,))))
    base = int(draw.integers(paper.base[0], paper.base[1] + 1))
    ends = [*(draw.uniform(-paper.down, paper.down) for _ in range(2)), *(draw.uniform(-paper.across, paper.across) for _ in range(2))]
    spread = draw.uniform(*paper.fibre)
    out = []
    for y in range(height):
        for x in range(width):
            down = ends[0] + (ends[1] - ends[0]) * (y / (height - 1) if height > 1 else 0)
            across = ends[2] + (ends[3] - ends[2]) * (x / (width - 1) if width > 1 else 0)
            tone = int(min(paper.tones[1], max(paper.tones[0], base + down + across + draw.normal(0, spread))))
            out += [max(0, tone - loss) for loss in paper.tint]
    return out


@pytest.mark.parametrize("paper", [raster.PAGE, raster.SHEET])
def test_paper_depends_on_its_key_and_size_alone(spark, paper):
    rows = [(k, 1 + k * 7 % 40, 1 + k * 5 % 30) for k in range(30)]
    df = spark.createDataFrame(rows, "k long, w int, h int")
    found = [{r["k"]: r for r in raster.paper_backgrounds(df.repartition(n), "k", "w", "h", 3, paper).collect()} for n in (1, 7)]
    assert found[0] == found[1]
    for k, w, h in rows:
        made = found[0][k]
        assert (made["width"], made["height"], made["channels"]) == (w, h, 3)
        apart = np.abs(np.array(made["pixels"]) - _bare_paper(3, k, w, h, paper))
        assert apart.max() <= 1 and (apart > 0).mean() < 0.01  # sums in another order may cross a whole number
    means = [np.mean(r["pixels"]) for r in found[0].values()]
    assert max(means) - min(means) > 2
    assert raster.paper_backgrounds(df.filter("k < 0"), "k", "w", "h", 3).count() == 0


def test_upright_turns_and_sides(spark):
    """An image that a camera noted as turned comes out as the upright one; sides shrink alike and never grow."""
    upright = np.arange(15).reshape(3, 5) * 17
    noted = {1: upright, 2: np.fliplr(upright), 3: np.rot90(upright, 2), 4: np.flipud(upright), 5: upright.T, 6: np.rot90(upright, 1), 7: np.rot90(upright.T, 2), 8: np.rot90(upright, -1), 9: upright}
    rows = [(turn, grid.ravel().tolist(), grid.shape[1]) for turn, grid in noted.items()]
    df = spark.createDataFrame([*rows, (None, upright.ravel().tolist(), 5)], "turn int, p array<int>, w int")
    for most, shape in ((0, (5, 3)), (-1, (5, 3)), (5, (5, 3)), (99, (5, 3)), (4, (4, 2)), (1, (1, 1))):
        found = [r["u"] for r in df.select(raster.upright_within("p", "w", "turn", F.lit(most)).alias("u")).collect()]
        assert {(r["width"], r["height"]) for r in found} == {shape}
        assert all(np.allclose(r["pixels"], found[0]["pixels"]) for r in found)
        if shape == (5, 3):
            assert found[0]["pixels"] == upright.ravel().tolist()
        flat = spark.createDataFrame([([9.0] * 15, 5)], "p array<double>, w int").select(raster.upright_within("p", "w", F.lit(1), F.lit(most)).alias("u")).first()["u"]
        assert np.allclose(flat["pixels"], 9.0)


def test_faded_ink_is_told_readable_or_not(spark):
    page = np.full((12, 12), 240)
    page[3:9, 3:9] = 20
    faint = np.where(page < 100, 210, 240)
    rows = [("dark", page), ("faint", faint), ("bare", np.full((12, 12), 240)), ("full", np.full((12, 12), 20)), ("flat", np.full((12, 12), 128))]
    df = spark.createDataFrame([(k, g.ravel().tolist(), (g < 220).astype(int).ravel().tolist() if k != "flat" else [1] + [0] * 143, 12) for k, g in rows], "k string, p array<int>, m array<int>, w int")
    found = {r["k"]: r for r in raster.faded_ink(df, "k", "p", "m", "w", F.lit(0.8), F.lit(0.75)).collect()}
    assert {k: r["problem"] for k, r in found.items()} == {"dark": None, "faint": "not readable", "bare": "no ink", "full": "no paper", "flat": "nothing changed"}
    v, ink = np.array(found["dark"]["variant"]), page.ravel() < 220
    assert found["dark"]["changed"] == (np.abs(v - page.ravel()) >= 2)[ink].sum()
    assert found["dark"]["readable"] == pytest.approx(np.median(v[~ink]) - np.percentile(v[ink], 25))
    assert found["bare"]["readable"] is None and found["full"]["readable"] is None


def test_features_follow_the_shape_not_its_place(spark):
    bar = np.zeros((12, 12))
    bar[3:7, 5:7] = 1  # its centre is between pixels, as the frame's is, so no shift is a tie
    moved = np.roll(bar, (2, -2), (0, 1))  # even steps, so that the half-size view moves along
    cross = bar.copy()
    cross[5, 2:9] = 1
    rows = [(i, m.ravel().tolist(), 12) for i, m in enumerate((bar, moved, cross, np.zeros((12, 12))))]
    df = spark.createDataFrame(rows, "id int, mask array<double>, width int")
    v = [np.array(r["v"]) for r in df.select("id", raster.shape_features("mask", "width").alias("v")).orderBy("id").collect()]
    assert np.allclose(v[0], v[1]) and v[0] @ v[2] < 0.98 and not v[3].any() and np.isclose(np.linalg.norm(v[2]), 1)
    m = df.select("id", raster.mask_moments("mask", "width").alias("m")).orderBy("id").select("m.*").collect()
    assert tuple(m[1]) == (8.0, 3.5, 6.5, 2, -1) and tuple(m[3]) == (0.0, None, None, 0, 0)


def _plain_feature(mask):
    """The averaged views of a square mask, worked out pixel by pixel."""
    n = len(mask)

    def window(m, pick):
        return np.array([[pick([m[min(n - 1, max(0, y + a)), min(n - 1, max(0, x + b))] for a in (-1, 0, 1) for b in (-1, 0, 1)]) for x in range(n)] for y in range(n)])

    def soft(m):
        w = {d: np.exp(-0.5 * (d / 0.65) ** 2) for d in range(-2, 3)}
        total = sum(w.values()) ** 2
        return np.array([[sum(w[a] * w[b] * m[min(n - 1, max(0, y + a)), min(n - 1, max(0, x + b))] for a in w for b in w) / total for x in range(n)] for y in range(n)])

    def line(v, target):
        scale = len(v) / target
        out = []
        for t in range(target):
            w = [max(0.0, 1 - abs(i + 0.5 - (t + 0.5) * scale) / max(1.0, scale)) for i in range(len(v))]
            out.append(sum(a * b for a, b in zip(w, v, strict=True)) / sum(w))
        return out

    def resized(m, target):
        across = np.array([line(row, target) for row in m])
        return np.array([line(column, target) for column in across.T]).T

    def centred(m):
        total = m.sum()
        cx, cy = sum(m[y, x] * x for y in range(n) for x in range(n)) / total, sum(m[y, x] * y for y in range(n) for x in range(n)) / total
        dx, dy = round((n - 1) / 2 - cx), round((n - 1) / 2 - cy)
        return np.array([[m[y - dy, x - dx] if 0 <= y - dy < n and 0 <= x - dx < n else 0.0 for x in range(n)] for y in range(n)])

    views = [centred(v) for v in (mask, soft(mask), resized(resized(mask, n // 2), n), window(mask, max), window(mask, min)) if v.max() > 0]
    made = [np.concatenate([v.ravel(), 0.7 * resized(v, n // 2).ravel(), 0.8 * np.concatenate([v.sum(0), v.sum(1)]) / n]) for v in views]
    mean = np.mean([v / (np.linalg.norm(v) + 1e-8) for v in made], axis=0)
    return mean / (np.linalg.norm(mean) + 1e-8)


def test_glyph_neighbours_equal_brute_force(spark, sf):
    rows = rendering._masks(spark, sf).orderBy("vec_id").collect()
    features = {r["vec_id"]: _plain_feature(np.array(r["mask"]).reshape(8, 8)) for r in rows if max(r["mask"]) > 0}
    found = {}
    for r in rendering.glyph_neighbours(spark, sf).collect():
        found.setdefault(r["i"], {})[r["rank"]] = r["sim"]
    for i in list(features)[:60]:
        best = sorted((float(features[i] @ f) / (np.linalg.norm(features[i]) * np.linalg.norm(f)) for j, f in features.items() if j != i and j % 4 == i % 4), reverse=True)[:3]
        assert [found[i][n] for n in (1, 2, 3)] == pytest.approx(best, abs=1e-5)


def test_marks_touch_neither_ink_nor_each_other(spark):
    draw = np.random.default_rng(6)
    rows = []
    for i in range(12):
        mask = np.zeros((60, 80), int)
        for _ in range(6):
            y, x = draw.integers(12, 48), draw.integers(12, 60)
            mask[y : y + 4, x : x + 8] = 1
        rows.append((i, np.where(mask, 10, 250).ravel().tolist(), mask.ravel().tolist(), 80))
    rows.append((12, [10] * 400, [1] * 400, 20))  # no room at all
    df = spark.createDataFrame(rows, "id long, pixels array<int>, mask array<int>, width int")
    made = raster.residual_marks(df, "id", "pixels", "mask", "width", 9).orderBy("id").collect()
    assert made == raster.residual_marks(df.repartition(5), "id", "pixels", "mask", "width", 9).orderBy("id").collect()
    for r, (_, pixels, mask, w) in zip(made, rows, strict=True):
        h = len(mask) // w
        taken = np.zeros((h, w), int)
        for m in r["marks"]:
            for y in range(h):
                for x in range(w):
                    taken[y, x] += ((x - m["x"]) / m["rx"]) ** 2 + ((y - m["y"]) / m["ry"]) ** 2 <= 1
        assert taken.max(initial=0) <= 1 and not (taken & np.array(mask).reshape(h, w)).any()
        changed = np.array(r["pixels"]).reshape(h, w) != np.array(pixels).reshape(h, w)
        assert np.array_equal(changed, taken > 0)
        assert 10 <= r["wanted"] <= 18 and len(r["marks"]) == (0 if w == 20 else r["wanted"])


# -- seed streams and attempts ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("seed", "path"), [(0, ()), (20260, (1,)), (2**100 + 12345, (7, 2**32 - 1, 0)), (5, (0, 0)), (2**140, ())])
def test_streams_equal_numpys(spark, seed, path):
    made = spark.range(9).select(streams.stream_key(seed, *path).alias("k"), streams.stream_uniform(seed, F.col("id"), *path).alias("u"))
    rows = made.collect()
    sequence = np.random.SeedSequence(seed, spawn_key=path)
    assert rows[0]["k"] == sequence.generate_state(4).tolist()
    assert [r["u"] for r in rows] == np.random.Generator(np.random.Philox(sequence)).random(9).tolist()


def test_paper_of_few_input_splits(spark, tmp_path):
    """Sheets are made by as many tasks as there are cores, though their rows fill one split of a small file."""
    spark.range(40).select((F.col("id") * 3).alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = rendering.paper_sheets(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for r in made.collect():
        k = r["p_partkey"]
        want = raster.paper_pixels(np.random.Generator(np.random.Philox(np.random.SeedSequence(rendering.SEED, spawn_key=(k,)))), 16 + k % 5, 12 + k % 3, raster.PAGE)
        assert (r["low"], r["high"], r["pixels_sha256"]) == (want.min(), want.max(), hashlib.sha256(want.astype(np.uint8).tobytes()).hexdigest())


def test_streams_of_many_keys(spark):
    """A batch of keys is drawn at once: expressions of a row took minutes for as many. A null key has no stream."""
    keys = spark.range(60_000).select(F.when(F.col("id") != 7, F.col("id") * 71_000).alias("k"))
    began = time.monotonic()
    rows = keys.select("k", streams.stream_uniform(20260, 5, F.col("k"), 3).alias("u"), streams.stream_key(20260, F.col("k")).alias("key")).collect()
    assert time.monotonic() - began < 30
    assert len(rows) == 60_000 and [(r["u"], r["key"]) for r in rows if r["k"] is None] == [(None, None)]
    for r in [r for r in rows if r["k"] is not None][::3001]:
        assert r["u"] == np.random.Generator(np.random.Philox(np.random.SeedSequence(20260, spawn_key=(r["k"], 3)))).random(6)[5]
        assert r["key"] == np.random.SeedSequence(20260, spawn_key=(r["k"],)).generate_state(4).tolist()


def _in_turn(rows):
    taken, out = set(), {}
    for k in sorted({k for k, _, _ in rows}):
        out[k] = next(((a, d) for a, d in sorted((a, d) for x, a, d in rows if x == k and d is not None) if d not in taken), (None, None))
        taken.add(out[k][1])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_attempts_in_turn(spark, seed):
    draw = random.Random(seed)
    rows = [(k, a, draw.randrange(40)) for k in range(60) for a in range(draw.randrange(1, 6))] + [(100, 0, None), (101, 0, 5), (101, 1, None)]
    found = planning.unique_attempts(spark.createDataFrame(rows, "k long, a int, d long"), "k", "a", "d").collect()
    assert {r["k"]: (r["a"], r["d"]) for r in found} == _in_turn(rows)


def test_a_lost_attempt_blocks_nothing(spark):
    """A row's second attempt blocks nobody while it has its first; a chain of rows moves on one by one."""
    rows = [(1, 0, "A"), (1, 1, "B"), (2, 0, "B")]
    found = planning.unique_attempts(spark.createDataFrame(rows, "k long, a int, d string"), "k", "a", "d").collect()
    assert {(r["k"], r["d"]) for r in found} == {(1, "A"), (2, "B")}
    chain = [(k, a, k + a) for k in range(8) for a in range(2)] + [(-1, 0, 0)]
    found = planning.unique_attempts(spark.createDataFrame(chain, "k long, a int, d long"), "k", "a", "d").collect()
    assert {r["k"]: (r["a"], r["d"]) for r in found} == _in_turn(chain)
