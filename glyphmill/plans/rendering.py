"""Queries of the image side: line-numbered reads, image files, the asset store, fonts, sizes, rasters and seed streams.

Rasters are the `embeddings`, eight pixels a line; segments of fonts and keys of streams come from `part`, texts from
`documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import streams
from glyphmill.operators import fonts, raster, similarity
from glyphmill.plans.evaluation import rounded, spread, table
from glyphmill.session import scratch_path
from glyphmill.sources import files, images

Query = Callable[[SparkSession, str], DataFrame]

SEED, SIDE = 20260, 8
#: Added before rounding down, so that no fraction of small whole numbers is a tie.
OFF_TIES = 0.3712
#: Thousandths of the size to the characters of that width; all others take 600.
WIDTHS, OTHER_WIDTH = {280: " .,;:!?'ijl", 850: "mwMWABCDEFGHIJKLNOPQRSTUVXYZ"}, 600


# -- line numbers -----------------------------------------------------------------------------------------------------


def json_line_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, a hundred to a file in the order of doc_id, some of them spoilt; a strict reader's complaints
    by file and line."""
    path = scratch_path(spark, "lines")
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).cast("long").alias("part"), "doc_id", F.to_json(F.struct("doc_id", "text", "lang")).alias("good"))
    i = F.col("doc_id") % 11
    spoilt = F.when(i == 3, F.lit("")).when(i == 5, F.concat(F.lit("["), "good", F.lit("]"))).when(i == 7, F.substring("good", 2, 40)).when(i == 9, F.lit("  \t")).otherwise(F.col("good"))
    docs.select("part", "doc_id", spoilt.alias("value")).repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    found = files.json_line_problems(spark, path)
    return found.select(F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long").alias("part"), "line", "problem")


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text, a thousand to a file: each file's lines, their largest number, and a sum that the order decides."""
    path = scratch_path(spark, "lines")
    rows = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 1000).cast("long").alias("part"), "l_orderkey", "l_linenumber", "l_partkey")
    lines = rows.repartition("part").sortWithinPartitions("part", "l_orderkey", "l_linenumber", "l_partkey").select("part", F.col("l_partkey").cast("string").alias("value"))
    lines.write.partitionBy("part").text(path)
    read = files.read_numbered_lines(spark, path).withColumn("part", F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long"))
    return read.groupBy("part").agg(F.count("*").alias("n"), F.max("line").alias("last"), F.sum(F.col("line") * F.col("value").cast("long")).alias("weighted"))


# -- image files and the asset store ------------------------------------------------------------------------------------


def grey(vector: str = "embedding") -> F.Column:
    """A vector's components as grey values: 0 at -0.5 and below, 255 at 0.5 and above."""
    return F.transform(vector, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.5) * 256).cast("int"))))


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", grey().alias("pixels"), F.lit(SIDE).alias("width"))


def _image_folder(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "images")
    images.write_images(_rasters(spark, sf_dir).select(F.concat(F.lit("vec/"), "vec_id").alias("name"), "width", F.lit(1).alias("channels"), "pixels"), path)
    return path


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters written as PNG files and read again: the size that the manifest has, and a digest of the decoded pixels."""
    path = _image_folder(spark, sf_dir)
    manifest = images.read_image_manifest(spark, path).select("name", "file", "digest", "width", "height")
    held = images.read_image_files(spark, path).withColumn("own", F.sha2("content", 256))
    both = images.decoded(manifest.join(held, "file").withColumn("digest_agrees", F.col("digest") == F.col("own")).select("name", "digest_agrees", "content"))
    shown = F.unhex(F.array_join(F.transform("pixels", lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    return both.select(F.element_at(F.split("name", "/"), 2).cast("long").alias("vec_id"), "width", "height", "digest_agrees", F.sha2(shown, 256).alias("pixels_sha256"))


def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of the written image files finds, by size in pixels: files, and those whose bytes agree with the manifest."""
    path = _image_folder(spark, sf_dir)
    held = files.read_images(spark, f"{path}/*/images/*/*.png").select(F.regexp_extract("path", r"([^/]+/images/[^/]+/[^/]+)$", 1).alias("file"), "digest", "length")
    found = images.read_image_manifest(spark, path).join(held, ["file", "digest", "length"], "left_semi")
    return found.groupBy("width", "height").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


def asset_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as assets: the store's objects with the names that point at them, and what an object holds."""
    root = scratch_path(spark, "store")
    assets = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("name"), F.col("text").cast("binary").alias("content"))
    manifest = images.store_assets(assets, root)
    named = manifest.groupBy("digest").agg(F.count("*").alias("names"), F.min("length").alias("length"))
    held = images.read_objects(spark, root).select("digest", (F.sha2("content", 256) == F.col("digest")).alias("intact"))
    return held.join(named, "digest").select("digest", "names", "length", "intact")


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows that point at their document's text, some wrongly, and the files that there are."""
    docs = table(spark, sf_dir, "documents")
    i, own = F.col("doc_id") % 13, F.concat(F.lit("images/"), "doc_id", F.lit(".txt"))
    path = F.when(i == 3, F.array(own, own)).when(i == 5, F.array(F.concat(F.lit("/"), own))).when(i == 7, F.array(F.concat(F.lit("images/../"), "doc_id"))).when(i == 9, F.array(F.concat(own, F.lit(".absent")))).otherwise(F.array(own))
    rows = docs.select("doc_id", path.alias("images"))
    return rows.unionByName(rows.filter(i == 11)), docs.select(own.alias("path"), F.sha2("text", 256).alias("digest"))


def link_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, available = _links(spark, sf_dir)
    rows = rows.withColumn("key", F.concat(F.col("doc_id"), F.lit(":"), F.row_number().over(_copies())))
    return images.link_problems(rows, "key", "images", available)


def _copies():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("doc_id")


def linked_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each different text links its file into the store."""
    root = scratch_path(spark, "store")
    docs = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    path = F.concat(F.lit("images/"), "doc_id", F.lit(".txt"))
    linked = images.link_assets(docs.select("doc_id", F.array(path).alias("images")), "doc_id", "images", docs.select(path.alias("path"), F.col("text").cast("binary").alias("content")), root)
    return linked.select(F.col("key").alias("doc_id"), "digest", "length")


# -- fonts and sizes ----------------------------------------------------------------------------------------------------


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as segments of code points: their number and size decide the kind, the font and the ends."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(F.lit("cjk"), F.lit("yi"), F.lit("circled")), (k % 3 + 1).cast("int"))
    base = F.element_at(F.array(F.lit(32), F.lit(0xA000), F.lit(0x2460)), (k % 3 + 1).cast("int"))
    first = base + (k * 7) % 100
    return table(spark, sf_dir, "part").select(kind.alias("kind"), (k % 5).cast("int").alias("font"), first.cast("int").alias("first"), (first + size % 4 - 1).cast("int").alias("last"))


def segment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.coverage(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", _segments(spark, sf_dir))


def font_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A font for each character of the parts' names, vowels as Yi syllables and circled digits, every ninth one forced."""
    text = F.translate("p_name", "aeiou", "ꀀꀁ①②ꀂ")
    chars = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.posexplode(F.split(text, "")).alias("position", "char")).filter("char <> ''")
    chars = chars.withColumn("forced", F.when((F.col("key") + F.col("position")) % 9 == 0, (F.col("key") % 5).cast("int")))
    return fonts.chosen_fonts(chars, _segments(spark, sf_dir), SEED)


def fitted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size at which each line of each document fits its block, null where none from 36 down to 10 does."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    width = 400 + F.col("doc_id") % 7 * 300
    return lines.select("doc_id", "line", fonts.fitting_size(F.col("text"), width, F.lit(36), WIDTHS, OTHER_WIDTH).cast("long").alias("size"))


# -- rasters --------------------------------------------------------------------------------------------------------------


def degraded_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster blurred, resampled and rotated by amounts that follow its number: a row for each pixel, in thousandths."""
    k = F.col("vec_id") % 5
    made = raster.degraded(_rasters(spark, sf_dir), "pixels", "width", 0.35 + k * 0.2, 0.6 + k * 0.07, k.cast("double") - 2, 245.0, 2)
    return made.select("vec_id", F.posexplode(F.arrays_zip("blurred", "resampled", "rotated")).alias("place", "p")).select("vec_id", "place", *(F.floor(F.col(f"p.{c}") * 1000 + OFF_TIES).alias(c) for c in ("blurred", "resampled", "rotated")))


def old_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster as a mild old print: a row for each pixel, in thousandths."""
    made = _rasters(spark, sf_dir).select("vec_id", F.posexplode(raster.old_print(F.col("pixels"), F.col("width"), 2)).alias("place", "p"))
    return made.select("vec_id", "place", F.floor(F.col("p") * 1000 + OFF_TIES).alias("tone"))


def faded_inks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of strong contrast faded by amounts that follow their number; what is below 100 is ink."""
    strong = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.25) * 512).cast("int"))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", strong.alias("pixels"), F.lit(SIDE).alias("width"))
    rows = rows.withColumn("mask", F.transform("pixels", lambda p: F.when(p < 100, 1).otherwise(0)))
    k = F.col("vec_id") % 5
    made = raster.faded_ink(rows, "vec_id", "pixels", "mask", "width", 0.7 + k * 0.075, 0.72 + k * 0.04)
    total = F.aggregate("variant", F.lit(0.0), lambda a, p: a + p)
    return made.select("vec_id", "changed", F.floor(F.col("readable") * 1000 + OFF_TIES).alias("readable"), F.floor(total * 1000 + OFF_TIES).alias("tone"), "problem")


def upright_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 16 x 4 turned upright and shrunk to sides that follow their number: a row for each pixel, in thousandths."""
    most = F.element_at(F.array(F.lit(0), F.lit(12), F.lit(40), F.lit(8)), (F.col("vec_id") % 4 + 1).cast("int"))
    turned = _rasters(spark, sf_dir).select("vec_id", raster.upright_within("pixels", F.lit(2 * SIDE), (F.col("vec_id") % 9).cast("int"), most).alias("u"))
    made = turned.select("vec_id", "u.width", "u.height", F.posexplode("u.pixels").alias("place", "p"))
    return made.select("vec_id", "width", "height", "place", F.floor(F.col("p") * 1000 + OFF_TIES).alias("tone"))


def paper_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of paper for each part, of a size that follows its number: its darkest and lightest value and a digest."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", (16 + k % 5).alias("w"), (12 + k % 3).alias("h"))
    made = raster.paper_backgrounds(spread(rows, "p_partkey"), "p_partkey", "w", "h", SEED)
    return made.select("p_partkey", "width", "height", F.array_min("pixels").alias("low"), F.array_max("pixels").alias("high"), raster.pixel_digest("pixels").alias("pixels_sha256"))


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as masks: what is over 0.1, as eighths up to one, so that sums are exact."""
    ink = F.transform("embedding", lambda x: F.least(F.lit(8), F.greatest(F.lit(0), F.floor((x.cast("double") - 0.1) * 40).cast("int"))) / 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", ink.alias("mask"), F.lit(SIDE).alias("width"))


def mask_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _masks(spark, sf_dir).select("vec_id", raster.mask_moments("mask", "width").alias("m"))
    return found.select("vec_id", *(F.round(f"m.{c}", 6).alias(c) for c in ("ink", "center_x", "center_y")), "m.shift_x", "m.shift_y")


def centred_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centred masks' inked pixels."""
    made = _masks(spark, sf_dir).select("vec_id", F.posexplode(raster.centred_mask("mask", "width")).alias("place", "ink"))
    return made.filter("ink > 0").select("vec_id", "place", F.round("ink", 6).alias("ink"))


def feature_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape features of the masks: their length, and 1 as their norm but for masks without ink."""
    made = _masks(spark, sf_dir).select("vec_id", raster.shape_features("mask", "width").alias("v"))
    return made.select("vec_id", F.size("v").cast("long").alias("dimensions"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


def glyph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks' shape features in the neighbour graph: each mask's three nearest of its font."""
    features = _masks(spark, sf_dir).select((F.col("vec_id") % 4).cast("int").alias("font"), F.lit(0).alias("view"), F.col("vec_id").alias("i"), raster.shape_features("mask", "width").alias("feature"))
    return rounded(similarity.neighbours(features, 3).select("font", "i", "j", "sim", F.col("rank").cast("long").alias("rank")), 6)


def residual_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks put into rasters of 48 x 48, each embedding's component six pixels wide: what was wanted, what was placed, and
    pixels of ink that changed."""
    spread = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIDE * 6 - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(SIDE * 6 - 1)), lambda x: F.floor(y / 6) * SIDE + F.floor(x / 6))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(spread, lambda at: F.when(F.get("embedding", at.cast("int")) > 0.15, 1).otherwise(0)).alias("mask"), F.lit(SIDE * 6).alias("width"))
    rows = rows.withColumn("pixels", F.transform("mask", lambda m: F.when(m > 0, 20).otherwise(250)))
    made = raster.residual_marks(rows, "vec_id", "pixels", "mask", "width", SEED).join(rows.select("vec_id", "mask"), "vec_id")
    touched = F.size(F.filter(F.zip_with("mask", "pixels", lambda m, p: (m > 0) & (p != 20)), lambda x: x))
    return made.select("vec_id", "wanted", F.size("marks").alias("placed"), touched.alias("ink_changed"))


# -- seed streams -----------------------------------------------------------------------------------------------------------


def stream_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two draws of each part's own stream below the seed."""
    k = F.col("p_partkey")
    drawn = [streams.stream_uniform(SEED, n, k, 3).alias(f"u{n}") for n in (0, 5)]
    return table(spark, sf_dir, "part").select("p_partkey", *drawn)


def philox_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of a block of the generator, for keys and counters made of each part's number."""
    k = F.col("p_partkey").cast("long")
    block = streams.philox(F.array(k, k % 97, k * 3, k % 11), k % 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.get(block, F.lit(0))["high"].alias("high"), F.get(block, F.lit(0))["low"].alias("low"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        json_line_problems, numbered_lines, image_files, image_scan, asset_store, link_problems, linked_assets, segment_coverage, font_choices, fitted_lines, degraded_rasters, old_prints, faded_inks, upright_images, paper_sheets, mask_moments, centred_masks,
        feature_norms, glyph_neighbours, residual_marks, stream_draws, philox_blocks,
    )
}

_GREY = "pixels AS (SELECT vec_id, (unnest(range(64)))::INT AS place, unnest([least(255, greatest(0, floor((x::DOUBLE + 0.5) * 256)::INT)) for x in embedding]) AS v FROM embeddings)"
_MASK = "masks AS (SELECT vec_id, unnest(range(64))::INT AS place, unnest([least(8, greatest(0, floor((x::DOUBLE - 0.1) * 40)::INT)) for x in embedding]) AS eighths FROM embeddings)"
_MOMENTS = f"""{_MASK},
sums AS (SELECT vec_id, sum(eighths) AS ink, sum(eighths * (place % 8))::DOUBLE AS mx, sum(eighths * (place // 8))::DOUBLE AS my FROM masks GROUP BY vec_id),
moments AS (SELECT vec_id, ink / 8.0::DOUBLE AS ink, CASE WHEN ink > 0 THEN mx / ink END AS center_x, CASE WHEN ink > 0 THEN my / ink END AS center_y FROM sums),
shifts AS (SELECT *, coalesce(round_even(3.5 - center_x, 0), 0)::INT AS shift_x, coalesce(round_even(3.5 - center_y, 0), 0)::INT AS shift_y FROM moments)"""
_SEGMENTS = """segments AS (
  SELECT ['cjk', 'yi', 'circled'][p_partkey % 3 + 1] AS kind, (p_partkey % 5)::INT AS font, [32, 40960, 9312][p_partkey % 3 + 1] + (p_partkey * 7) % 100 AS first,
         [32, 40960, 9312][p_partkey % 3 + 1] + (p_partkey * 7) % 100 + p_size % 4 - 1 AS last FROM part)"""
_SPOILT = "spoilt AS (SELECT doc_id, doc_id // 100 AS part, doc_id % 11 AS i, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS line FROM documents)"
_WIDE = " + ".join(f"(length(text) - length(translate(text, '{chars.replace(chr(39), chr(39) * 2)}', ''))) * (100 * (({units} * s + 500) // 1000) + 6 * s)" for units, chars in WIDTHS.items())
_REST = "length(translate(text, '" + "".join(WIDTHS.values()).replace("'", "''") + f"', '')) * (100 * (({OTHER_WIDTH} * s + 500) // 1000) + 6 * s)"

ORACLES: dict[str, str] = {
    "json_line_problems": f"WITH {_SPOILT} SELECT part, line, CASE i WHEN 5 THEN 'not a JSON object' ELSE 'not valid JSON' END AS problem FROM spoilt WHERE i IN (5, 7)",
    "numbered_lines": """WITH r AS (SELECT l_orderkey // 1000 AS part, l_partkey, row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, l_linenumber, l_partkey) AS line FROM lineitem)
SELECT part, count(*) AS n, count(*) AS last, sum(line * l_partkey)::BIGINT AS weighted FROM r GROUP BY part""",
    "image_files": f"WITH {_GREY} SELECT vec_id, 8::INT AS width, 8::INT AS height, true AS digest_agrees, sha256(unhex(string_agg(printf('%02x', v), '' ORDER BY place))) AS pixels_sha256 FROM pixels GROUP BY vec_id",
    "image_scan": "SELECT 8::INT AS width, 8::INT AS height, count(*) AS n, count(DISTINCT vec_id) AS names FROM embeddings",
    "asset_store": "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS names, min(octet_length(encode(coalesce(text, ''))))::BIGINT AS length, true AS intact FROM documents GROUP BY 1",
    "link_problems": """WITH d AS (SELECT doc_id, doc_id % 13 AS i, 'images/' || doc_id || '.txt' AS own, sha256(text) AS digest FROM documents),
good AS (SELECT own AS path, digest, min(own) OVER (PARTITION BY digest) AS least, doc_id, i FROM d WHERE i NOT IN (3, 5, 7, 9))
SELECT doc_id || ':1' AS key, NULL AS path, 'not exactly one image' AS problem FROM d WHERE i = 3
UNION ALL SELECT doc_id || ':1', '/' || own, 'unsafe path' FROM d WHERE i = 5 UNION ALL SELECT doc_id || ':1', '/' || own, 'missing file' FROM d WHERE i = 5
UNION ALL SELECT doc_id || ':1', 'images/../' || doc_id, 'unsafe path' FROM d WHERE i = 7 UNION ALL SELECT doc_id || ':1', 'images/../' || doc_id, 'missing file' FROM d WHERE i = 7
UNION ALL SELECT doc_id || ':1', own || '.absent', 'missing file' FROM d WHERE i = 9
UNION ALL SELECT doc_id || ':2', own, 'repeated path' FROM d WHERE i = 11
UNION ALL SELECT doc_id || ':' || unnest(CASE WHEN i = 11 THEN [1, 2] ELSE [1] END), path, 'repeated bytes' FROM good WHERE path > least""",
    "linked_assets": "SELECT min(doc_id) AS doc_id, sha256(text) AS digest, octet_length(encode(text))::BIGINT AS length FROM documents GROUP BY text",
    "segment_coverage": f"""WITH {_SEGMENTS}, chars AS (SELECT DISTINCT doc_id, unicode(unnest(regexp_extract_all(text, '(?s).'))) AS cp FROM documents),
points AS (SELECT DISTINCT cp FROM chars), met AS (SELECT DISTINCT cp, kind, font FROM points JOIN segments ON cp BETWEEN first AND last),
bare AS (SELECT c.doc_id, count(*) AS n_chars, count(*) FILTER (cp NOT IN (SELECT cp FROM met)) AS n_uncovered FROM chars c GROUP BY 1),
used AS (SELECT doc_id, count(DISTINCT kind || font) AS n_fonts FROM chars JOIN met USING (cp) GROUP BY 1)
SELECT d.doc_id, coalesce(bare.n_chars, 0) AS n_chars, coalesce(n_uncovered, 0) AS n_uncovered, coalesce(n_fonts, 0) AS n_fonts FROM documents d LEFT JOIN bare USING (doc_id) LEFT JOIN used USING (doc_id)""",
    "font_choices": f"""WITH {_SEGMENTS}, names AS (SELECT p_partkey AS key, regexp_extract_all(translate(p_name, 'aeiou', 'ꀀꀁ①②ꀂ'), '(?s).') AS c FROM part),
chars AS (SELECT key, unnest(range(len(c)))::INT AS position, unnest(c) AS char FROM names),
asked AS (SELECT *, unicode(char) AS cp, CASE WHEN (key + position) % 9 = 0 THEN (key % 5)::INT END AS forced FROM chars),
met AS (SELECT cp, kind, list_sort(list(DISTINCT font)) AS fonts FROM (SELECT DISTINCT cp FROM asked) JOIN segments ON cp BETWEEN first AND last GROUP BY ALL),
kinds AS (SELECT a.*, CASE WHEN cp BETWEEN 9312 AND 9331 THEN 'circled' WHEN forced IS NOT NULL OR cp BETWEEN 40960 AND 42191 AND EXISTS (SELECT 1 FROM met m WHERE m.cp = a.cp AND m.kind = 'yi') THEN 'yi' ELSE 'cjk' END AS kind FROM asked a),
picked AS (SELECT k.*, m.fonts, CASE WHEN forced IS NOT NULL THEN CASE WHEN list_contains(m.fonts, forced) THEN forced END
  ELSE m.fonts[floor(('0x' || left(md5('{SEED}:' || key || ':' || position), 13))::BIGINT / 4503599627370496.0::DOUBLE * len(m.fonts))::INT + 1] END AS font FROM kinds k LEFT JOIN met m ON m.cp = k.cp AND m.kind = k.kind)
SELECT key, position, char, kind, font, CASE WHEN font IS NOT NULL THEN NULL WHEN forced IS NOT NULL THEN 'forced font lacks it' ELSE 'uncovered' END AS problem FROM picked""",
    "fitted_lines": f"""WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
sizes AS (SELECT unnest(range(10, 37)) AS s), fits AS (SELECT doc_id, line, s, {_WIDE} + {_REST} <= 100 * (400 + doc_id % 7 * 300) AS ok FROM lines CROSS JOIN sizes)
SELECT doc_id, line::INT AS line, max(s) FILTER (ok)::BIGINT AS size FROM fits GROUP BY doc_id, line""",
    "degraded_rasters": f"""WITH {_GREY}, cells AS (SELECT vec_id, vec_id % 5 AS k, place, place // 8 AS y, place % 8 AS x, v::DOUBLE AS v FROM pixels),
ks AS (SELECT unnest(range(5)) AS k), eight AS (SELECT unnest(range(8)) AS i),
reach AS (SELECT k, 0.35::DOUBLE + k * 0.2::DOUBLE AS sigma, unnest(range(-5, 6)) AS d FROM ks),
gauss AS (SELECT k, d, exp(-0.5 * (d / sigma) ** 2) / sum(exp(-0.5 * (d / sigma) ** 2)) OVER (PARTITION BY k) AS w FROM reach WHERE abs(d) <= ceil(3 * sigma)),
soft AS (SELECT k, i AS target, least(7, greatest(0, i + d)) AS source, sum(w) AS w FROM gauss CROSS JOIN eight GROUP BY ALL),
small AS (SELECT k, greatest(2, floor(8 * (0.6::DOUBLE + k * 0.07::DOUBLE))::INT) AS n FROM ks),
shrink AS (SELECT k, n, t, s, w / sum(w) OVER (PARTITION BY k, t) AS w FROM (SELECT k, n, t, s.i AS s, greatest(0, 1 - abs(s.i + 0.5 - (t + 0.5) * 8.0::DOUBLE / n) / greatest(1.0, 8.0::DOUBLE / n)) AS w FROM (SELECT *, unnest(range(n)) AS t FROM small) CROSS JOIN eight s)),
grow AS (SELECT k, t, s, w / sum(w) OVER (PARTITION BY k, t) AS w FROM (SELECT k, t.i AS t, s, greatest(0, 1 - abs(s + 0.5 - (t.i + 0.5) * n / 8.0::DOUBLE) / greatest(1.0, n / 8.0::DOUBLE)) AS w FROM (SELECT *, unnest(range(n)) AS s FROM small) CROSS JOIN eight t)),
coarse AS (SELECT g.k, g.t AS target, h.s AS source, sum(g.w * h.w) AS w FROM grow g JOIN shrink h ON g.k = h.k AND g.s = h.t GROUP BY ALL),
across AS (SELECT 'b' AS op, c.vec_id, c.k, c.y, m.target AS x, sum(c.v * m.w) AS v FROM cells c JOIN soft m ON c.k = m.k AND c.x = m.source GROUP BY ALL UNION ALL SELECT 'r', c.vec_id, c.k, c.y, m.target, sum(c.v * m.w) FROM cells c JOIN coarse m ON c.k = m.k AND c.x = m.source GROUP BY ALL),
mapped AS (SELECT a.op, a.vec_id, m.target * 8 + a.x AS place, sum(a.v * m.w) AS v FROM across a JOIN (SELECT 'b' AS op, * FROM soft UNION ALL SELECT 'r', * FROM coarse) m ON a.op = m.op AND a.k = m.k AND a.y = m.source GROUP BY ALL),
turned AS (SELECT vec_id, k, place, cos(radians(k - 2.0::DOUBLE)) * (x + 0.5 - 4) - sin(radians(k - 2.0::DOUBLE)) * (y + 0.5 - 4) + 4 AS fx, sin(radians(k - 2.0::DOUBLE)) * (x + 0.5 - 4) + cos(radians(k - 2.0::DOUBLE)) * (y + 0.5 - 4) + 4 AS fy FROM cells),
taps AS (SELECT t.vec_id, t.place, fx, fy, floor(fy - 0.5)::INT + j AS ty, floor(fx - 0.5)::INT + i AS tx, CASE WHEN j = 1 THEN fy - 0.5 - floor(fy - 0.5) ELSE 1 - (fy - 0.5 - floor(fy - 0.5)) END * CASE WHEN i = 1 THEN fx - 0.5 - floor(fx - 0.5) ELSE 1 - (fx - 0.5 - floor(fx - 0.5)) END AS w FROM turned t CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j)),
spun AS (SELECT t.vec_id, t.place, CASE WHEN min(fx) >= 0 AND min(fx) < 8 AND min(fy) >= 0 AND min(fy) < 8 THEN sum(t.w * c.v) ELSE 245 END AS v FROM taps t JOIN cells c ON c.vec_id = t.vec_id AND c.y = least(7, greatest(0, ty)) AND c.x = least(7, greatest(0, tx)) GROUP BY t.vec_id, t.place)
SELECT b.vec_id, b.place::INT AS place, floor(b.v * 1000 + {OFF_TIES}::DOUBLE)::BIGINT AS blurred, floor(r.v * 1000 + {OFF_TIES}::DOUBLE)::BIGINT AS resampled, floor(s.v * 1000 + {OFF_TIES}::DOUBLE)::BIGINT AS rotated FROM mapped b JOIN mapped r ON b.op = 'b' AND r.op = 'r' AND b.vec_id = r.vec_id AND b.place = r.place JOIN spun s ON s.vec_id = b.vec_id AND s.place = b.place""",
    "old_prints": f"""WITH {_GREY}, cells AS (SELECT vec_id, place // 8 AS y, place % 8 AS x, v::DOUBLE AS v FROM pixels), eight AS (SELECT unnest(range(8)) AS i),
gauss AS (SELECT d, exp(-0.5 * (d / 0.55::DOUBLE) ** 2) / sum(exp(-0.5 * (d / 0.55::DOUBLE) ** 2)) OVER () AS w FROM (SELECT unnest(range(-2, 3)) AS d)),
soft AS (SELECT i AS target, least(7, greatest(0, i + d)) AS source, sum(w) AS w FROM gauss CROSS JOIN eight GROUP BY ALL),
shrink AS (SELECT t, s, w / sum(w) OVER (PARTITION BY t) AS w FROM (SELECT t, i AS s, greatest(0, 1 - abs(i + 0.5 - (t + 0.5) * 8 / 7.0::DOUBLE) * 7 / 8.0::DOUBLE) AS w FROM range(7) r(t) CROSS JOIN eight)),
grow AS (SELECT t, s, w / sum(w) OVER (PARTITION BY t) AS w FROM (SELECT i AS t, s, greatest(0, 1 - abs(s + 0.5 - (i + 0.5) * 7 / 8.0::DOUBLE)) AS w FROM range(7) r(s) CROSS JOIN eight)),
line AS (SELECT b.target, h.s AS source, sum(b.w * g.w * h.w) AS w FROM soft b JOIN grow g ON b.source = g.t JOIN shrink h ON g.s = h.t GROUP BY ALL),
across AS (SELECT c.vec_id, c.y, m.target AS x, sum(c.v * m.w) AS v FROM cells c JOIN line m ON c.x = m.source GROUP BY ALL),
mapped AS (SELECT a.vec_id, (m.target * 8 + a.x)::INT AS place, sum(a.v * m.w) AS v FROM across a JOIN line m ON a.y = m.source GROUP BY ALL)
SELECT vec_id, place, floor(least(255, greatest(0, 128 + (v - 128) * 0.92::DOUBLE)) * 1000 + {OFF_TIES}::DOUBLE)::BIGINT AS tone FROM mapped""",
    "faded_inks": f"""WITH cells AS (SELECT vec_id, vec_id % 5 AS k, unnest(range(64)) // 8 AS y, unnest(range(64)) % 8 AS x, unnest([least(255, greatest(0, floor((e::DOUBLE + 0.25) * 512)::INT)) for e in embedding]) AS v FROM embeddings),
reach AS (SELECT k, 0.7::DOUBLE + k * 0.075::DOUBLE AS sigma, unnest(range(-3, 4)) AS d FROM range(5) r(k)),
gauss AS (SELECT k, d, exp(-0.5 * (d / sigma) ** 2) / sum(exp(-0.5 * (d / sigma) ** 2)) OVER (PARTITION BY k) AS w FROM reach WHERE abs(d) <= ceil(3 * sigma)),
soft AS (SELECT k, i AS target, least(7, greatest(0, i + d)) AS source, sum(w) AS w FROM gauss CROSS JOIN range(8) r(i) GROUP BY ALL),
across AS (SELECT c.vec_id, c.k, c.y, m.target AS x, sum(c.v * m.w) AS v FROM cells c JOIN soft m ON c.k = m.k AND c.x = m.source GROUP BY ALL),
blurred AS (SELECT a.vec_id, a.k, m.target AS y, a.x, sum(a.v * m.w) AS v FROM across a JOIN soft m ON a.k = m.k AND a.y = m.source GROUP BY ALL),
means AS (SELECT vec_id, floor(avg(v) + 0.5) AS mean FROM blurred GROUP BY vec_id),
variant AS (SELECT vec_id, c.v AS p, c.v < 100 AS ink, least(255, greatest(0, mean + (b.v - mean) * (0.72::DOUBLE + b.k * 0.04::DOUBLE))) AS v FROM blurred b JOIN means USING (vec_id) JOIN cells c USING (vec_id, y, x)),
told AS (SELECT vec_id, count(*) FILTER (ink AND abs(p - v) >= 2) AS changed, median(v) FILTER (NOT ink) - quantile_cont(v, 0.25) FILTER (ink) AS readable, sum(v) AS tone, count(*) FILTER (ink) AS inked FROM variant GROUP BY vec_id)
SELECT vec_id, changed, floor(readable * 1000 + {OFF_TIES}::DOUBLE)::BIGINT AS readable, floor(tone * 1000 + {OFF_TIES}::DOUBLE)::BIGINT AS tone,
  CASE WHEN inked = 0 THEN 'no ink' WHEN inked = 64 THEN 'no paper' WHEN changed = 0 THEN 'nothing changed' WHEN readable < 40 THEN 'not readable' END AS problem FROM told""",
    "upright_images": f"""WITH {_GREY}, given AS (SELECT vec_id, vec_id % 9 AS o, [16, 12, 16, 8][vec_id % 4 + 1] AS side, place // 16 AS y, place % 16 AS x, v::DOUBLE AS v FROM pixels),
turned AS (SELECT vec_id, side, CASE WHEN o BETWEEN 5 AND 8 THEN 16 ELSE 4 END AS h, CASE WHEN o BETWEEN 5 AND 8 THEN 4 ELSE 16 END AS w, v,
  CASE o WHEN 3 THEN 3 - y WHEN 4 THEN 3 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 15 - x WHEN 8 THEN 15 - x ELSE y END AS y,
  CASE o WHEN 2 THEN 15 - x WHEN 3 THEN 15 - x WHEN 5 THEN y WHEN 6 THEN 3 - y WHEN 7 THEN 3 - y WHEN 8 THEN y ELSE x END AS x FROM given),
lengths AS (SELECT n, side, n * side // 16 AS m, n / (n * side // 16)::DOUBLE AS scale FROM (SELECT unnest([4, 16]) AS n) CROSS JOIN (SELECT unnest([8, 12, 16]) AS side)),
far AS (SELECT n, side, t, s, (s + 0.5 - (t + 0.5) * scale) / scale AS u FROM (SELECT *, unnest(range(n)) AS s FROM (SELECT *, unnest(range(m)) AS t FROM lengths))),
raw AS (SELECT n, side, t, s, CASE WHEN u = 0 THEN 1 WHEN abs(u) < 3 THEN sin(pi() * u) / (pi() * u) * sin(pi() * u / 3) / (pi() * u / 3) ELSE 0 END AS w FROM far),
line AS (SELECT n, side, t, s, w / sum(w) OVER (PARTITION BY n, side, t) AS w FROM raw),
across AS (SELECT c.vec_id, c.side, c.h, c.w, c.y, l.t AS x, sum(c.v * l.w) AS v FROM turned c JOIN line l ON l.n = c.w AND l.side = c.side AND l.s = c.x GROUP BY ALL)
SELECT a.vec_id, (a.w * a.side // 16)::INT AS width, (a.h * a.side // 16)::INT AS height, (l.t * (a.w * a.side // 16) + a.x)::INT AS place,
  floor(least(255, greatest(0, sum(a.v * l.w))) * 1000 + {OFF_TIES}::DOUBLE)::BIGINT AS tone
FROM across a JOIN line l ON l.n = a.h AND l.side = a.side AND l.s = a.y GROUP BY a.vec_id, a.w, a.h, a.side, a.x, l.t""",
    "mask_moments": f"WITH {_MOMENTS} SELECT vec_id, round(ink, 6) AS ink, round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, shift_x, shift_y FROM shifts",
    "centred_masks": f"""WITH {_MOMENTS} SELECT m.vec_id, ((place // 8 + shift_y) * 8 + place % 8 + shift_x)::INT AS place, round(eighths / 8.0::DOUBLE, 6) AS ink
FROM masks m JOIN shifts s ON m.vec_id = s.vec_id WHERE eighths > 0 AND place // 8 + shift_y BETWEEN 0 AND 7 AND place % 8 + shift_x BETWEEN 0 AND 7""",
    "feature_norms": f"WITH {_MOMENTS} SELECT vec_id, 96::BIGINT AS dimensions, CASE WHEN ink > 0 THEN 1.0 ELSE 0.0 END AS norm FROM moments",
    "philox_blocks": """WITH RECURSIVE r AS (
  SELECT p_partkey, 0 AS round, (p_partkey % 5 + 1)::UHUGEINT AS c0, 0::UHUGEINT AS c1, 0::UHUGEINT AS c2, 0::UHUGEINT AS c3, (p_partkey + (p_partkey % 97) * 4294967296)::UHUGEINT AS k0, (p_partkey * 3 + (p_partkey % 11) * 4294967296)::UHUGEINT AS k1 FROM part
  UNION ALL
  SELECT p_partkey, round + 1, xor(xor((14581110107779764567::UHUGEINT * c2) // 18446744073709551616::UHUGEINT, c1), k0), (14581110107779764567::UHUGEINT * c2) % 18446744073709551616::UHUGEINT,
    xor(xor((15197193596820024467::UHUGEINT * c0) // 18446744073709551616::UHUGEINT, c3), k1), (15197193596820024467::UHUGEINT * c0) % 18446744073709551616::UHUGEINT,
    (k0 + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT, (k1 + 13503953896175478587::UHUGEINT) % 18446744073709551616::UHUGEINT FROM r WHERE round < 10)
SELECT p_partkey, (c0 // 4294967296::UHUGEINT)::BIGINT AS high, (c0 % 4294967296::UHUGEINT)::BIGINT AS low FROM r WHERE round = 10""",
}
