"""Rasters as PNG files, and assets in a content-addressed store: both written by the executors.

The PNG sink is a Python data source. A task writes its images and a manifest of them into a folder of its own below the
run's staging folder; the driver's commit moves the folders of the tasks that count, and an abort deletes the staging folder,
so a reader sees all of a run's images or none. What a task tells the driver is its folder's name, however many images it
wrote. The driver alone makes the staging folder: a task that outlives an abort finds it gone and stops.

Paths are URIs of any file system that pyarrow knows, or local paths that the driver and the executors share.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from glyphmill.session import materialise

# A PNG file's first bytes; grey and RGB colour types by the number of channels.
PNG_START, COLOUR_TYPES = b"\x89PNG\r\n\x1a\n", {1: 0, 3: 2}
RASTERS = "name string, width int, channels int, pixels array<int>"
MANIFEST = pa.schema([("name", pa.string()), ("file", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32())])
#: Images of one folder, and rows of a manifest that a task holds before it writes them.
FOLDER, ROWS = 1000, 10_000
#: Tries to delete a staging folder.
TRIES = 20
#: Length of an object's name, and bytes of objects that a task holds before it hands them on.
DIGEST, AT_ONCE = 64, 8 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; Spark writes local URIs with one slash or three."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of a (height, width) or (height, width, 3) array. Equal arrays give equal bytes."""
    pixels = np.ascontiguousarray(pixels, np.uint8)
    height, width = pixels.shape[:2]
    channels = 1 if pixels.ndim == 2 else pixels.shape[2]
    if not (width and height):
        raise ValueError("an image needs a pixel")
    rows = np.zeros((height, 1 + width * channels), np.uint8)  # a filter byte, none, before each row
    rows[:, 1:] = pixels.reshape(height, -1)
    header = struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPES[channels], 0, 0, 0)
    return PNG_START + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The array of an 8-bit grey or RGB PNG without interlacing."""
    if data[:8] != PNG_START:
        raise ValueError("not a PNG file")
    at, body, shape = 8, b"", (0, 0, 0)
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        held, crc = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if struct.unpack(">I", crc)[0] != zlib.crc32(kind + held):
            raise ValueError(f"damaged {kind.decode('ascii', 'replace')}")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", held)
            if depth != 8 or interlaced or colour not in COLOUR_TYPES.values():
                raise ValueError("only 8-bit grey and RGB images without interlacing are read")
            shape = (height, width, 1 if colour == 0 else 3)
        elif kind == b"IDAT":
            body += held
        at += 12 + size
    height, width, channels = shape
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out, above = np.zeros((height, width * channels), np.uint8), np.zeros(width * channels, np.uint8)
    for y, row in enumerate(rows):
        above = _unfiltered(int(row[0]), row[1:], above, channels)
        out[y] = above
    return out.reshape(height, width) if channels == 1 else out.reshape(height, width, channels)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row without its prediction: none, the left pixel, the one above, their mean, or the nearest of the three by Paeth."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    out = row.astype(np.int64)
    for i in range(len(out)):
        a, b, c = int(out[i - step]) if i >= step else 0, int(above[i]), int(above[i - step]) if i >= step else 0
        guess = a if kind == 1 else (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    images: int


class _ImageWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"_staging-{uuid.uuid4().hex}"
        system, root = file_system(self.path)
        system.create_dir(f"{root}/{self.staging}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        folder, n, seen = uuid.uuid4().hex, 0, []
        stage = f"{root}/{self.staging}/{folder}"
        for made in (stage, f"{stage}/manifest", f"{stage}/images"):
            system.create_dir(made, recursive=False)

        def remember() -> None:
            pq.write_table(pa.Table.from_pylist(seen, MANIFEST), f"{stage}/manifest/{n:012d}.parquet", filesystem=system)
            seen.clear()

        for batch in iterator:
            for row in batch.to_pylist():
                width, channels, flat = row["width"], row.get("channels") or 1, np.asarray(row["pixels"])
                if flat.size == 0 or flat.size % (width * channels) or flat.min() < 0 or flat.max() > 255:
                    raise ValueError(f"{row['name']}: not a raster of bytes with rows of {width}")
                shape = (-1, width) if channels == 1 else (-1, width, channels)
                pixels = flat.reshape(shape)
                data = encode_png(pixels)
                if n % FOLDER == 0:
                    system.create_dir(f"{stage}/images/{n // FOLDER:06d}", recursive=False)
                file = f"images/{n // FOLDER:06d}/{n:09d}.png"
                with system.open_output_stream(f"{stage}/{file}") as out:
                    out.write(data)
                seen.append({"name": row["name"], "file": f"{folder}/{file}", "digest": hashlib.sha256(data).hexdigest(), "length": len(data), "width": width, "height": pixels.shape[0], "channels": channels})
                n += 1
                if len(seen) == ROWS:
                    remember()
        if seen:
            remember()
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        for told in messages:
            if told and told.images:
                system.move(f"{root}/{self.staging}/{told.folder}", f"{root}/{told.folder}")
        self._forget(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._forget(*file_system(self.path))

    def _forget(self, system: pafs.FileSystem, root: str) -> None:
        for left in reversed(range(TRIES)):
            if system.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.NotFound:
                return
            try:
                system.delete_dir(f"{root}/{self.staging}")
            except OSError:  # a task that is being stopped has put a file into a folder meanwhile
                if not left:
                    raise
                time.sleep(0.2)


class PngSink(DataSource):
    """df.write.format("png").mode("append").save(path), for rows (name, width, channels, pixels)."""

    @classmethod
    def name(cls) -> str:
        return "png"

    def writer(self, schema: StructType, overwrite: bool) -> _ImageWriter:
        if overwrite:
            raise ValueError("images are appended, never overwritten")
        return _ImageWriter(self.options["path"])


def write_images(rows: DataFrame, path: str) -> None:
    """Append the rasters to the image folder at path. A raster that isn't one fails the run, and nothing of it stays.

    rows: RASTERS; a null `channels` is 1. Names may repeat: files are numbered, the manifest has the names.
    """
    rows.sparkSession.dataSource.register(PngSink)
    rows.select("name", F.col("width").cast("int"), F.col("channels").cast("int"), F.col("pixels").cast("array<int>")).write.format("png").mode("append").save(path)


def read_image_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, file, digest, length, width, height, channels) of all committed images; file is relative to path."""
    schema = "name string, file string, digest string, length long, width int, height int, channels int"
    return spark.read.schema(schema).parquet(f"{path}/*/manifest")


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of all committed images."""
    files = spark.read.format("binaryFile").load(f"{path}/*/images/*/*.png")
    return files.select(F.regexp_extract("path", r"([^/]+/images/[^/]+/[^/]+)$", 1).alias("file"), "content")


def decoded(images: DataFrame, content: str = "content") -> DataFrame:
    """images with width, height, channels and pixels in place of the PNG bytes."""
    kept = [c for c in images.columns if c != content]
    schema = StructType([images.schema[c] for c in kept] + [StructField(c, IntegerType()) for c in ("width", "height", "channels")] + [StructField("pixels", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # images may be large: one at a time
                image = decode_png(batch.column(content)[i].as_py())
                height, width = image.shape[:2]
                size = [pa.array([x], pa.int32()) for x in (width, height, 1 if image.ndim == 2 else image.shape[2])]
                own = [batch.column(c).slice(i, 1) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, *size, pa.array([image.ravel().astype(np.int32)], pa.list_(pa.int32()))], schema=pa.schema([*(batch.schema.field(c) for c in kept), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.list_(pa.int32()))]))

    return images.mapInArrow(run, schema)


# -- a content-addressed store ----------------------------------------------------------------------------------------


def object_path(digest: str) -> str:
    return f"objects/{digest[:2]}/{digest}"


def store_assets(assets: DataFrame, root: str) -> DataFrame:
    """(name, digest, length, object): assets (name, content) put into the store at root, an object for each content.

    The executors write. An object is written under a name of its own and renamed to its digest, so it is there whole or
    not at all; what is there already is left alone. A task that runs twice, or two tasks with the same content, therefore
    leave one object. A null content is empty. The returned manifest is written, so the store is filled when this returns.
    """
    named = assets.select(F.col("name").cast("string").alias("name"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        folders: set[str] = set()
        for batch in batches:
            digests, lengths = [], []
            for held in batch.column("content"):
                data = held.as_buffer()
                digest = hashlib.sha256(data).hexdigest()
                digests.append(digest)
                lengths.append(len(data))
                target = f"{base}/{object_path(digest)}"
                if digest[:2] not in folders:
                    system.create_dir(f"{base}/objects/{digest[:2]}")
                    folders.add(digest[:2])
                if system.get_file_info(target).type == pafs.FileType.NotFound:
                    own = f"{target}.{uuid.uuid4().hex}"
                    with system.open_output_stream(own) as out:
                        out.write(data)
                    system.move(own, target)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(digests, pa.string()), pa.array(lengths, pa.int64()), pa.array(map(object_path, digests), pa.string())], ["name", "digest", "length", "object"])

    return materialise(named.mapInArrow(run, "name string, digest string, length long, object string"), "assets")


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    """(digest, content) of the store's objects. A task lists a folder of the store and reads its objects, a few megabytes at
    a time: neither their names nor a task for each few of them pass through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                digests, contents, size = [], [], 0
                for found in system.get_file_info(pafs.FileSelector(f"{base}/objects/{folder}", allow_not_found=True)):
                    if len(found.base_name) != DIGEST:  # an object that is being written
                        continue
                    with system.open_input_stream(found.path) as held:
                        contents.append(held.read())
                    digests.append(found.base_name)
                    size += len(contents[-1])
                    if size >= AT_ONCE or len(digests) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(contents, pa.binary())], ["digest", "content"])
                        digests, contents, size = [], [], 0
                if digests:
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(contents, pa.binary())], ["digest", "content"])

    folders = spark.range(0, 256, 1, 256).select(F.lower(F.lpad(F.hex("id"), 2, "0")).alias("folder"))
    return folders.mapInArrow(run, "digest string, content binary")


def link_problems(rows: DataFrame, key: str, paths: str, available: DataFrame) -> DataFrame:
    """(key, path, problem): rows whose image can't be linked from one source. `paths` is an array of relative paths;
    available (path, digest) lists the source's files.

    A row needs exactly one path, below images/ and without steps upwards; no path occurs twice; the file exists; and no two
    paths have the same bytes (the smallest path stands, the others are reported).
    """
    one = F.size(F.coalesce(F.col(paths), F.array().cast("array<string>"))) == 1
    counted = rows.select(F.col(key).alias("key"), F.when(one, F.element_at(paths, 1)).alias("path"))
    wrong = counted.filter("path is null").select("key", "path", F.lit("not exactly one image").alias("problem"))
    single = counted.filter("path is not null")
    parts = F.split("path", "/")
    unsafe = single.filter((F.get(parts, F.lit(0)) != "images") | (F.size(parts) < 2) | F.array_contains(parts, "..")).select("key", "path", F.lit("unsafe path").alias("problem"))
    repeated = single.groupBy("path").agg(F.min("key").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    twice = single.join(repeated, "path").filter("key > _first").select("key", "path", F.lit("repeated path").alias("problem"))
    found = single.join(available, "path", "left")
    missing = found.filter("digest is null").select("key", "path", F.lit("missing file").alias("problem"))
    same = found.filter("digest is not null").groupBy("digest").agg(F.min("path").alias("_least"), F.count_distinct("path").alias("_n")).filter("_n > 1")
    bytes_ = found.join(same, "digest").filter("path > _least").select("key", "path", F.lit("repeated bytes").alias("problem"))
    return wrong.unionByName(unsafe).unionByName(twice).unionByName(missing).unionByName(bytes_)


def link_assets(rows: DataFrame, key: str, paths: str, files: DataFrame, root: str) -> DataFrame:
    """(key, path, digest, length, object): the rows' images put into the store at root, or an error that counts what
    link_problems reports. files: (path, content) of the source."""
    held = store_assets(files.select(F.col("path").alias("name"), "content"), root)
    problems = link_problems(rows, key, paths, held.select(F.col("name").alias("path"), "digest"))
    counts = {r["problem"]: r["n"] for r in problems.groupBy("problem").agg(F.count("*").alias("n")).collect()}  # five kinds
    if counts:
        raise ValueError(f"images can't be linked: {counts}")
    linked = rows.select(F.col(key).alias("key"), F.element_at(paths, 1).alias("name")).join(held, "name")
    return linked.select("key", F.col("name").alias("path"), "digest", "length", "object")
