"""A session for local work (on a cluster the caller brings its own), and the shared scratch space of a run."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "glyphmill", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8"}
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local master gets a temporary
    folder and any other master an error: its executors don't share the driver's disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="glyphmill-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Where the scratch paths of the open scope are noted.
_NOTED: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the scratch folder, deleted when the interpreter ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    if (noted := _NOTED.get()) is not None:
        noted.append(path)
    return path


@contextmanager
def noted_scratch() -> Iterator[list[str]]:
    """The list of scratch paths that are made within the block, in order."""
    noted: list[str] = []
    token = _NOTED.set(noted)
    try:
        yield noted
    finally:
        _NOTED.reset(token)


def drop_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables that no plan reads any more."""
    for path in paths:
        _forget(spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and reread it: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
