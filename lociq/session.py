"""Session settings and the shared scratch folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = 8, memory: str = "8g", app: str = "lociq", shared: str | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own.

    ``shared`` is the folder for stage tables, where the session has not got one of its own.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    A local master, where driver and executors are one process, gets a temporary folder if none
    is named; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lociq-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lociq/{name}-{uuid.uuid4().hex}"


def use_checkpoints(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder unless the session already has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


_SCOPE: ContextVar[list[str] | None] = ContextVar("stage tables to delete", default=None)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the stage tables that are written inside once the block is left, also by an error.

    For work whose results are written out inside the block, such as a batch of a stream.
    """
    token = _SCOPE.set([])
    try:
        yield
    finally:
        paths = _SCOPE.get()
        _SCOPE.reset(token)
        for path in paths:
            delete(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Used where a result feeds several steps: its lineage is not run again, lost executors do
    not take it along, and the table's real size is known to later joins.
    """
    path = scratch_path(df.sparkSession, name)
    if _SCOPE.get() is not None:
        _SCOPE.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a stage table that nothing reads any more."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def files_digest(spark: SparkSession, folder: str) -> str:
    """Digest of the files below ``folder``: their names, sizes and times, not their contents."""
    files, place = _file_system(spark, folder)
    found, listed = files.listFiles(place, True), []
    while found.hasNext():
        status = found.next()
        listed.append(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(listed)).encode()).hexdigest()


def kept_path(spark: SparkSession, name: str) -> str:
    """Where :func:`kept` puts ``name``."""
    return f"{shared_dir(spark).rstrip('/')}/lociq/{name}"


def kept(spark: SparkSession, name: str, build: Callable[[str], None]) -> str:
    """Path ``name`` below the shared folder, made by ``build(path)`` unless it is there.

    It is written under a fresh name and then moved into place, so a job that breaks off leaves
    nothing that looks whole, and of jobs that build the same thing at once the first one counts.
    ``name`` has to tell different contents apart, for instance by :func:`files_digest`.
    """
    path = kept_path(spark, name)
    if exists(spark, path):
        return path
    fresh = scratch_path(spark, "building")
    build(fresh)
    files, target = _file_system(spark, path)
    files.mkdirs(target.getParent())
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(fresh), target, no_options)
    except Exception:
        if not exists(spark, path):
            raise
        delete(spark, fresh)
    return path
