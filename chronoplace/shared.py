"""Working tables that every executor sees: written once, read back, deleted when nothing needs them any more."""

from __future__ import annotations

import contextlib
import hashlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_PARTITIONS = "spark.sql.shuffle.partitions"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session (as in tests) gets one of its own; on a cluster that is an error, because a
    folder of the driver's machine can't be read by executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="chronoplace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/chronoplace/{what}-{uuid.uuid4().hex}"


_LOCK, _HELD = threading.Lock(), {}


@contextlib.contextmanager
def cleaning(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """For writes inside: a job's shuffle files go with it, and it is dealt into so many partitions if asked to.

    Writes of several threads may overlap; the last to end gives the setting its old value.
    """
    key = id(spark._jsparkSession)
    with _LOCK:
        n, before = _HELD.get(key, (0, spark.conf.get(_CLEANUP, None)))
        _HELD[key] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    dealt = spark.conf.get(_PARTITIONS) if partitions else None
    if partitions:
        spark.conf.set(_PARTITIONS, str(partitions))
    try:
        yield
    finally:
        if dealt:
            spark.conf.set(_PARTITIONS, dealt)
        with _LOCK:
            n, before = _HELD.pop(key)
            if n > 1:
                _HELD[key] = n - 1, before
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: str | None) -> Iterator[None]:
    """For writes inside: Python functions get Arrow batches of about so many bytes, whatever the session's setting (64 MB, if unset)."""
    if not size:
        yield
        return
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def materialise(df: DataFrame, what: str, codec: str = "zstd", batch: str | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back; batch: as for `batches_of`."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    with cleaning(spark), batches_of(spark, batch):
        # another DataFrame over the same plan, so that its execution takes up the setting
        df.select("*").write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chronoplace_path = path
    return out


def bucketed(df: DataFrame, what: str, key: str, n: int, codec: str = "zstd") -> DataFrame:
    """As `materialise`, in n buckets of a key: rows are dealt when they are written, so a join on the key needn't shuffle them."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    name = f"chronoplace_{path.rpartition('-')[2]}"
    with cleaning(spark):
        df.select("*").write.bucketBy(n, key).option("path", path).option("compression", codec).saveAsTable(name)
    out = spark.table(name)
    out._chronoplace_path = path
    spark.sql(f"DROP TABLE {name}")  # the name only: files stay, and out has found them
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what `materialise` wrote for these; nothing may read them afterwards."""
    for df in tables:
        remove(df.sparkSession, df._chronoplace_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of ours through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in its terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = filesystem(spark, path)
    return fs.exists(at)


def version(df: DataFrame) -> str:
    """Names the state of the files that df reads: it changes when one is added, removed or written again."""
    parts = []
    for file in sorted(df.inputFiles()):
        fs, at = filesystem(df.sparkSession, file)
        status = fs.getFileStatus(at)
        parts.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()
