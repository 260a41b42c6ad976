"""Dump files as they came (SRC-18, without the download): checksums and a manifest. Spark reads gzip and bzip2 itself."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are read at once; files may be of any size.
PIECE = 1 << 20


def checksums(spark: SparkSession, paths: list[str], algorithm: str = "sha1") -> DataFrame:
    """path, n_bytes and digest of each file, a task for each; files are read through Arrow's file systems, piece by piece."""
    hashlib.new(algorithm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
                digest, n = hashlib.new(algorithm), 0
                with store.open_input_file(at) as file:
                    while piece := file.read(PIECE):
                        digest.update(piece)
                        n += len(piece)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([digest.hexdigest()])], ["path", "n_bytes", "digest"])

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return rows.mapInArrow(run, "path string, n_bytes long, digest string")


def verify(spark: SparkSession, wanted: Mapping[str, str], algorithm: str = "sha1") -> DataFrame:
    """The manifest of the files of wanted (path to digest); an error that names those that differ."""
    rows = checksums(spark, list(wanted), algorithm)
    bad = sorted(r.path for r in rows.collect() if r.digest != wanted[r.path].lower())
    if bad:
        raise ValueError(f"{algorithm} differs: {bad}")
    return rows
