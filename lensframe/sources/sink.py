"""Files and folders on whatever file system the cluster shares: bytes written through Hadoop, lines written in order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lensframe.session import checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_bytes(spark: SparkSession, path: str, content: bytes) -> str:
    """A file with the given content; returns its path."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def write_lines(lines: DataFrame, path: str, part: str, order: list[str], line: str = "line") -> str:
    """A text file per value of ``part`` in ``path``, its lines in order: a part is sorted where it is written."""
    lines.repartition(part).sortWithinPartitions(part, *order).select(part, line).write.partitionBy(part).text(path)
    return path
