"""Folders of results that a query writes and reads again, in the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import gzip as gz
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a local temporary folder only where that is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="strandlake-")
    return f"{base.rstrip('/')}/strandlake-{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_named_text(df: DataFrame, path: str, name: str, header: str | None = None, gzip: bool = False, extension: str = "") -> None:
    """Lines (``name`` column and value) as one text file a name, called by it; names are few (chromosomes).

    Tasks write a part a name each, without a shuffle; the file system copies header and parts, one after the other, into the file.
    """
    spark, work = df.sparkSession, path + "-parts"
    df.select(name, "value").write.mode("overwrite").partitionBy(name).option("compression", "gzip" if gzip else "none").text(work)
    fs, Path = _fs(spark, work)
    fs.mkdirs(Path(path))
    for folder in fs.listStatus(Path(work)):
        called = folder.getPath().getName()
        if "=" not in called:
            continue
        out = fs.create(Path(f"{path}/{called.split('=', 1)[1]}{extension}"), True)
        if header is not None:
            line = f"{header}\n".encode()
            out.write(bytearray(gz.compress(line) if gzip else line))
        for part in _parts(fs, folder.getPath()):
            data = fs.open(part.getPath())
            spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(data, out)
            data.close()
        out.close()
    fs.delete(Path(work), True)


def _parts(fs, folder) -> list:
    """Part files of a folder that Spark wrote, in order."""
    return sorted((x for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")), key=lambda x: x.getPath().getName())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file."""
    fs, Path = _fs(spark, path)
    out = fs.create(Path(path), True)
    out.write(bytearray(data))
    out.close()


def write_byte_files(df: DataFrame, path: str, extension: str = "") -> None:
    """A binary column as one file a row, numbered in the order of the frame.

    Tasks write their rows as text of length, bytes and line end; the driver's file system copies the bytes from there, none of which it holds.
    """
    spark, work = df.sparkSession, path + "-parts"
    (content,) = df.columns
    length = F.unhex(F.lpad(F.hex(F.length(content).cast("long")), 16, "0"))
    df.select(F.concat(length, content).cast("string").alias("value")).write.mode("overwrite").option("compression", "none").text(work)
    fs, Path = _fs(spark, work)
    jvm, k = spark.sparkContext._jvm, 0
    for part in _parts(fs, Path(work)):
        data, at = jvm.java.io.DataInputStream(fs.open(part.getPath())), 0
        while at < part.getLen():
            n = data.readLong()
            out = fs.create(Path(f"{path}/part-{k:07d}{extension}"), True)
            jvm.org.apache.commons.io.IOUtils.copyLarge(data, out, 0, n)
            out.close()
            data.read()
            at, k = at + 8 + n + 1, k + 1
        data.close()
    fs.delete(Path(work), True)
