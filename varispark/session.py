"""Session helpers shared by every part of the library."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python workers then import it wherever the driver found it, so no file share
    between driver and executors is assumed.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(os.path.realpath(tempfile.mkdtemp(prefix="varispark-"))) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def release_memory() -> None:
    """Return freed memory to the system: a Python worker lives on while other stages need the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor shares.

    Where that setting is absent, a local folder is made and set if the driver is the
    only machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="varispark-ckpt-"))
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/varispark-{uuid.uuid4().hex}"


#: What ``materialise`` has written and not yet dropped, in order: folder, and table if it is one.
_WRITTEN: list[tuple[str, str | None]] = []


def materialise(df: DataFrame, buckets: int | None = None, key: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut there.

    With ``buckets`` the table is bucketed by ``key``, so that later joins and
    cogroups on that key move only their other side.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    writer = df.write.option("compression", "zstd")
    if buckets is None:
        writer.parquet(path)
        _WRITTEN.append((path, None))
        return spark.read.schema(df.schema).parquet(path)
    name = "varispark_" + path.rsplit("-", 1)[-1]
    writer.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    _WRITTEN.append((path, name))
    return spark.table(name)


def written() -> int:
    """How much ``materialise`` has written and not dropped; a mark for ``drop_written``."""
    return len(_WRITTEN)


def drop_written(spark: SparkSession, since: int = 0, keep_last: int = 0) -> None:
    """Drop what was written after the mark ``since`` but the last ``keep_last``; plans that read it can't run again."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep_last]
    del _WRITTEN[since : len(_WRITTEN) - keep_last]
    for path, table in gone:
        if table is not None:
            spark.sql(f"drop table if exists {table}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
