"""Results kept as Parquet under a key, and read again instead of being computed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def cached(folder: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Decorate f(spark, *args, **kw): its result is written below ``folder``, by name and arguments, at the first call.

    Arguments must be plain values, as they make the key. A result counts from when it is
    complete, so a call that failed is computed again. ``folder`` must be one that all
    machines share.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, *args, **kw) -> DataFrame:
            key = hashlib.sha256(json.dumps([args, kw], sort_keys=True).encode()).hexdigest()[:24]
            path = f"{folder.rstrip('/')}/{f.__name__}-{key}"
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
                f(spark, *args, **kw).write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        return run

    return wrap
