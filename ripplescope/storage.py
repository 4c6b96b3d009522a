"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
_cleaned: set[str] = set()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
        _own_roots[app] = tempfile.mkdtemp(prefix="ripplescope-")
    return _own_roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder goes with the cluster's own clean-up
        pass


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, plans that start hand Python workers at most so many rows at a time: whole texts make large batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it again: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    base = f"{checkpoint_root(spark)}/ripplescope-{spark.sparkContext.applicationId}"
    if base not in _cleaned:
        _cleaned.add(base)
        atexit.register(_remove, spark, base)
    path = f"{base}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
