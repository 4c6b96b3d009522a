"""Helpers shared by the operators of this subpackage: intermediate tables in the shared folder, row keys, Arrow batches."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize

#: Up to so many files, row keys number the files by a literal map; a plan that reads more is written to the shared folder first.
MAP_FILES = 4_096


def _file_and_row(df: DataFrame) -> DataFrame | None:
    """df with the file and the place in it of each row, if df is a projection or filter of one table of files."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.collectLeaves().size() != 1 or any(kind in plan.toString() for kind in ("Generate", "Join", "Union", "Expand", "MapInArrow", "MapInPandas")):
        return None
    try:
        return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return None


def row_keyed(df: DataFrame, name: str = "__row") -> DataFrame:
    """df with a unique long per row that is the same in every job, however files are split: a row's file and place in it.

    Files are numbered in the order of their names; the number is in the high bits. A plan that is not a projection or filter
    of stored files is written to the shared folder first.
    """
    placed = _file_and_row(df)
    files = sorted(df.inputFiles()) if placed is not None else []
    if placed is None or len(files) > MAP_FILES:
        df = materialize(df if placed is None else df.coalesce(MAP_FILES), "rows")
        placed, files = _file_and_row(df), sorted(df.inputFiles())
    if not files:
        return df.withColumn(name, F.lit(0).cast("long"))
    # the two lists of names differ in the slashes after a scheme without a host
    plain = F.regexp_replace("__file", "^([A-Za-z][A-Za-z0-9+.-]*):/+(?=[^/])", "$1:/")
    numbers = {re.sub("^([A-Za-z][A-Za-z0-9+.-]*):/+(?=[^/])", r"\1:/", f): i for i, f in enumerate(files)}
    found = F.create_map(*[F.lit(x) for item in numbers.items() for x in item])[plain]
    number = F.lit(0) if len(files) == 1 else F.coalesce(found, F.raise_error(F.concat(F.lit("not an input file: "), "__file")).cast("int"))
    return placed.withColumn(name, number.cast("long") * (1 << 40) + F.col("__at")).drop("__file", "__at")


def release() -> None:
    """Give freed memory of this Python worker back to the machine: it serves other operators too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_bytes(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary").alias("text")


def crc32_remainder(column: str, modulus: int) -> Column:
    """crc32 of a column's text, modulo; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


__all__ = ["crc32_remainder", "documents", "materialize", "release", "row_keyed", "text_bytes"]
