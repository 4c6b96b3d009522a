"""Line coverage from istanbul JSON and lcov reports; rows are (tree, file, line, hits)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import relative_to
from ..schemas import empty

_ISTANBUL = "map<string, struct<statementMap: map<string, struct<start: struct<line: int>, `end`: struct<line: int>>>, s: map<string, bigint>>>"


def istanbul_lines(reports: DataFrame, root: str = "/", partitions: int | None = None) -> DataFrame:
    """reports(tree, text), a JSON object each: a line has the most hits of the statements that span it.

    Statements are brought together by file before their lines are made, in so many partitions if given.
    """
    files = reports.select("tree", F.explode(F.from_json("text", _ISTANBUL)).alias("file", "x"))
    spans = files.select("tree", relative_to(root, F.col("file")).alias("file"), "x.s", F.explode("x.statementMap").alias("id", "at"))
    spans = spans.select("tree", "file", F.coalesce(F.element_at("s", F.col("id")), F.lit(0).cast("long")).alias("hits"), "at")
    spans = spans.repartition("file") if partitions is None else spans.repartition(partitions, "file")  # a tree may be a constant, which would deal the lines anew
    first = F.col("at.start.line")
    lines = spans.select("tree", "file", "hits", F.sequence(first, F.greatest(first, F.coalesce("at.end.line", first))).alias("span"))
    return lines.select("tree", "file", "hits", F.explode("span").alias("line")).groupBy("tree", "file", "line").agg(F.max("hits").alias("hits"))


def _lcov(records: DataFrame, root: str, partitions: int | None = None) -> DataFrame:
    """records(tree, report, at, record), each a file's name and the lines after it; at is its place in the report. Records meet by file, in so many partitions if given."""
    parts = F.split(F.regexp_replace("record", "^SF:", ""), "\r?\n")
    named = records.where(~F.col("record").rlike("^(?!SF:)[A-Z]+:")).select("tree", "report", "at", relative_to(root, F.trim(parts[0])).alias("file"), F.filter(parts, lambda x: x.startswith("DA:")).alias("lines"))
    named = named.repartition("file") if partitions is None else named.repartition(partitions, "file")
    # a file that is named again starts anew; of several reports the last one counts
    last = named.groupBy("tree", "report", "file").agg(F.max_by("lines", "at").alias("lines"))
    hits = last.select("tree", "report", "file", F.posexplode("lines").alias("pos", "line")).withColumn("v", F.split(F.expr("substr(line, 4)"), ","))
    line = F.trim(F.col("v")[0]).cast("int").alias("line")
    return hits.groupBy("tree", "file", line).agg(F.max_by(F.trim(F.col("v")[1]).cast("long"), F.struct("report", "pos")).alias("hits"))


def lcov_lines(reports: DataFrame, root: str = "/", partitions: int | None = None) -> DataFrame:
    """reports(tree, text): the last DA of a line wins, and a repeated SF replaces its file; what stands before the first SF is passed over."""
    numbered = reports.select("tree", F.monotonically_increasing_id().alias("report"), F.posexplode(F.split("text", "\nSF:")).alias("at", "record"))
    return _lcov(numbered, root, partitions)


def lcov_file(spark: SparkSession, path: str, tree: str, root: str = "/") -> DataFrame:
    """The lines of the report or reports at path, read by records: a large report is split over tasks.

    A record's place is its split's start in the file and its order there.
    """
    rows = spark.read.option("lineSep", "\nSF:").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return _lcov(rows.select(F.lit(tree).alias("tree"), F.col("_metadata.file_path").alias("report"), at.alias("at"), F.col("value").alias("record")), root)


def read_coverage(spark: SparkSession, path: str | None, tree: str, root: str = "/") -> tuple[str, DataFrame]:
    """(source, lines) of a report by its name; no path gives ('none', no lines)."""
    if not path:
        return "none", empty(spark, "coverage_lines")
    if not path.endswith(".json"):
        return "lcov", lcov_file(spark, path, tree, root)
    reports = spark.read.text(path, wholetext=True).select(F.lit(tree).alias("tree"), F.col("value").alias("text"))
    return "istanbul", istanbul_lines(reports, root)
