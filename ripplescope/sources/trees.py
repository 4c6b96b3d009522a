"""Source trees, workspaces, change sets and matches of patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXTENSIONS, PACKAGE_ROOTS, SKIPPED_DIRECTORIES, Config
from ..functions import paths
from .patterns import Pattern, structural_matches


def kept_files(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Rows whose path (file) is a source: a known extension, no .d.ts, no dot or skipped directory, no excluded path above it."""
    segments = F.split("file", "/")
    hidden = F.exists(segments, lambda s: s.startswith(".") | s.isin(*SKIPPED_DIRECTORIES))
    excluded = F.exists(paths.ancestors(F.col("file")), lambda d: d.isin(*config.exclude))
    return files.where(paths.extension(F.col("file")).isin(*EXTENSIONS) & ~F.col("file").endswith(".d.ts") & ~hidden & ~excluded)


def _contents(spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    """(file, content) below a folder; names are never read as patterns, whatever brackets, braces or stars they hold."""
    plain = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    inner = F.expr(f"substr(plain, {len(re.sub('^[A-Za-z][A-Za-z0-9+.-]*:/+', '/', root).rstrip('/')) + 2})").alias("file")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (reader if only is None else reader.option("pathGlobFilter", only)).load(re.sub(r"([\\\[\]{}*?])", r"\\\1", root))
    return found.select(plain.alias("plain"), "content").select(inner, "content")


def read_tree(spark: SparkSession, root: str, tree: str, config: Config = Config()) -> DataFrame:
    """files(tree, file, is_js, text) of a checkout, by one scan of the folder.

    A file's path decides before its content is decoded, and no list of paths passes the driver.
    """
    read = kept_files(_contents(spark, root), config)
    return read.select(F.lit(tree).alias("tree"), "file", F.col("file").rlike(r"\.(js|jsx|mjs|cjs)$").alias("is_js"), F.decode("content", "UTF-8").alias("text"))


def read_manifests(spark: SparkSession, root: str, tree: str) -> DataFrame:
    """manifests(tree, file, text) of a checkout, for workspace_packages."""
    return _contents(spark, root, "package.json").select(F.lit(tree).alias("tree"), "file", F.decode("content", "UTF-8").alias("text"))


def workspace_packages(manifests: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """(tree, pkg, dir): build tasks(tree, pkg, dir) first, then package.json texts manifests(tree, file, text).

    Manifests count one or two levels below the package roots, not under node_modules; of one name the first root, then the
    shallower, then the smaller path wins; broken JSON is passed over.
    """
    directory = paths.dirname(F.col("file"))
    rows = manifests.where(F.col("file").endswith("/package.json")).select("tree", directory.alias("dir"), F.get_json_object("text", "$.name").alias("pkg"))
    rank = F.lit(None).cast("int")
    for i, root in reversed([*enumerate(PACKAGE_ROOTS)]):
        rank = F.when(F.col("dir").rlike(f"^{root}/[^/]+(/(?!node_modules$)[^/]+)?$"), i).otherwise(rank)
    found = rows.where("pkg is not null and pkg <> ''").select("tree", "pkg", "dir", F.struct((rank + 1).alias("rank"), F.regexp_extract("dir", "^((?:ee/)?[^/]+/[^/]+)", 1).alias("top"), F.length("dir").alias("n"), F.col("dir").alias("at")).alias("order")).where("order.rank is not null")
    if tasks is not None:
        first = tasks.select("tree", "pkg", "dir", F.struct(F.lit(0).alias("rank"), F.lit("").alias("top"), F.lit(0).alias("n"), F.col("dir").alias("at")).alias("order"))
        found = found.unionByName(first)
    return found.groupBy("tree", "pkg").agg(F.min_by("dir", "order").alias("dir"))


def change_set(lines: DataFrame) -> DataFrame:
    """lines(value), 'status<TAB>path[<TAB>new path]' each, to (path, status, renamed_from)."""
    v = F.split("value", "\t")
    renamed = v[0].startswith("R")
    second = F.get(v, F.lit(1))
    return lines.where(F.size(v) >= 2).select(F.when(renamed, F.get(v, F.lit(2))).otherwise(second).alias("path"), F.substring(v[0], 1, 1).alias("status"), F.when(renamed, second).alias("renamed_from"))


def source_lines(files: DataFrame) -> DataFrame:
    """(tree, file, line, text), lines from 1."""
    return files.select("tree", "file", F.posexplode(F.split("text", "\r?\n")).alias("line", "text")).select("tree", "file", (F.col("line") + 1).alias("line"), "text")


def effect_matches(files: DataFrame, config: Config = Config()) -> DataFrame:
    """matches(tree, category, file, line, end_line): one row per category and place that one of its patterns hits."""
    found = []
    if config.effects:
        met = structural_matches(files, [Pattern(category, p) for category, patterns in config.effects.items() for p in patterns])
        found.append(met.select("tree", F.col("key").alias("category"), "file", "line", "end_line").distinct())
    if config.effect_lines or not found:
        hit = [F.when(F.col("text").rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(category)) for category, patterns in config.effect_lines.items()]
        lines = source_lines(files).select("tree", "file", "line", F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *hit))).alias("category"))
        found.append(lines.select("tree", "category", "file", "line", F.col("line").alias("end_line")))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct()


def _below(roots: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col("file").startswith(root.rstrip("/") + "/") for root in roots]) if roots else F.lit(True)


def provided_symbols(files: DataFrame, config: Config = Config()) -> DataFrame:
    """provided(tree, provider, file, line, name): named matches of the providers' patterns under their roots."""
    lines, rows = source_lines(files), []
    for p in config.providers:
        if p.name_var is None:
            found = lines.select("tree", "file", "line", F.regexp_extract("text", p.pattern, 1).alias("name"))
        else:
            found = structural_matches(files.where(_below(p.roots)), [Pattern(p.name, p.pattern, p.name_var)])
        rows.append(found.where(_below(p.roots) & (F.col("name") != "")).select("tree", F.lit(p.name).alias("provider"), "file", "line", "name"))
    return reduce(DataFrame.unionByName, rows) if rows else None
