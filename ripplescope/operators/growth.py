"""Programs that grow with what is reached in them: built declarations lead to sources, which are loaded with what they import."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..storage import materialize
from .graph import bfs
from .modules import first_existing, split_specifiers

#: Times that a program is loaded further.
GROWTH_ROUNDS = 3  # fixed value


@dataclass
class Growth:
    loaded: DataFrame  # keys.., file, round: 0 if it is there from the start
    reached: DataFrame  # keys.., seed, fn, round
    pending: DataFrame  # keys.., file: sources that are still wanted after the last round


def built_sources(built: DataFrame, files: DataFrame, workspace: DataFrame) -> DataFrame:
    """built(tree, file), files(tree, file), workspace(tree, pkg, dir) to (tree, file, source): the file that a built one is made of.

    A path below node_modules means the workspace package that its last such segment names. dist stands for src; an installed
    file without a source there is looked up as its package's specifier would be, src before the package's root. Sources exist
    and are neither the file itself nor declarations; built files without one have no row, and null paths play no part.
    """
    built = built.where("file is not null").select("tree", "file").distinct()
    plain = built.where(~F.col("file").contains("node_modules/")).select("tree", "file", F.posexplode(paths.dist_to_source(F.col("file"))).alias("c", "source")).withColumn("b", F.lit(0))
    installed = split_specifiers(built.where(F.col("file").contains("node_modules/")).withColumn("spec", paths.last_module_path(F.col("file"))), workspace)
    placed = installed.select("tree", "file", "dir", "rest", paths.join(F.col("dir"), F.col("rest")).alias("path"))
    direct = placed.select("tree", "file", F.posexplode(paths.dist_to_source(F.col("path"))).alias("c", "source")).withColumn("b", F.lit(0))
    bare = F.regexp_replace(F.regexp_replace(F.col("rest"), r"\.d\.ts$|\.(ts|tsx|js|jsx|mjs|cjs)$", ""), r"(^|/)dist/", "$1")
    bases = placed.select("tree", "file", F.posexplode(F.array(paths.join(F.col("dir"), F.concat(F.lit("src/"), bare)), paths.join(F.col("dir"), bare))).alias("b", "base"))
    named = bases.select("tree", "file", (F.col("b") + 1).alias("b"), F.posexplode(paths.source_candidates(F.col("base"))).alias("c", "source"))
    tried = reduce(DataFrame.unionByName, (plain, direct, named)).where((F.col("source") != F.col("file")) & ~F.col("source").endswith(".d.ts"))
    tried = tried.select("tree", F.col("file").alias("built"), F.col("source").alias("file"), "b", "c")
    return first_existing(tried, files, ["tree", "built"], F.struct("b", "c")).select("tree", F.col("built").alias("file"), F.col("to_file").alias("source"))


def grow(
    seeds: DataFrame, calls: DataFrame, built_calls: DataFrame, sources: DataFrame, declared: DataFrame, loaded: DataFrame, imports: DataFrame, rounds: int = GROWTH_ROUNDS, keys: Sequence[str] = ("tree",)
) -> Growth:
    """What seeds reach in a program that is loaded further where they meet built declarations.

    seeds(keys.., seed, fn); calls(keys.., src, dst) between functions; built_calls(keys.., src, file, name): calls that end at a
    name of a built file; sources(keys.., file, source) of built files; declared(keys.., file, name, fn): functions that a name of
    a source stands for; loaded(keys.., file) at the start; imports(keys.., src, dst) between files. Seeds of one key share its program.

    A built call leads on where its source is loaded; another one asks for it. A round loads what was asked for, with all that
    it imports, and goes on from the calls which that has opened. So a round searches from new files and new functions only, and
    comes to the same as a search of the larger program from its start. Rows with nulls play no part, repeated rows count once.
    """
    keys = [*keys]
    file_keys, fn_keys = [*keys, "file"], [*keys, "seed", "fn"]
    asks = materialize(built_calls.join(sources, file_keys).select(*keys, "src", "source", "name").na.drop().distinct(), "asks")
    opens = materialize(asks.join(declared.select(*keys, F.col("file").alias("source"), "name", F.col("fn").alias("dst")), [*keys, "source", "name"]).select(*keys, "src", "dst", F.col("source").alias("file")).na.drop().distinct(), "opens")
    imports, calls = [materialize(edges.select(*keys, "src", "dst").distinct(), "given") for edges in (imports, calls)]

    def load(wanted: DataFrame, known: DataFrame | None) -> DataFrame:
        one = lambda df: df.select(*keys, F.lit(0).alias("seed"), F.col("file").alias("node"))
        return materialize(bfs(imports, one(wanted), keys=keys, known=None if known is None else one(known)).select(*keys, F.col("node").alias("file")), "loaded")

    def search(edges: DataFrame, start: DataFrame, known: DataFrame | None) -> DataFrame:
        nodes = lambda df: df.select(*keys, "seed", F.col("fn").alias("node"))
        return materialize(bfs(edges, nodes(start), keys=keys, known=None if known is None else nodes(known)).select(*keys, "seed", F.col("node").alias("fn")), "reached")

    def asked(new: DataFrame, held: DataFrame) -> DataFrame:
        """Sources that the functions reached last want; those reached before have theirs."""
        callers = new.select(*keys, F.col("fn").alias("src")).distinct()
        return materialize(asks.join(callers, [*keys, "src"], "left_semi").select(*keys, F.col("source").alias("file")).distinct().join(held, file_keys, "left_anti"), "pending")

    held = load(loaded.select(*file_keys).na.drop().distinct(), None)
    edges = calls.unionByName(opens.join(held, file_keys, "left_semi").drop("file"))
    reached = search(edges, seeds.select(*fn_keys).na.drop().distinct(), None)
    files, functions = [held.withColumn("round", F.lit(0))], [reached.withColumn("round", F.lit(0))]
    pending = asked(reached, held)
    for turn in range(1, rounds + 1):
        if pending.isEmpty():
            break
        came = load(pending, held)
        opened = opens.join(came, file_keys, "left_semi").drop("file")
        edges = edges.unionByName(opened)
        ahead = reached.withColumnRenamed("fn", "src").join(opened, [*keys, "src"]).select(*keys, "seed", F.col("dst").alias("fn")).distinct()
        new = search(edges, ahead, reached)
        held, reached = held.unionByName(came), reached.unionByName(new)
        files.append(came.withColumn("round", F.lit(turn)))
        functions.append(new.withColumn("round", F.lit(turn)))
        pending = asked(new, held)
    return Growth(reduce(DataFrame.unionByName, files), reduce(DataFrame.unionByName, functions), pending)
