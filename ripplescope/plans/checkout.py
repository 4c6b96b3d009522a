"""The fact tables of two checkouts, from their files to the calls, ready for the two-snapshot report."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.modules import assign_modules, resolve_imports
from ..schemas import empty
from ..sources import coverage, lexical, trees
from ..sources.program import scan_program
from ..storage import materialize


def checkout_tables(spark: SparkSession, roots: Mapping[str, str], changes: DataFrame, config: Config = Config(), reports: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """roots: the folders of 'base' and 'head'; changes(value): status lines; reports: a coverage report of a tree, by its name.

    Every table of schemas.TABLES is there. Imports are followed over relative paths and the packages of the workspace; files
    outside all modules are read for their imports only, so their calls and functions play no part.
    """
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    files = materialize(union([trees.read_tree(spark, root, tree, config) for tree, root in roots.items()]).withColumn("is_barrel", F.lit(False)), "files")
    workspace = materialize(trees.workspace_packages(union([trees.read_manifests(spark, root, tree) for tree, root in roots.items()])), "workspace")
    imports, reexports = [materialize(resolve_imports(scan(files), files, workspace), "edges") for scan in (lexical.imports, lexical.reexports)]
    exports = materialize(lexical.exports(files), "exports")
    inside = files.join(assign_modules(files, config).select("tree", "file"), ["tree", "file"], "left_semi")
    program = scan_program(inside, imports, reexports, exports, config.reexport_depth)
    provided = trees.provided_symbols(files, config)
    given = reports or {}
    return {
        "files": files, "imports": imports, "reexports": reexports, "exports": exports, "workspace": workspace, "functions": program.functions, "calls": program.calls, "call_stops": program.call_stops,
        "decl_seeds": program.decl_seeds, "matches": trees.effect_matches(files, config), "provided": empty(spark, "provided") if provided is None else provided,
        "coverage_lines": union([coverage.read_coverage(spark, given.get(tree), tree, root)[1] for tree, root in roots.items()]), "change_set": trees.change_set(changes),
    }
