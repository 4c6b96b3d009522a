"""The module model: surfaces and dependencies of modules, from files, imports, re-exports and exports.

All tables carry tree; both trees are computed together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ENTRY_NAMES, EXTENSIONS, Config
from ..functions import paths
from ..storage import materialize
from .graph import follow_reexports


def resolve_imports(edges: DataFrame, files: DataFrame, workspace: DataFrame) -> DataFrame:
    """edges(tree, from_file, stmt_no, .., spec) with to_file: the first existing file that the specifier may mean.

    Relative specifiers join the importing file's directory; bare ones go through the longest workspace package name that
    starts them, source directory before package root. Unresolved ones keep a null.
    """
    wanted = edges.select("tree", "from_file", "spec").distinct()
    relative = wanted.where(F.col("spec").startswith("."))
    relative = relative.select("tree", "from_file", "spec", F.array(paths.join(paths.dirname(F.col("from_file")), F.col("spec"))).alias("bases"))
    bare = split_specifiers(wanted.where(~F.col("spec").startswith(".")), workspace)
    nested = F.array(paths.join(F.col("dir"), F.concat(F.lit("src/"), F.col("rest"))), paths.join(F.col("dir"), F.col("rest")))
    bare = bare.select("tree", "from_file", "spec", nested.alias("bases"))
    based = relative.unionByName(bare).select("tree", "from_file", "spec", F.posexplode("bases").alias("b", "base"))
    # the paths of source_candidates meet the files by what stands before the extension, a sixth of the rows
    tried = based.where(~F.col("base").startswith("..")).select("tree", "from_file", "spec", "b", F.posexplode(paths.source_stems(F.col("base"))).alias("c", "stem"))
    last = F.regexp_extract("file", r"\.[^./]*\z", 0)
    sources = files.select("tree", "file", last.alias("last")).where(F.col("last").isin(*EXTENSIONS))
    sources = sources.select("tree", F.expr("left(file, length(file) - length(last))").alias("stem"), "file", F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), F.col("last")).alias("e"))
    best = tried.join(sources, ["tree", "stem"]).groupBy("tree", "from_file", "spec").agg(F.min_by("file", F.struct("b", "c", "e")).alias("to_file"))
    return edges.drop("to_file").join(best, ["tree", "from_file", "spec"], "left")


def first_existing(tried: DataFrame, files: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """tried(tree, keys.., file, ..) to (keys.., to_file): the candidate of least rank that files(tree, file) holds."""
    hits = tried.join(files.select("tree", "file"), ["tree", "file"])
    return hits.groupBy(*keys).agg(F.min_by("file", rank).alias("to_file"))


def count_dependencies(uses: DataFrame, keys: list[str]) -> DataFrame:
    """uses(keys.., type_only), a row per use, to (keys.., count, type_only): type_only if all uses are."""
    return uses.groupBy(*keys).agg(F.count("*").alias("count"), F.bool_and("type_only").alias("type_only"))


def split_specifiers(specs: DataFrame, workspace: DataFrame) -> DataFrame:
    """specs(tree, spec, ..) with pkg, dir, rest for the longest package that is the specifier or its leading path.

    A specifier's leading paths are exploded, a handful each, so the join is on equal names and not on prefixes.
    """
    heads = specs.withColumn("pkg", F.explode(paths.ancestors(F.col("spec"))))
    found = heads.join(workspace.select("tree", "pkg", "dir"), ["tree", "pkg"])
    keys = specs.columns
    best = found.groupBy(*keys).agg(F.max_by(F.struct("pkg", "dir"), F.length("pkg")).alias("x"))
    rest = F.regexp_replace(F.expr("substr(spec, length(x.pkg) + 1)"), "^/", "")
    return best.select(*keys, "x.pkg", "x.dir", rest.alias("rest"))


def package_of(files: DataFrame, workspace: DataFrame) -> DataFrame:
    """(tree, file, pkg, dir) by the longest workspace directory that holds the file."""
    up = files.select("tree", "file", F.explode(paths.ancestors(F.col("file"))).alias("dir"))
    found = up.join(workspace.select("tree", "pkg", "dir"), ["tree", "dir"])
    return found.groupBy("tree", "file").agg(F.max_by(F.struct("dir", "pkg"), F.length("dir")).alias("x")).select("tree", "file", "x.pkg", "x.dir")


def nearest_config(directories: DataFrame, configs: DataFrame) -> DataFrame:
    """directories(tree, dir), configs(tree, dir of a tsconfig) to (tree, dir, config_dir): the deepest at or above, else '.'."""
    up = directories.select("tree", "dir", F.explode(paths.ancestors(F.col("dir"))).alias("config_dir"))
    found = up.join(configs.select("tree", F.col("dir").alias("config_dir")), ["tree", "config_dir"])
    best = found.groupBy("tree", "dir").agg(F.max_by("config_dir", F.length("config_dir")).alias("config_dir"))
    return directories.select("tree", "dir").join(best, ["tree", "dir"], "left").withColumn("config_dir", F.coalesce("config_dir", F.lit(".")))


@dataclass
class ModuleModel:
    module_of: DataFrame  # tree, file, module, is_test
    entries: DataFrame  # tree, module, entry
    declared: DataFrame  # tree, module, name, type_only, file
    bypassed: DataFrame  # tree, module, name
    used_by: DataFrame  # tree, module, name, by: null where only files outside all modules import it
    star_importers: DataFrame  # tree, module, by
    direct_deps: DataFrame  # tree, src, dst, count, type_only
    shapes: DataFrame  # tree, module, file_count, js_count, type_only


def assign_modules(files: DataFrame, config: Config) -> DataFrame:
    """(tree, file, module, is_test) of files in modules, written once: Spark would else take the condition on the module down to
    the rows that files are made of, and match the paths once for each of these."""
    module = paths.module_of(F.col("file"), config.modules)
    placed = files.select("tree", "file", module.alias("module"), paths.is_test_file(F.col("file"), config.test_files).alias("is_test"))
    return materialize(placed, "module-of").where("module is not null")


def module_shapes(files: DataFrame, exports: DataFrame, module_of: DataFrame) -> DataFrame:
    """(tree, module, file_count, js_count, type_only) over files that are no tests; a module without any is type-only.

    A module is type-only if all its exports are types and no text has function, class or =>.
    """
    types = exports.groupBy("tree", "file").agg(F.bool_and("type_only").alias("types"))
    code = F.coalesce(F.col("text").rlike(r"\b(function|class)\b|=>"), F.lit(False))
    plain = module_of.join(files.select("tree", "file", code.alias("code")), ["tree", "file"]).join(types, ["tree", "file"], "left")
    real = ~F.col("is_test")
    return plain.groupBy("tree", "module").agg(
        F.count(F.when(real, 1)).alias("file_count"),
        F.count(F.when(real & F.col("file").rlike(r"\.(js|jsx)$"), 1)).alias("js_count"),
        F.coalesce(F.bool_and(F.when(real, F.coalesce("types", F.lit(True)) & ~F.col("code"))), F.lit(True)).alias("type_only"),
    )


def build_model(files: DataFrame, imports: DataFrame, reexports: DataFrame, exports: DataFrame, config: Config = Config()) -> ModuleModel:
    """Imports and re-exports must be resolved (to_file)."""
    module_of = assign_modules(files, config)
    at = module_of.select("tree", "module", "file")
    entry_rank = F.array_position(F.array(*[F.lit(x) for x in ENTRY_NAMES]), F.regexp_extract("file", r"([^/]*)$", 1))
    in_root = module_of.where(paths.dirname(F.col("file")) == F.col("module")).withColumn("rank", entry_rank).where("rank > 0")
    entries = materialize(in_root.groupBy("tree", "module").agg(F.min_by("file", "rank").alias("entry")), "entries")

    # names that importers ask for and names that entries re-export, followed once
    named = imports.where("to_file is not null and name is not null")
    asked = named.where("name <> '*'").select("tree", F.col("to_file").alias("file"), "name")
    shown = reexports.join(entries.select("tree", F.col("entry").alias("from_file"), "module"), ["tree", "from_file"])
    asked = asked.unionByName(shown.where("not star and exported is not null").select("tree", F.col("from_file").alias("file"), F.col("exported").alias("name"))).distinct()
    origins = materialize(follow_reexports(exports, reexports, asked, config.reexport_depth).drop("chain"), "origins")

    # the declared surface of entries; later statements overwrite earlier ones, re-exports overwrite own exports
    direct = exports.join(entries.select("tree", F.col("entry").alias("file"), "module"), ["tree", "file"])
    declared = direct.select("tree", "module", "name", "type_only", "file", F.array(F.lit(0), F.col("line"), F.lit(0), F.lit(0)).alias("order"))
    renamed = shown.where("not star and exported is not null").join(origins.select("tree", F.col("file").alias("from_file"), F.col("name").alias("exported"), "origin_file"), ["tree", "from_file", "exported"], "left")
    declared = declared.unionByName(renamed.select("tree", "module", F.col("exported").alias("name"), "type_only", F.col("origin_file").alias("file"), F.array(F.lit(1), "stmt_no", F.lit(0), F.coalesce("pos", F.lit(0))).alias("order")))
    target = exports.select("tree", F.col("file").alias("to_file"), "name", F.col("type_only").alias("own_type"), F.col("line").alias("at_line"))
    starred = shown.where("star").join(target, ["tree", "to_file"])
    declared = declared.unionByName(starred.select("tree", "module", "name", (F.col("own_type") | F.col("type_only")).alias("type_only"), F.col("to_file").alias("file"), F.array(F.lit(1), "stmt_no", F.lit(1), "at_line").alias("order")))
    surface = declared.groupBy("tree", "module", "name").agg(F.max_by("type_only", "order").alias("type_only"), F.max_by("file", F.when(F.col("file").isNotNull(), F.col("order"))).alias("file"))

    # the used surface and the dependencies: every import in the tree counts, tests and files outside modules included
    at_from = module_of.select("tree", F.col("file").alias("from_file"), F.col("module").alias("by"))
    at_to = at.select("tree", F.col("file").alias("target"), "module")
    used = named.select("tree", "from_file", "to_file", "name", "type_only").join(origins.select("tree", F.col("file").alias("to_file"), "name", "origin_file", "origin_name"), ["tree", "to_file", "name"], "left")
    used = used.withColumn("target", F.coalesce("origin_file", "to_file")).join(at_to, ["tree", "target"]).join(at_from, ["tree", "from_file"], "left")
    used = materialize(used.where("by is null or by <> module").withColumn("key", F.coalesce("origin_name", "name")), "uses")
    star_importers = used.where("name = '*' and by is not null").select("tree", "module", "by").distinct()
    uses = used.where("name <> '*'").groupBy("tree", "module", F.col("key").alias("name"), "by").agg(F.min("origin_file").alias("seen_in"))
    used_by = uses.select("tree", "module", "name", "by")
    direct_deps = count_dependencies(used.where("by is not null").select("tree", F.col("by").alias("src"), F.col("module").alias("dst"), "type_only"), ["tree", "src", "dst"])

    # names used beside the surface: bypassed where there is an entry, the surface itself where there is none
    types = exports.join(at, ["tree", "file"]).join(module_of.where("not is_test").select("tree", "file"), ["tree", "file"], "left_semi")
    types = types.groupBy("tree", "module", "name").agg(F.min_by("type_only", F.struct("file", "line")).alias("own_type"))
    beside = uses.groupBy("tree", "module", "name").agg(F.min("seen_in").alias("file")).join(surface.select("tree", "module", "name"), ["tree", "module", "name"], "left_anti")
    beside = beside.join(types, ["tree", "module", "name"], "left").select("tree", "module", "name", F.coalesce("own_type", F.lit(False)).alias("type_only"), "file")
    bypassed = beside.join(entries, ["tree", "module"], "left_semi").select("tree", "module", "name")
    return ModuleModel(
        module_of=module_of,
        entries=entries,
        declared=materialize(surface.unionByName(beside), "declared"),
        bypassed=bypassed,
        used_by=used_by,
        star_importers=star_importers,
        direct_deps=materialize(direct_deps, "direct-deps"),
        shapes=module_shapes(files, exports, module_of),
    )


def barrels(statements: DataFrame) -> DataFrame:
    """statements(tree, file, is_import, is_reexport) to (tree, file, is_barrel): something besides imports, and only re-exports."""
    other = ~F.col("is_import")
    return statements.groupBy("tree", "file").agg((F.coalesce(F.bool_and(F.when(other, F.col("is_reexport"))), F.lit(False))).alias("is_barrel"))


def is_script(file: Column) -> Column:
    return file.rlike(r"\.(js|jsx|mjs|cjs)$")
