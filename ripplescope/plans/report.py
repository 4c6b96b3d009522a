"""The two-snapshot report: change set to touched modules, facts of both trees, deltas, blast radius."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import locale_order
from ..operators.delta import module_delta, renamed_modules, symbol_delta, touched_modules
from ..operators.facts import Facts, module_facts
from ..operators.graph import blast_radius, indirect_deps
from ..operators.modules import ModuleModel, build_model, resolve_imports
from ..storage import materialize


@dataclass
class Report:
    touched: DataFrame
    renamed: DataFrame
    modules: DataFrame
    symbols: DataFrame
    dependents_of_touched: DataFrame
    model: ModuleModel
    facts: Facts


def build_report(tables: dict[str, DataFrame], config: Config = Config()) -> Report:
    """tables by the names of schemas.TABLES, both trees in each; to_file of imports and re-exports is resolved here.

    The facts of tier two (functions, calls, stops, seeds) are read for touched modules only.
    """
    files = tables["files"]
    imports, reexports = [materialize(resolve_imports(tables[t], files, tables["workspace"]), t) for t in ("imports", "reexports")]
    model = build_model(files, imports, reexports, tables["exports"], config)
    touched = materialize(touched_modules(tables["change_set"], config.modules), "touched")
    facts = module_facts(model, tables["functions"], tables["calls"], tables["call_stops"], tables["decl_seeds"], tables["matches"], tables["provided"], tables["coverage_lines"], touched)
    side = lambda t: facts.symbols.where(F.col("tree") == t).drop("tree")
    head = model.direct_deps.where("tree = 'head'").select("src", "dst")
    return Report(
        touched=touched,
        renamed=renamed_modules(tables["change_set"], config.modules),
        modules=module_delta(touched, facts.modules, facts.symbols, model.direct_deps),
        symbols=symbol_delta(side("base"), side("head"), ["module", "name"]),
        dependents_of_touched=blast_radius(head, touched.withColumnRenamed("module", "node")).withColumnRenamed("node", "module"),
        model=model,
        facts=facts,
    )


def module_models(model: ModuleModel, facts: Facts) -> DataFrame:
    """One nested row per tree and module: facts, boundary, direct and indirect dependencies, dependents."""
    # the most complex first, names without a function as zero, then by name as readers sort
    rank = -F.coalesce("complexity", F.lit(0))
    shown = F.struct(rank.alias("rank"), locale_order(F.col("name")).alias("order"), "name", "provider", "file", "type_only", "used_by", "complexity", "stops", "effects", "coverage")
    boundary = facts.symbols.groupBy("tree", "module").agg(F.transform(F.sort_array(F.collect_list(shown)), lambda s: s.dropFields("order")).alias("symbols"))
    direct = model.direct_deps.groupBy("tree", F.col("src").alias("module")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("module"), "type_only", "count"))).alias("direct"))
    far = indirect_deps(model.direct_deps.select("tree", "src", "dst"), keys=["tree"]).groupBy("tree", F.col("src").alias("module")).agg(F.sort_array(F.collect_list(F.struct("hops", F.col("dst").alias("module")))).alias("indirect"))
    near = model.direct_deps.groupBy("tree", F.col("dst").alias("module")).agg(F.sort_array(F.collect_set("src")).alias("dependents"))
    out = facts.modules
    for part in (boundary, direct, far, near):
        out = out.join(part, ["tree", "module"], "left")
    return out
