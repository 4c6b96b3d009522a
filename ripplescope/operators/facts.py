"""Facts of boundary symbols and modules: complexity, stops, effects, coverage, confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import JS_WEIGHT, STOP_WEIGHT
from ..functions.text import confidence
from ..storage import materialize
from .graph import closure
from .modules import ModuleModel
from .ranges import containing, innermost, line_coverage


def function_counts(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """Own and inline complexity of functions.

    nodes(tree, owner, decision): decision points by the function whose body holds them; functions(tree, fn_id, parent,
    anonymous). own is 1 and the function's own decisions; inline sums the decisions of the anonymous functions directly
    inside, and so on down. Returns (tree, fn_id, own, inline, unit_id): unit_id is the function that counts it, the nearest
    at or above that is not an anonymous one inside another.
    """
    own = nodes.where("decision").groupBy("tree", F.col("owner").alias("fn_id")).agg(F.count("*").alias("n"))
    counted = functions.join(own, ["tree", "fn_id"], "left").select("tree", "fn_id", "parent", "anonymous", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("own"))
    up = counted.where("anonymous and parent is not null").select("tree", F.col("fn_id").alias("src"), F.col("parent").alias("dst"))
    hosts = closure(up, counted.select("tree", F.col("fn_id").alias("seed"), F.col("fn_id").alias("node")), ["tree"])
    inner = hosts.where("seed <> node").join(counted.select("tree", F.col("fn_id").alias("seed"), "own"), ["tree", "seed"])
    inline = inner.groupBy("tree", F.col("node").alias("fn_id")).agg(F.sum(F.col("own") - 1).cast("int").alias("inline"))
    climbing = up.select("tree", F.col("src").alias("node"))
    tops = hosts.join(climbing, ["tree", "node"], "left_anti").select("tree", F.col("seed").alias("fn_id"), F.col("node").alias("unit_id"))
    return counted.join(inline, ["tree", "fn_id"], "left").join(tops, ["tree", "fn_id"], "left").select("tree", "fn_id", "own", F.coalesce("inline", F.lit(0)).alias("inline"), F.coalesce("unit_id", "fn_id").alias("unit_id"))


@dataclass
class Facts:
    symbols: DataFrame
    modules: DataFrame
    reached: DataFrame  # tree, module, name, fn_id
    stops: DataFrame  # tree, module, reason, count


def module_facts(model: ModuleModel, functions: DataFrame, calls: DataFrame, call_stops: DataFrame, decl_seeds: DataFrame, matches: DataFrame, provided: DataFrame, coverage: DataFrame, touched: DataFrame | None = None) -> Facts:
    """symbol and module facts; touched(module) limits the work to those modules before any closure starts.

    A call to a function outside the symbol's module is the module's edge. A stop counts if it is unresolved or dynamic, or
    if its declaration lies in the module. Type-only, unresolved and constant symbols have complexity 0.
    """
    within = (lambda df: df.join(touched, "module", "left_semi")) if touched is not None else (lambda df: df)
    key = ["tree", "module", "name"]
    declared = within(model.declared)
    files = within(model.module_of.where("not is_test").select("tree", "file", "module"))
    fns = materialize(functions.join(files, ["tree", "file"]).select("tree", "module", "fn_id", "file", "start", "end", (F.col("own") + F.col("inline")).alias("count")), "functions")
    of = fns.select("tree", "module", "fn_id")

    # seeds by declaring file, or by any file of the module where that is unknown
    value = declared.where("not type_only").select(*key, F.col("file").alias("in_file"))
    known = decl_seeds.join(files, ["tree", "file"]).select("tree", "module", "name", "file", "fn_id")
    seeds = value.join(known, key).where("in_file is null or file = in_file").select(*key, "fn_id")
    inside = calls.join(of.withColumnRenamed("fn_id", "from_fn"), ["tree", "from_fn"]).join(of.withColumnRenamed("fn_id", "to_fn"), ["tree", "module", "to_fn"])
    edges = inside.select("tree", "module", F.col("from_fn").alias("src"), F.col("to_fn").alias("dst"))
    start = seeds.where("fn_id is not null").join(of, ["tree", "module", "fn_id"]).select("tree", "module", F.col("name").alias("seed"), F.col("fn_id").alias("node"))
    reached = materialize(closure(edges, start, ["tree", "module"]).select("tree", "module", F.col("seed").alias("name"), F.col("node").alias("fn_id")), "reached")

    # stops: those of reached functions, and one for each value symbol without a declaration
    at_stop = files.select("tree", F.col("file").alias("decl_file"), F.col("module").alias("decl_module"))
    met = reached.join(call_stops.select("tree", F.col("from_fn").alias("fn_id"), "reason", "decl_file"), ["tree", "fn_id"]).join(at_stop, ["tree", "decl_file"], "left")
    met = met.where("reason in ('unresolved', 'dynamic') or decl_module = module").select(*key, "reason")
    lost = value.join(seeds.select(*key).distinct(), key, "left_anti").select(*key, F.lit("unresolved").alias("reason"))
    symbol_stops = met.unionByName(lost)
    js = within(model.shapes).where("js_count > 0").select("tree", "module", F.lit("javascript").alias("reason"), F.col("js_count").alias("count"))
    stops = symbol_stops.groupBy("tree", "module", "reason").agg(F.count("*").alias("count")).unionByName(js)

    # effects sit on the innermost function around a match
    ids = ["tree", "category", "file", "line"]
    sited = innermost(matches.select(*ids).distinct(), fns, ["tree", "file"], ids, "fn_id").select("tree", "category", "fn_id").distinct()
    effects = reached.join(sited, ["tree", "fn_id"]).groupBy(*key).agg(F.array_sort(F.collect_set("category")).alias("effects"))
    sums = reached.join(fns.select("tree", "module", "fn_id", "count", "file", "start", "end"), ["tree", "module", "fn_id"])
    complexity = sums.groupBy(*key).agg(F.sum("count").alias("complexity"), F.count("*").alias("reach"))
    covered = line_coverage(sums.select(*key, "file", "start", "end"), coverage, ["tree", "file"], key).select(*key, F.col("value").alias("coverage"))
    listed = symbol_stops.groupBy(*key).agg(F.array_sort(F.collect_set("reason")).alias("stops"))

    # symbols of providers: all functions around the match count
    sites = within(provided.join(files, ["tree", "file"]))
    around = containing(sites, fns.drop("module"), ["tree", "file"])
    route = around.join(sited.groupBy("tree", "fn_id").agg(F.collect_set("category").alias("c")), ["tree", "fn_id"], "left")
    route = route.groupBy(*key).agg(F.sum("count").alias("complexity"), F.count("*").alias("reach"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("effects"))
    route_cover = line_coverage(around.select(*key, "file", "start", "end"), coverage, ["tree", "file"], key).select(*key, F.col("value").alias("coverage"))
    first = sites.groupBy(*key).agg(F.min_by(F.struct("provider", "file"), F.struct("file", "line")).alias("p"))
    routes = first.join(declared.select(*key), key, "left_anti").join(route, key, "left").join(route_cover, key, "left")

    none = F.array().cast("array<string>")
    own = declared.join(complexity, key, "left").join(effects, key, "left").join(covered, key, "left").join(listed, key, "left").join(first, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    body = [zero("complexity"), zero("reach"), F.coalesce("effects", none).alias("effects"), "coverage"]
    own = own.select(*key, F.coalesce("p.provider", F.lit("exportProvider")).alias("provider"), F.coalesce("p.file", "file", "module").alias("file"), "type_only", *body, F.coalesce("stops", none).alias("stops"))
    extra = routes.select(*key, "p.provider", "p.file", F.lit(False).alias("type_only"), *body, none.alias("stops"))
    symbols = own.unionByName(extra)
    users = model.used_by.groupBy(*key).agg(F.array_sort(F.collect_set("by")).alias("u"))
    stars = model.star_importers.groupBy("tree", "module").agg(F.array_sort(F.collect_set("by")).alias("s"))
    symbols = symbols.join(users, key, "left").join(stars, ["tree", "module"], "left")
    symbols = materialize(symbols.withColumn("used_by", F.array_union(F.coalesce("u", none), F.coalesce("s", none))).drop("u", "s"), "symbols")

    # a module's total counts each reached function once
    everywhere = reached.select("tree", "module", "fn_id").unionByName(around.join(routes.select(*key), key, "left_semi").select("tree", "module", "fn_id")).distinct()
    total = everywhere.join(fns.select("tree", "module", "fn_id", "count"), ["tree", "module", "fn_id"]).groupBy("tree", "module").agg(F.sum("count").alias("total_complexity"))
    marked = symbols.groupBy("tree", "module").agg(F.count("*").alias("boundary"), F.count(F.when(F.size("stops") > 0, 1)).alias("with_stops"))
    reasons = stops.groupBy("tree", "module").agg(F.sort_array(F.collect_list(F.struct(F.col("count").cast("long").alias("count"), "reason")), asc=False).alias("reasons"))
    shapes = within(model.shapes).join(marked, ["tree", "module"], "left").join(total, ["tree", "module"], "left").join(reasons, ["tree", "module"], "left")
    part = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, a / b).otherwise(0.0)
    value = confidence(part(F.col("with_stops"), F.col("boundary")), part(F.col("js_count"), F.col("file_count")), STOP_WEIGHT, JS_WEIGHT)
    no_config = F.exists(F.coalesce("reasons", F.array().cast("array<struct<count:bigint,reason:string>>")), lambda r: r["reason"] == "no-tsconfig")
    modules = shapes.select("tree", "module", "file_count", "type_only", zero("boundary"), zero("total_complexity"), F.when(no_config, 0.0).otherwise(value).alias("confidence"), "reasons")
    return Facts(symbols, modules, reached, stops)
