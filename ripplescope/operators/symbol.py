"""Facts of one symbol (or of a set of symbols at once): a bounded walk over calls under an edge rule, and what it touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import confidence
from ..storage import materialize
from .graph import bfs, reach_sums
from .ranges import innermost, line_coverage

EDGE_KINDS = ("file", "module", "package", "repo")
MAX_DEPTH, MAX_NODES = 12, 4000  # fixed values
#: Kinds of declarations without a value at run time.
TYPE_KINDS = ("interface", "type", "type-parameter")


def parse_reference(reference: str) -> dict[str, str | None]:
    """file#Name, file#Class.member or a bare name."""
    file, mark, rest = reference.rpartition("#")
    name, _, member = rest.partition(".")
    return {"file": file if mark else None, "name": name, "member": member or None}


def resolve_reference(reference: str, exports: DataFrame, limit: int = 40) -> tuple[str | None, list[str]]:
    """file of a reference, or the candidates if a bare name has none or several."""
    ref = parse_reference(reference)
    hits = exports.where(F.col("name") == ref["name"])
    if ref["file"] is not None:
        hits = hits.where(F.col("file") == ref["file"])
    files = [r.file for r in hits.select("file").distinct().orderBy("file").limit(limit).collect()]
    return (files[0], []) if len(files) == 1 else (None, files)


@dataclass
class Walk:
    nodes: DataFrame  # symbol, fn_id, depth, and the function's columns
    crossings: DataFrame  # symbol, kind, name, file, module, package, external, type_only, count
    stops: DataFrame  # symbol, fn_id, reason
    truncated: DataFrame  # symbol


def walk(seeds: DataFrame, functions: DataFrame, calls: DataFrame, call_stops: DataFrame, kind: str, max_depth: int | None = MAX_DEPTH, max_nodes: int | None = MAX_NODES, references: DataFrame | None = None) -> Walk:
    """seeds(symbol, fn_id); functions(fn_id, name, file, module, package, start, end, own, inline); calls(from_fn, to_fn, ..);
    references(from_fn, kind, name, file, module, package, external, type_only): other uses of names of other files and packages.

    A call to a function outside the edge is a crossing, and so is a reference to a declaration outside it; a package that is
    external lies outside every edge. Nodes beyond max_nodes, in the order of depth and fn_id, are cut,
    and a symbol that has so many goes no further after the round in which it met them.
    A limit that is None does not hold.
    """
    edges, start = _zoned(seeds, functions, calls, kind)
    found = bfs(edges, start, max_depth, ["zone"], max_nodes)
    return _cut(found, edges, functions, calls, call_stops, max_nodes, max_depth, references)


def _zone(kind: str, at: str) -> Column:
    """Where a place lies under an edge rule; module and package fall back to the file. The kind is part of it, so walks of several kinds can be one."""
    if kind == "repo":
        return F.lit("repo")
    return F.concat(F.lit(f"{kind}:"), F.coalesce(F.col(f"{at}.{kind}"), F.concat(F.lit("/"), F.col(f"{at}.file"))))


def _zoned(seeds: DataFrame, functions: DataFrame, calls: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """edges(zone, src, dst) of the calls that stay inside a seed's edge, and start(zone, seed, node).

    The edge rule depends on a symbol's home only through its place, so homes of one place share a zone and its edges.
    """
    place = functions.select("fn_id", F.struct("file", "module", "package").alias("place"))
    homes = seeds.join(place, "fn_id").groupBy("symbol").agg(F.min("place").alias("home"))
    ends = calls.select("from_fn", "to_fn").distinct().join(place.select(F.col("fn_id").alias("to_fn"), "place"), "to_fn")
    of = lambda c: _zone(kind, c)
    zoned = homes.select("symbol", of("home").alias("zone"))
    edges = ends.select(of("place").alias("zone"), F.col("from_fn").alias("src"), F.col("to_fn").alias("dst"))
    edges = edges.join(zoned.select("zone").distinct(), "zone", "left_semi")
    return edges, seeds.join(zoned, "symbol").select("zone", F.col("symbol").alias("seed"), F.col("fn_id").alias("node"))


def _cut(found: DataFrame, edges: DataFrame, functions: DataFrame, calls: DataFrame, call_stops: DataFrame, max_nodes: int | None, max_depth: int | None, references: DataFrame | None = None) -> Walk:
    """The walk of found(zone, seed, node, hops), which bfs gave for the edges."""
    found = found.select("zone", F.col("seed").alias("symbol"), F.col("node").alias("fn_id"), F.col("hops").alias("depth"))
    none = F.lit(False)
    if max_nodes is None:
        kept, left_out = found, found.where(none)
    else:
        ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("depth", "fn_id")))
        kept, left_out = ranked.where(F.col("n") <= max_nodes).drop("n"), ranked.where(F.col("n") > max_nodes)
    nodes = materialize(kept.join(functions, "fn_id"), "walk")
    out = nodes.select("zone", "symbol", F.col("fn_id").alias("from_fn")).join(calls, "from_fn")
    inside = edges.select("zone", F.col("src").alias("from_fn"), F.col("dst").alias("to_fn")).distinct()
    crossed = out.join(inside, ["zone", "from_fn", "to_fn"], "left_anti")
    target = functions.select(F.col("fn_id").alias("to_fn"), "name", "file", "module", "package")
    key = ["symbol", "kind", "name", "file", "module", "package", "external"]
    crossings = crossed.join(target, "to_fn").select("symbol", F.lit("call").alias("kind"), "name", "file", "module", "package", F.lit(False).alias("external"), F.lit(False).alias("type_only"))
    if references is not None:
        used = nodes.select("zone", "symbol", F.col("fn_id").alias("from_fn")).join(references.withColumn("place", F.struct("file", "module", "package")), "from_fn")
        own = reduce(lambda other, kind: F.when(F.col("zone").startswith(kind), _zone(kind, "place")).otherwise(other), EDGE_KINDS, F.lit(None).cast("string"))
        crossings = crossings.unionByName(used.where(F.col("external") | ~F.col("zone").eqNullSafe(own)).select(*key, "type_only"))
    crossings = crossings.groupBy(*key).agg(F.count("*").alias("count"), F.bool_and("type_only").alias("type_only"))
    stops = nodes.select("symbol", "fn_id").join(call_stops.select(F.col("from_fn").alias("fn_id"), "reason"), "fn_id")
    # the depth limit cuts a walk only where a call inside the edge leads on to a function that was not met
    last = found.where(none if max_depth is None else F.col("depth") >= max_depth).select("zone", "symbol", F.col("fn_id").alias("from_fn"))
    beyond = last.join(inside, ["zone", "from_fn"]).select("zone", "symbol", F.col("to_fn").alias("fn_id")).join(found, ["zone", "symbol", "fn_id"], "left_anti")
    return Walk(nodes, crossings, stops, left_out.select("symbol").unionByName(beyond.select("symbol")).distinct())


def symbol_facts(w: Walk, matches: DataFrame, lines: DataFrame) -> DataFrame:
    """(symbol, own parts, transitive, reach, depth, effects, covered, known, coverage, stops, confidence, floor).

    Effects go to the innermost walked function. Confidence counts functions with stops and files that are scripts.
    """
    base = w.nodes.groupBy("symbol").agg(
        F.sum(F.when(F.col("depth") == 0, F.col("own"))).alias("own"),
        F.sum(F.when(F.col("depth") == 0, F.col("own") + F.col("inline"))).alias("own_plus_inline"),
        F.sum(F.col("own") + F.col("inline")).alias("transitive"),
        F.count("*").alias("reach"),
        F.max("depth").alias("depth"),
        F.count_distinct("file").alias("files"),
        F.count_distinct(F.when(F.col("file").rlike(r"\.(js|jsx)$"), F.col("file"))).alias("js_files"),
    )
    ranges = w.nodes.select("symbol", "fn_id", "file", "start", "end")
    key = ["symbol", "category", "file", "line"]
    placed = matches.select("category", "file", "line").distinct().join(ranges.select("symbol", "file").distinct(), "file")
    effects = innermost(placed, ranges, ["symbol", "file"], key, "fn_id").groupBy("symbol").agg(F.array_sort(F.collect_set("category")).alias("effects"))
    cover = line_coverage(ranges, lines, ["file"], ["symbol"]).select("symbol", "covered", "known", F.col("value").alias("coverage"))
    stops = w.stops.groupBy("symbol").agg(F.count("*").alias("stops"), F.count_distinct("fn_id").alias("stopped"))
    cut = w.truncated.withColumn("truncated", F.lit(True))
    out = base
    for part in (effects, cover, stops, cut):
        out = out.join(part, "symbol", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    value = confidence(zero("stopped") / F.col("reach"), F.col("js_files") / F.col("files"))
    return out.select("symbol", "own", "own_plus_inline", "transitive", "reach", "depth", F.coalesce("effects", F.array().cast("array<string>")).alias("effects"), "covered", "known", "coverage", zero("stops").alias("stops"), value.alias("confidence"), ((zero("stops") > 0) | F.coalesce("truncated", F.lit(False))).alias("floor"))


def compare_edges(seeds: DataFrame, functions: DataFrame, calls: DataFrame, call_stops: DataFrame, max_depth: int | None = MAX_DEPTH, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """(symbol, edge, reach, transitive, stops, crossings, modules, truncated) under each of the four edge rules.

    truncated: a limit was met, so the other figures are least values. Without limits no walk is listed, only its sums are made.
    """
    if max_depth is None and max_nodes is None:
        return _edge_sums(seeds, functions, calls, call_stops)
    edges, starts = zip(*[_zoned(seeds, functions, calls, kind) for kind in EDGE_KINDS])
    named = [start.withColumn("seed", F.struct(F.col("seed").alias("symbol"), F.lit(kind).alias("edge"))) for kind, start in zip(EDGE_KINDS, starts)]
    every = materialize(reduce(DataFrame.unionByName, edges), "zones")
    w = _cut(bfs(every, reduce(DataFrame.unionByName, named), max_depth, ["zone"], max_nodes), every, functions, calls, call_stops, max_nodes, max_depth)
    out = w.nodes.groupBy("symbol").agg(F.count("*").alias("reach"), F.sum(F.col("own") + F.col("inline")).alias("transitive"))
    out = out.join(w.stops.groupBy("symbol").agg(F.count("*").alias("stops")), "symbol", "left")
    out = out.join(w.crossings.groupBy("symbol").agg(F.count("*").alias("crossings"), F.count_distinct("module").alias("modules")), "symbol", "left").na.fill(0)
    out = out.join(w.truncated.withColumn("truncated", F.lit(True)), "symbol", "left").na.fill(False)
    return out.select("symbol.symbol", "symbol.edge", "reach", "transitive", "stops", "crossings", "modules", "truncated")


def _edge_sums(seeds: DataFrame, functions: DataFrame, calls: DataFrame, call_stops: DataFrame) -> DataFrame:
    """compare_edges without limits. Symbols, functions, crossings and modules crossed to are nodes of one graph per zone, so all figures are sums over what a symbol reaches."""
    node = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("id"))
    place = materialize(functions.select("fn_id", F.struct("name", "file", "module", "package").alias("place")).distinct(), "places")
    starts = materialize(reduce(DataFrame.unionByName, [_zoned(seeds, functions, calls, kind)[1].withColumn("edge", F.lit(kind)) for kind in EDGE_KINDS]), "starts")
    zones = F.explode(F.array(*[_zone(kind, "place") for kind in EDGE_KINDS])).alias("zone")
    # a symbol may start at functions outside its home's zone
    members = place.select(zones, "fn_id").unionByName(starts.select("zone", F.col("node").alias("fn_id"))).join(starts.select("zone").distinct(), "zone", "left_semi").distinct()
    of = F.element_at(F.create_map(*[x for kind in EDGE_KINDS for x in (F.lit(kind), _zone(kind, "place"))]), F.substring_index("zone", ":", 1))
    used = calls.select(F.col("from_fn").alias("fn_id"), "to_fn").distinct().join(members, "fn_id").join(place.select(F.col("fn_id").alias("to_fn"), "place"), "to_fn")
    used = materialize(used.select("zone", node("function", F.col("fn_id")).alias("src"), "to_fn", "place", (F.col("zone") == of).alias("inside")), "used")
    edges = [
        starts.select("zone", node("symbol", F.col("seed")).alias("src"), node("function", F.col("node")).alias("dst")),
        used.where("inside").select("zone", "src", node("function", F.col("to_fn")).alias("dst")),
        used.where("not inside").select("zone", "src", node("crossing", F.to_json("place")).alias("dst")),
        used.where("not inside and place.module is not null").select("zone", "src", node("module", F.col("place.module")).alias("dst")),
    ]
    edges = reduce(DataFrame.unionByName, edges).distinct()
    zero = F.lit(0).cast("long")
    stops = call_stops.groupBy(F.col("from_fn").alias("fn_id")).agg(F.count("*").alias("stops"))
    counts = functions.join(stops, "fn_id", "left").groupBy("fn_id").agg(F.count("*").alias("reach"), F.sum((F.col("own") + F.col("inline")).cast("long")).alias("transitive"), F.sum(F.coalesce("stops", zero)).alias("stops"))
    counts = counts.join(members, "fn_id").select("zone", node("function", F.col("fn_id")).alias("node"), "reach", "transitive", "stops", zero.alias("crossings"), zero.alias("modules"))
    outside = edges.where("dst.kind in ('crossing', 'module')").select("zone", F.col("dst").alias("node")).distinct()
    outside = outside.select("zone", "node", *[zero.alias(c) for c in ("reach", "transitive", "stops")], *[(F.col("node.kind") == kind).cast("long").alias(c) for kind, c in (("crossing", "crossings"), ("module", "modules"))])
    of_symbols = starts.select("zone", "edge", F.col("seed").alias("symbol"), node("symbol", F.col("seed")).alias("node")).distinct()
    sums = reach_sums(edges, materialize(counts.unionByName(outside), "weights"), of_symbols, ["zone"]).where("reach > 0")
    return of_symbols.join(sums, ["zone", "node"]).select("symbol", "edge", "reach", "transitive", "stops", "crossings", "modules", F.lit(False).alias("truncated"))


def identities(declarations: DataFrame, seeds: DataFrame, keys: Sequence[str] = ("tree", "file")) -> DataFrame:
    """declarations(keys.., symbol, decl, kind, line, exported, is_default, given), seeds(keys.., symbol, fn_id) to
    (keys.., symbol, kind, line, exported, default_export, type_only, overloads, seeds), a row per declared symbol.

    kind and line are those of the first declaration by line and decl. It is exported if any declaration is, type-only if all are
    types or variables that are given nothing. Declarations and seed functions that are repeated count once; a null flag is
    false, and rows without a key, symbol, decl or function play no part.
    """
    key = [*keys, "symbol"]
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    is_type = F.coalesce(F.col("kind").isin(*TYPE_KINDS) | ((F.col("kind") == "variable") & ~F.coalesce("given", F.lit(False))), F.lit(False))
    parts = declarations.na.drop(subset=[*key, "decl"]).groupBy(*key, "decl").agg(F.min(F.struct("line", "kind")).alias("x"), flag("exported").alias("exported"), flag("is_default").alias("is_default"), F.bool_and(is_type).alias("is_type"))
    out = parts.groupBy(*key).agg(
        F.min_by("x", F.struct(F.col("x.line"), F.col("decl"))).alias("x"), F.bool_or("exported").alias("exported"), F.bool_or("is_default").alias("default_export"), F.bool_and("is_type").alias("type_only"), F.count("*").alias("overloads"),
    )
    counts = seeds.select(*key, "fn_id").na.drop().distinct().groupBy(*key).agg(F.count("*").alias("seeds"))
    return out.join(counts, key, "left").select(*key, "x.kind", "x.line", "exported", "default_export", "type_only", "overloads", F.coalesce("seeds", F.lit(0).cast("long")).alias("seeds"))


def importers(imports: DataFrame, origins: DataFrame, module_of: DataFrame, file: str, name: str) -> DataFrame:
    """Imports that end at file#name through re-exports: file, line, spec, as, type_only, module."""
    hits = imports.where("to_file is not null").join(origins.select("tree", F.col("file").alias("to_file"), "name", "origin_file", "origin_name"), ["tree", "to_file", "name"], "left")
    hits = hits.where((F.coalesce("origin_file", "to_file") == file) & (F.coalesce("origin_name", "name") == name))
    at = module_of.select("tree", F.col("file").alias("from_file"), "module")
    return hits.join(at, ["tree", "from_file"], "left").select("tree", F.col("from_file").alias("file"), "line", "spec", F.col("name").alias("as"), "type_only", "module")


def reexporters(reexports: DataFrame, origins: DataFrame, file: str, name: str) -> DataFrame:
    """Files that re-export file#name under some name."""
    hits = origins.where((F.col("origin_file") == file) & (F.col("origin_name") == name) & (F.col("file") != file)).select("tree", "file")
    return hits.join(reexports.select("tree", F.col("from_file").alias("file")), ["tree", "file"], "left_semi").distinct()


def boundary_status(names: DataFrame, declared: DataFrame, bypassed: DataFrame, used_by: DataFrame, entries: DataFrame, provided: DataFrame) -> DataFrame:
    """names(tree, module, name) with on_surface, in_entry, bypassed, type_only, unused, used_by."""
    key = ["tree", "module", "name"]
    users = used_by.where("by is not null and by <> module").groupBy(*key).agg(F.array_sort(F.collect_set("by")).alias("users"))
    out = names.join(declared.select(*key, "type_only", F.col("file").alias("declared_in"), F.lit(True).alias("d")), key, "left")
    out = out.join(bypassed.select(*key, F.lit(True).alias("b")).distinct(), key, "left").join(users, key, "left").join(entries, ["tree", "module"], "left")
    out = out.join(provided.select(*key, F.lit(True).alias("p")).distinct(), key, "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    list_ = F.coalesce("users", F.array().cast("array<string>"))
    in_entry = F.col("entry").isNotNull() & (flag(F.col("declared_in") == F.col("entry")) | (flag("d") & ~flag("b")))
    return out.select(*key, (flag("d") | flag("p")).alias("on_surface"), in_entry.alias("in_entry"), flag("b").alias("bypassed"), flag("type_only").alias("type_only"), (flag("d") & (F.size(list_) == 0)).alias("unused"), list_.alias("used_by"))


def callers(calls: DataFrame, seeds: DataFrame, functions: DataFrame, max_files: int = 80) -> tuple[DataFrame, int]:
    """Call sites of the seed functions in the first max_files files by name, and how many files were left out."""
    sites = calls.join(seeds.select(F.col("fn_id").alias("to_fn")), "to_fn", "left_semi").join(functions.select(F.col("fn_id").alias("from_fn"), "file", F.col("name").alias("in_function")), "from_fn")
    files = sites.select("file").distinct()
    first = files.orderBy("file").limit(max_files)
    skipped = max(0, files.count() - max_files)
    return sites.join(first, "file", "left_semi").select("file", "line", "in_function", "text"), skipped
