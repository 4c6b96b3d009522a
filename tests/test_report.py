"""A small tree pair, with facts counted by hand."""

import json

import pytest
from pyspark.sql import functions as F

from ripplescope.config import EXTENSIONS, Config
from ripplescope.functions import paths
from ripplescope.operators import facts, modules, symbol
from ripplescope.plans.bindings import impact_tables
from ripplescope.plans.report import build_report, module_models
from ripplescope.schemas import TABLES
from ripplescope.sinks.module_report import report_json, report_text, write_json
from ripplescope.sinks.symbol_report import call_tree, symbol_document, symbol_dot, symbol_html, symbol_json, symbol_text

from .conftest import rows

CONFIG = Config(modules=("m/*",))


def tables(spark, head_extra=True):
    t: dict[str, list] = {k: [] for k in TABLES}
    for tree in ("base", "head"):
        for f, text in {"m/a/index.ts": "export { run } from './run'", "m/a/run.ts": "export function run() {}", "m/a/t.spec.ts": "", "m/b/x.ts": "class X {}", "m/c/types.ts": "export type T = string", "m/d/old.js": "function o() {}", "out/u.ts": ""}.items():
            t["files"].append((tree, f, f.endswith(".js"), f.endswith("index.ts"), text))
        t["reexports"].append((tree, "m/a/index.ts", 0, 0, "./run", False, "run", "run", False, None))
        t["exports"] += [(tree, "m/a/run.ts", "run", 1, False), (tree, "m/a/run.ts", "deep", 9, False), (tree, "m/b/x.ts", "X", 1, False), (tree, "m/c/types.ts", "T", 1, True)]
        t["imports"] += [(tree, "m/b/x.ts", 0, "run", "@p/a", False, 1, None), (tree, "m/b/x.ts", 1, None, "./missing", False, 2, None), (tree, "m/a/t.spec.ts", 0, "X", "../b/x", False, 1, None), (tree, "out/u.ts", 0, "X", "../m/b/x.js", False, 1, None)]
        t["workspace"] += [(tree, "@p/a", "m/a"), (tree, "@p", "nowhere")]
        t["functions"] += [(tree, "run", "m/a/run.ts", 1, 5, "run", "function", 3, 0, True, False, "run"), (tree, "help", "m/a/run.ts", 6, 8, "help", "function", 2, 1, False, False, "help"), (tree, "cb", "m/a/run.ts", 7, 7, "", "arrow", 1, 0, False, False, "help"), (tree, "x", "m/b/x.ts", 1, 4, "X.go", "method", 4, 0, True, False, "x")]
        t["calls"] += [(tree, "run", 0, "help", 2, "help()", None), (tree, "help", 0, "run", 6, "run()", None), (tree, "x", 0, "run", 2, "run()", None)]
        t["call_stops"] += [(tree, "help", 1, "interface", "m/a/run.ts", 6, "i.f()"), (tree, "help", 2, "interface", "m/b/x.ts", 6, "j.f()"), (tree, "run", 3, "dynamic", None, 3, "f[k]()")]
        t["decl_seeds"] += [(tree, "m/a/run.ts", "run", "run"), (tree, "m/b/x.ts", "X", "x")]
        t["matches"] += [(tree, "db", "m/a/run.ts", 2, 2), (tree, "fs", "m/a/run.ts", 7, 7), (tree, "net", "out/u.ts", 1, 1)]
        t["coverage_lines"] += [(tree, "m/a/run.ts", 1, 1), (tree, "m/a/run.ts", 7, 0), (tree, "m/a/run.ts", 99, 1)]
    if head_extra:
        t["imports"] += [("head", "m/b/x.ts", 2, "deep", "../a/run", True, 3, None), ("head", "m/a/run.ts", 0, "T", "../c/types", True, 1, None), ("head", "m/d/old.js", 0, "*", "../b/x", False, 1, None)]
        t["functions"].append(("head", "late", "m/a/run.ts", 10, 12, "late", "function", 5, 0, False, False, "late"))
        t["calls"].append(("head", "help", 3, "late", 7, "late()", None))
    t["change_set"] += [("m/a/run.ts", "M", None), ("m/d/new.js", "R", "m/e/gone.js"), ("README", "M", None)]
    return {k: spark.createDataFrame(v, TABLES[k]) for k, v in t.items()}


@pytest.fixture(scope="module")
def report(spark):
    return build_report(tables(spark), CONFIG)


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.first()


def test_surface_and_dependencies(report):
    m = report.model
    head = lambda df: df.where("tree = 'head'").drop("tree")
    assert rows(head(m.entries)) == [("m/a", "m/a/index.ts")]
    assert rows(head(m.declared).select("module", "name", "type_only", "file")) == [("m/a", "deep", False, "m/a/run.ts"), ("m/a", "run", False, "m/a/run.ts"), ("m/b", "X", False, "m/b/x.ts"), ("m/c", "T", True, "m/c/types.ts")]
    assert rows(head(m.bypassed)) == [("m/a", "deep")]
    # tests make dependencies, files outside modules make only the use known
    assert rows(head(m.direct_deps)) == [("m/a", "m/b", 1, False), ("m/a", "m/c", 1, True), ("m/b", "m/a", 2, False), ("m/d", "m/b", 1, False)]
    assert rows(head(m.star_importers)) == [("m/b", "m/d")]
    assert rows(head(m.used_by).where("name = 'X'").select("by")) == [("m/a",), (None,)]
    assert rows(head(m.shapes)) == [("m/a", 2, 0, False), ("m/b", 1, 0, False), ("m/c", 1, 0, True), ("m/d", 1, 1, False)]


def test_symbol_facts(report):
    run = {t: one(report.facts.symbols, tree=t, module="m/a", name="run") for t in ("base", "head")}
    assert run["base"].complexity == 3 + 3 and run["head"].complexity == 3 + 3 + 5 and run["head"].reach == 3
    # fs sits on the callback, which no call reaches
    assert run["head"].effects == ["db"] and run["head"].stops == ["dynamic", "interface"]
    assert run["head"].coverage == 0.5 and run["head"].used_by == ["m/b"]
    deep = one(report.facts.symbols, tree="head", name="deep")
    assert deep.complexity == 0 and deep.stops == ["unresolved"] and deep.coverage is None


def test_module_facts_count_each_function_once(report):
    a = one(report.facts.modules, tree="head", module="m/a")
    assert a.total_complexity == 11 and a.confidence == 0.5 and [(r["reason"], r["count"]) for r in a.reasons] == [("unresolved", 1), ("interface", 1), ("dynamic", 1)]


def test_deltas(report):
    assert rows(report.touched) == [("m/a",), ("m/d",), ("m/e",)]
    assert rows(report.renamed) == [("m/e", "m/d")]
    a, e = one(report.modules, module="m/a"), one(report.modules, module="m/e")
    assert (a.status, a.total_complexity_delta, a.boundary_delta, a.direct_added, a.direct_removed, a.dependents, a.unused_exports) == ("changed", 5, 1, ["m/c"], [], ["m/b"], [])
    assert (e.status, e.file_count_delta, e.total_complexity_delta) == ("added", 0, None)
    assert rows(report.symbols.select("module", "name", "status", "complexity_delta")) == [("m/a", "deep", "added", None), ("m/a", "run", "changed", 5)]
    assert rows(report.dependents_of_touched) == [("m/b",)]


def test_equal_trees_have_no_delta(spark):
    r = build_report(tables(spark, head_extra=False), CONFIG)
    assert {x.status for x in r.symbols.collect()} == {"same"}
    for m in r.modules.where("module <> 'm/e'").collect():
        assert not m.total_complexity_delta and not m.direct_added and not m.direct_removed and not m.boundary_delta and not m.indirect_delta


def test_sinks(report, tmp_path):
    document = report_json(report, {"base": "b", "head": "h"})
    assert json.loads(document)["modules"][0]["symbols"][0]["name"] == "run"
    view = report_text(document)
    assert "## Touched modules: 3" in view and "### m/a: new direct dependencies: 1\n\n- m/c" in view and "| run | value | changed | at least 11 (+5) |" in view
    assert "## Touched modules: 0" in report_text(json.dumps({"renamed": [], "modules": [], "dependentsOfTouched": []}))
    write_json(report.modules, report.symbols, str(tmp_path / "out"))
    assert module_models(report.model, report.facts).count() == 4


def test_symbol_mode(spark):
    t = tables(spark)
    head = {k: v.where("tree = 'head'").drop("tree") for k, v in t.items() if "tree" in v.columns}
    fns = head["functions"].withColumn("module", F.regexp_extract("file", "^(m/[a-z])", 1)).withColumn("package", F.lit("p"))
    seeds = spark.createDataFrame([("X", "x")], "symbol string, fn_id string")
    w = symbol.walk(seeds, fns, head["calls"], head["call_stops"], "module")
    assert rows(w.nodes.select("fn_id", "depth")) == [("x", 0)] and rows(w.crossings.select("name", "module", "count")) == [("run", "m/a", 1)]
    compared = {r.edge: (r.reach, r.transitive, r.stops, r.crossings) for r in symbol.compare_edges(seeds, fns, head["calls"], head["call_stops"]).collect()}
    assert compared == {"file": (1, 4, 0, 1), "module": (1, 4, 0, 1), "package": (4, 15, 3, 0), "repo": (4, 15, 3, 0)}
    w = symbol.walk(seeds, fns, head["calls"], head["call_stops"], "repo")
    f = symbol.symbol_facts(w, head["matches"], head["coverage_lines"]).first()
    assert (f.own, f.transitive, f.reach, f.depth, f.effects, f.covered, f.known, f.floor, f.confidence) == (4, 15, 4, 3, ["db", "fs"], 1, 2, True, 0.75)
    d = symbol_document("X", w, head["matches"], head["coverage_lines"], head["calls"])
    assert [(depth, n["fn_id"], seen) for depth, n, seen in call_tree(d)] == [(0, "x", False), (1, "run", False), (2, "help", False), (3, "late", False), (3, "run", True)]
    assert "transitive 15   floor" in symbol_text(d) and '"x" -> "run"' in symbol_dot(d) and "</script><script>" in symbol_html(d) and json.loads(symbol_json(d))["symbol"] == "X"
    cut = symbol.walk(seeds, fns, head["calls"], head["call_stops"], "repo", max_nodes=2)
    assert rows(cut.nodes.select("fn_id")) == [("run",), ("x",)] and rows(cut.truncated) == [("X",)]
    assert symbol.parse_reference("f.ts#C.m") == {"file": "f.ts", "name": "C", "member": "m"}
    assert symbol.resolve_reference("run", head["exports"]) == ("m/a/run.ts", [])


def test_function_counts(spark):
    functions = spark.createDataFrame([("t", "f", None, False), ("t", "cb", "f", True), ("t", "cb2", "cb", True), ("t", "g", "cb", False)], "tree string, fn_id string, parent string, anonymous boolean")
    nodes = spark.createDataFrame([("t", "f", True), ("t", "cb", True), ("t", "cb2", False), ("t", "g", True)], "tree string, owner string, decision boolean")
    assert rows(facts.function_counts(nodes, functions)) == [("t", "cb", 2, 0, "f"), ("t", "cb2", 1, 0, "f"), ("t", "f", 2, 1, "f"), ("t", "g", 2, 0, "g")]


def test_resolution_order(spark):
    files = spark.createDataFrame([("t", f) for f in ("p/src/d/u.ts", "p/d/u/index.js", "p/index.ts", "a/x.tsx", "a/x.js")], "tree string, file string")
    ws = spark.createDataFrame([("t", "@s/p", "p"), ("t", "@s", "q")], "tree string, pkg string, dir string")
    specs = ["@s/p/d/u", "@s/p", "./x", "./x.js", "react", "../../up"]
    edges = spark.createDataFrame([("t", "a/i.ts", i, s, None) for i, s in enumerate(specs)], "tree string, from_file string, stmt_no int, spec string, to_file string")
    got = {r.spec: r.to_file for r in modules.resolve_imports(edges, files, ws).collect()}
    assert got == {"@s/p/d/u": "p/src/d/u.ts", "@s/p": "p/index.ts", "./x": "a/x.tsx", "./x.js": "a/x.tsx", "react": None, "../../up": None}


def test_edge_comparison_follows_chains_to_their_end(spark, tmp_path):
    from ripplescope.plans.queries import QUERIES

    # one hour per call: an error of user i, then a purchase of user i + 1
    events = [(2 * i + k, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:0{k}:00", i + k, ("error", "purchase")[k], 1.0) for i in range(15) for k in (0, 1)]
    frame = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double")
    frame.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    found = {r.symbol: r.reach for r in QUERIES["edge_comparison"](spark, str(tmp_path)).where("edge = 'repo'").collect()}
    assert found == {i: 16 - i for i in range(15)}
    calls = spark.createDataFrame([(i, i + 1) for i in range(15)], "from_fn long, to_fn long")
    functions = spark.range(16).selectExpr("id AS fn_id", "'n' AS name", "'f' AS file", "'m' AS module", "'p' AS package", "0 AS start", "0 AS end", "1 AS own", "0 AS inline")
    seeds = spark.createDataFrame([(0, 0), (10, 10)], "symbol long, fn_id long")
    stops = spark.createDataFrame([], "from_fn long, reason string")
    limited = symbol.compare_edges(seeds, functions, calls, stops)
    assert {(r.symbol, r.reach, r.truncated) for r in limited.collect()} == {(0, 13, True), (10, 6, False)}
    # a walk that ends at the limit by itself is whole
    whole = symbol.compare_edges(seeds.where("symbol = 10"), functions, calls, stops, max_depth=5)
    assert {(r.reach, r.truncated) for r in whole.collect()} == {(6, False)}


def test_unlimited_edge_comparison_lists_no_walk(spark, monkeypatch):
    from ripplescope.operators import graph

    def no_walk(*_):
        raise AssertionError("a walk was listed")

    monkeypatch.setattr(symbol, "bfs", no_walk)
    monkeypatch.setattr(graph, "HUB_EDGES", 5)
    calls = {(i, (i * 7 + k) % 12) for i in range(12) for k in (1, 4)} | {(3, 20)}
    held = {i: (f"f{i % 3}", f"m{i % 2}" if i else None) for i in (*range(12), 20)}
    functions = spark.createDataFrame([(i, "n", f, m, "p", 0, 0, i, 1) for i, (f, m) in held.items()], "fn_id long, name string, file string, module string, package string, start int, end int, own int, inline int")
    starts = {100: (1, 5), 101: (3,), 102: (20,), 103: (0,)}
    seeds = spark.createDataFrame([(s, f) for s, fs in starts.items() for f in fs], "symbol long, fn_id long")
    stops = spark.createDataFrame([(3, "dynamic"), (3, "param"), (7, "dynamic")], "from_fn long, reason string")
    want = set()
    for s, fs in starts.items():
        home = min((held[f] for f in fs))
        for edge, at in (("file", lambda f: held[f][0]), ("module", lambda f: held[f][1] or f"/{held[f][0]}"), ("repo", lambda f: 0)):
            zone = {"file": home[0], "module": home[1] or f"/{home[0]}", "repo": 0}[edge]
            met, ahead = set(fs), set(fs)
            while ahead:
                ahead = {b for a, b in calls if a in ahead and at(b) == zone} - met
                met |= ahead
            out = {held[b] for a, b in calls if a in met and at(b) != zone}
            want.add((s, edge, len(met), sum(f + 1 for f in met), 2 * (3 in met) + (7 in met), len(out), len({m for _, m in out if m})))
    got = symbol.compare_edges(seeds, functions, spark.createDataFrame([*calls], "from_fn long, to_fn long"), stops, None, None)
    assert {(r.symbol, r.edge, r.reach, r.transitive, r.stops, r.crossings, r.modules) for r in got.collect() if r.edge != "package"} == want


def test_paths_are_matched_once_for_each_file(spark):
    # a condition on the module would go below the aggregate, to each row that files are made of
    made = spark.range(40).groupBy((F.col("id") % 4).alias("u")).count().select(F.lit("head").alias("tree"), F.concat(F.lit("m/"), F.col("u").cast("string"), F.lit("/x.ts")).alias("file"))
    placed = modules.assign_modules(made.unionByName(made.limit(1).withColumn("file", F.lit("out/x.ts"))), CONFIG)
    assert "Aggregate" not in placed._jdf.queryExecution().optimizedPlan().toString()
    assert rows(placed.select("file", "module")) == [(f"m/{u}/x.ts", f"m/{u}") for u in range(4)]


def test_specifiers_find_the_files_that_their_candidates_name(spark):
    files = [f"{d}{name}{e}" for d in ("", "a/", "a/b/", "a/src/") for name in ("index", "x", "x.d", "", "src/index") for e in (*EXTENSIONS, ".json", "")]
    files = [f for i, f in enumerate(files) if i % 3 != 1 and f]
    specs = ["./x", "./x.js", "..", "../index", ".", "./b", "./.js", "../..", "../../a", "./x.d", "./src", "../src/", "./x.json"]
    edges = [("head", at, i, s) for at in ("a/b/f.ts", "a/f.ts", "f.ts", "../f.ts") for i, s in enumerate(specs)]
    df = spark.createDataFrame(edges, "tree string, from_file string, stmt_no int, spec string")
    got = modules.resolve_imports(df, spark.createDataFrame([("head", f) for f in files], "tree string, file string"), spark.createDataFrame([], "tree string, pkg string, dir string"))
    based = df.withColumn("base", paths.join(paths.dirname(F.col("from_file")), F.col("spec")))
    named = {(r.from_file, r.spec): [] if r.base.startswith("..") else r.c for r in based.withColumn("c", paths.source_candidates(F.col("base"))).collect()}
    assert {(r.from_file, r.spec): r.to_file for r in got.collect()} == {k: next((f for f in c if f in files), None) for k, c in named.items()}
    assert sum(r.to_file is not None for r in got.collect()) > 15


def test_report_tables_read_events_no_more(spark):
    made = impact_tables(spark, "/root/testdata/sf0.001")
    for name in ("files", "imports", "exports", "functions", "calls", "decl_seeds", "change_set"):
        assert made[name].count() and not [f for f in made[name].inputFiles() if "events" in f], name
