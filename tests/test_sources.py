
from ripplescope.config import Config, Provider
from ripplescope.operators import delta, modules, rollups, symbol
from ripplescope.sources import coverage, lexical, trees

from .conftest import rows


def test_tree_filter(spark):
    names = ["a/b.ts", "a/b.d.ts", "a/.x/b.ts", "node_modules/a.ts", "a/dist/x.js", "a/x.css", "apps/meteor/tests/x.ts", "apps/meteor/tests2/x.ts", ".a.ts"]
    got = trees.kept_files(spark.createDataFrame([(n,) for n in names], "file string"))
    assert rows(got) == [("a/b.ts",), ("apps/meteor/tests2/x.ts",)]


def test_read_tree(spark, tmp_path):
    for name, text in {"p/src/a.ts": "export const x = 1", "p/dist/a.js": "1", "p/src/b.js": "é"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert rows(trees.read_tree(spark, str(tmp_path), "head")) == [("head", "p/src/a.ts", False, "export const x = 1"), ("head", "p/src/b.js", True, "é")]


def test_read_tree_below_a_directory_of_the_same_name(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src" / "repo").mkdir(parents=True)
    (root / "node_modules" / "x").mkdir(parents=True)
    (root / "src" / "repo" / "x.ts").write_text("a")
    (root / "node_modules" / "x" / "y.ts").write_text("b")
    assert rows(trees.read_tree(spark, f"{root}/", "head")) == [("head", "src/repo/x.ts", False, "a")]
    assert trees.read_tree(spark, str(root / "node_modules" / "x"), "head").count() == 1
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("")
    assert trees.read_tree(spark, str(tmp_path / "none"), "head").count() == 0


def test_names_of_files_are_no_patterns(spark, tmp_path):
    root = tmp_path / "a[b]{c}*"
    names = ["[id].ts", "{x}.ts", "[...slug].tsx", "s.tsx", "a*b.ts", "q?.ts", "p q/[k]/%41.ts", "back\\\\slash.ts"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (tmp_path / "abc").mkdir()
    (tmp_path / "abc" / "other.ts").write_text("other")
    assert rows(trees.read_tree(spark, str(root), "t"), "file", "text") == sorted((n, n) for n in names if "\\\\" not in n or (root / n).exists())


def test_workspace_precedence(spark):
    files = [("packages/b/package.json", '{"name": "x"}'), ("apps/a/package.json", '{"name": "x"}'), ("packages/b/sub/package.json", '{"name": "y"}'), ("packages/b/node_modules/package.json", '{"name": "z"}'), ("packages/c/package.json", "{broken"), ("other/package.json", '{"name": "o"}'), ("ee/apps/q/package.json", '{"name": "t"}')]
    manifests = spark.createDataFrame([("h", *f) for f in files], "tree string, file string, text string")
    assert rows(trees.workspace_packages(manifests).select("pkg", "dir")) == [("t", "ee/apps/q"), ("x", "packages/b"), ("y", "packages/b/sub")]
    tasks = spark.createDataFrame([("h", "x", "apps/a")], "tree string, pkg string, dir string")
    assert ("x", "apps/a") in rows(trees.workspace_packages(manifests, tasks).select("pkg", "dir"))


def test_effects_and_providers(spark):
    text = "fetch(u)\nconst a = axios.get(u); fs.readFile(p)\nAPI.v1.addRoute('users.list', {})\nprefetch(u)"
    files = spark.createDataFrame([("h", "apps/meteor/x.ts", text), ("h", "lib/y.ts", text)], "tree string, file string, text string")
    hits = rows(trees.effect_matches(files).where("file = 'lib/y.ts'").select("category", "line"))
    assert hits == [("fs", 2), ("network", 1), ("network", 2)]
    assert rows(trees.provided_symbols(files).select("provider", "file", "line", "name")) == [("apiRouteProbe", "apps/meteor/x.ts", 3, "users.list")]
    everywhere = Config(providers=(Provider("r", r"addRoute\('([^']+)'"),))
    assert trees.provided_symbols(files, everywhere).count() == 2


def test_change_set_and_modules(spark):
    lines = spark.createDataFrame([("M\tm/a/x.ts",), ("R100\tm/b/x.ts\tm/c/x.ts",), ("R090\tm/b/y.ts\tm/d/y.ts",), ("D\tn/x.ts",), ("",)], "value string")
    changes = trees.change_set(lines)
    assert rows(delta.touched_modules(changes, ("m/*",))) == [("m/a",), ("m/b",), ("m/c",), ("m/d",)]
    assert rows(delta.renamed_modules(changes, ("m/*",))) == [("m/b", "m/d")]


def test_coverage_reader_by_name(spark, tmp_path):
    (tmp_path / "l.info").write_text("SF:/r/a.ts\nDA:1,2\n")
    (tmp_path / "c.json").write_text('{"/r/a.ts": {"statementMap": {"0": {"start": {"line": 4}, "end": {"line": 5}}}, "s": {"0": 3}}}')
    source, lines = coverage.read_coverage(spark, str(tmp_path / "l.info"), "head", "/r")
    assert source == "lcov" and rows(lines) == [("head", "a.ts", 1, 2)]
    source, lines = coverage.read_coverage(spark, str(tmp_path / "c.json"), "head", "/r")
    assert source == "istanbul" and rows(lines) == [("head", "a.ts", 4, 3), ("head", "a.ts", 5, 3)]
    assert coverage.read_coverage(spark, None, "head")[0] == "none"


def test_large_lcov_reports_are_split(spark, tmp_path):
    blocks = [(f"/r/f{i % 300}.ts", [(j, i) for j in range(1, 6)] + [(2, 0)] * (i % 2)) for i in range(400)]
    text = "TN:\n" + "".join(f"SF:{file}\nFN:1,f\n" + "".join(f"DA:{a},{b}\n" for a, b in lines) + "end_of_record\n" for file, lines in blocks)
    (tmp_path / "l.info").write_text(text)
    want = {file[3:]: dict(lines) for file, lines in blocks}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        made = coverage.lcov_file(spark, str(tmp_path / "l.info"), "head", "/r")
        assert spark.read.option("lineSep", "\nSF:").text(str(tmp_path / "l.info")).rdd.getNumPartitions() > 5
        assert rows(made, "file", "line", "hits") == sorted(((f, a, b) for f, lines in want.items() for a, b in lines.items()), key=lambda r: tuple((v is None, str(v)) for v in r))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = coverage.lcov_lines(spark.createDataFrame([("head", text.replace("\n", "\r\n")), ("head", None), ("head", "")], "tree string, text string"), "/r")
    assert rows(whole) == rows(made)


SOURCE = """import def, { a, type B as C } from './x';
import type { T } from "../t";
import * as ns from 'pkg';
import './side';
import {
  long,
} from './multi';
export { q as r, s } from './y';
export * from './z';
export * as named from './w';
export type { U } from './u';
export default function main() {}
export const k = 1;
export interface I {}
export { k as kk };
"""


def test_lexical_adapter(spark):
    files = spark.createDataFrame([("h", "f.ts", SOURCE)], "tree string, file string, text string")
    assert rows(lexical.imports(files).select("name", "spec", "type_only", "line")) == sorted(
        [("default", "./x", False, 1), ("a", "./x", False, 1), ("B", "./x", False, 1), ("T", "../t", True, 2), ("*", "pkg", False, 3), (None, "./side", False, 4), ("long", "./multi", False, 5)], key=lambda r: tuple((v is None, str(v)) for v in r)
    )
    assert rows(lexical.reexports(files).select("star", "exported", "source", "spec", "type_only")) == sorted(
        [(False, "r", "q", "./y", False), (False, "s", "s", "./y", False), (True, None, None, "./z", False), (False, None, None, "./w", False), (False, "U", "U", "./u", True)], key=lambda r: tuple((v is None, str(v)) for v in r)
    )
    assert rows(lexical.exports(files).select("name", "line", "type_only")) == [("I", 14, True), ("default", 12, False), ("k", 13, False), ("kk", 15, False)]


def test_barrels(spark):
    s = spark.createDataFrame([("t", "a", True, False), ("t", "a", False, True), ("t", "b", False, True), ("t", "b", False, False), ("t", "c", True, False)], "tree string, file string, is_import boolean, is_reexport boolean")
    assert rows(modules.barrels(s)) == [("t", "a", True), ("t", "b", False), ("t", "c", False)]


def test_crossings_roll_up(spark):
    c = spark.createDataFrame([("call", "f", "x", 2, "m", True), ("call", "f", "x", 1, "n", False), ("ref", "g", "x", 3, "m", True)], "kind string, name string, file string, seq int, module string, type_only boolean")
    once = rollups.distinct_crossings(c)
    assert rows(once) == [("call", "f", "x", 2, "n", False), ("ref", "g", "x", 1, "m", True)]
    assert rows(rollups.roll_up(once, ["module"])) == [("m", 0, 1, True, ("g",)), ("n", 2, 0, False, ("f",))]


def test_counts_compared(spark):
    fns = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "file string, own int")
    tokens = rollups.token_counts(spark.createDataFrame([("a", "if"), ("a", "for"), ("a", "x"), ("b", "if"), ("b", "if")], "file string, token string"), ["file"], ("if", "for"))
    beside = spark.createDataFrame([("b", 0)], "file string, decisions long")
    assert rows(rollups.compare_counts(fns, beside, tokens)) == [("b", 1, 2)]


def test_boundary_status_and_importers(spark):
    key = "tree string, module string, name string"
    names = spark.createDataFrame([("t", "m", n) for n in "abc"], key)
    declared = spark.createDataFrame([("t", "m", "a", False, "m/index.ts"), ("t", "m", "b", True, "m/deep.ts")], key + ", type_only boolean, file string")
    bypassed = spark.createDataFrame([("t", "m", "b")], key)
    used = spark.createDataFrame([("t", "m", "b", "n"), ("t", "m", "a", None)], key + ", by string")
    entries = spark.createDataFrame([("t", "m", "m/index.ts")], "tree string, module string, entry string")
    got = rows(symbol.boundary_status(names, declared, bypassed, used, entries, names.where("false")))
    assert got == [("t", "m", "a", True, True, False, False, True, ()), ("t", "m", "b", True, False, True, True, False, ("n",)), ("t", "m", "c", False, False, False, False, False, ())]
    imports = spark.createDataFrame([("t", "n/x.ts", 3, "R", "@m", False, "m/index.ts"), ("t", "n/y.ts", 1, "Q", "@m", False, "m/index.ts")], "tree string, from_file string, line int, name string, spec string, type_only boolean, to_file string")
    origins = spark.createDataFrame([("t", "m/index.ts", "R", "m/r.ts", "Real")], "tree string, file string, name string, origin_file string, origin_name string")
    at = spark.createDataFrame([("t", "n/x.ts", "n")], "tree string, file string, module string")
    assert rows(symbol.importers(imports, origins, at, "m/r.ts", "Real")) == [("t", "n/x.ts", 3, "@m", "R", False, "n")]


def test_callers_and_closest_packages(spark):
    calls = spark.createDataFrame([("f", "g", 1, "g()"), ("h", "g", 2, "g()"), ("f", "h", 3, "h()")], "from_fn string, to_fn string, line int, text string")
    fns = spark.createDataFrame([("f", "a.ts", "f"), ("h", "b.ts", "h"), ("g", "c.ts", "g")], "fn_id string, file string, name string")
    sites, skipped = symbol.callers(calls, spark.createDataFrame([("g",)], "fn_id string"), fns, max_files=1)
    assert rows(sites) == [("a.ts", 1, "f", "g()")] and skipped == 1
    files = spark.createDataFrame([("t", "p/q/x.ts"), ("t", "p/y.ts"), ("t", "z.ts")], "tree string, file string")
    ws = spark.createDataFrame([("t", "P", "p"), ("t", "Q", "p/q")], "tree string, pkg string, dir string")
    assert rows(modules.package_of(files, ws)) == [("t", "p/q/x.ts", "Q", "p/q"), ("t", "p/y.ts", "P", "p")]


def test_queries_and_their_sql_name_the_same():
    import __spark_entry__ as entry

    assert {*entry.oracle_sql()} <= {*entry.queries()} and len(entry.queries()) >= 38
