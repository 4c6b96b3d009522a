"""Names, callees, seeds and closures: relations against brute force, and whole programs whose facts are known."""

import random

import pytest

from ripplescope.operators import graph, modules, names, rollups, symbol
from ripplescope.sources import lexical, program

from .conftest import rows


def order(found):
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_visible_declarations_equal_brute_force(spark):
    rnd = random.Random(1)
    spans = [(rnd.choice("ab"), f"d{i}", rnd.choice("xyz"), a, a + rnd.randrange(12)) for i in range(80) for a in [rnd.randrange(40)]] + [("a", "e1", "x", -1, 2**31 - 1), ("a", "e2", "x", -1, 2**31 - 1), (None, "e3", "x", 0, 9), ("a", "e4", None, 0, 9)]
    uses = [(rnd.choice("abc"), i, rnd.choice("xyzw"), rnd.randrange(50)) for i in range(80)] + [(None, 90, "x", 3), ("a", 91, None, 3)]
    want = []
    for key, use, name, at in uses:
        met = [(b - a, -a, d) for k, d, n, a, b in spans if k is not None and n is not None and (k, n) == (key, name) and a <= at <= b]
        want += [(key, use, d) for length, start, d in met if (length, start) == min(met)[:2]]
    u, d = spark.createDataFrame(uses, "k string, use int, name string, at int"), spark.createDataFrame(spans, "k string, decl string, name string, from int, to int")
    for bucket in (None, 7):
        some = d.where("to < 1000") if bucket else d
        kept = [w for w in want if not bucket or not w[2].startswith("e")]
        if not bucket:
            assert rows(names.visible_declarations(u, some, ["k"])) == order(want)
        else:
            assert set(kept) <= set(rows(names.visible_declarations(u, some, ["k"], bucket)))
    assert names.visible_declarations(u.where("false"), d, ["k"]).count() == names.visible_declarations(u, d.where("false"), ["k"]).count() == 0


def test_chosen_callees_and_seeds(spark):
    kinds = ("function", "class", "variable", "abstract", "parameter", "function-type", "signature", "interface", "import")
    place = {"class": 1, "variable": 1, "abstract": 2, "parameter": 3, "function-type": 3, "signature": 4, "interface": 4}
    outcome = ("body", "holder", "abstract", "function-type", "interface", "external")
    rnd = random.Random(2)
    calls = [("k", i, bool(i % 2)) for i in range(60)]
    candidates = [("k", rnd.randrange(50), f"d{j}", kind, kind == "function" and rnd.random() < 0.5 or None) for j in range(90) for kind in [rnd.choice(kinds)]]
    want = []
    for k, call, by_name in calls:
        met = [(0 if body else place.get(kind, 5), d) for _, c, d, kind, body in candidates if c == call]
        best = min(met)[0] if met else None
        want += [(k, call, outcome[best], d) for p, d in met if p == best] if met else [(k, call, "unresolved" if by_name else "dynamic", None)]
    got = names.choose_callees(spark.createDataFrame(calls, "k string, call int, by_name boolean"), spark.createDataFrame(candidates, "k string, call int, decl string, kind string, has_body boolean"), ["k"])
    assert rows(got) == order(want)
    declared = spark.createDataFrame([("k", "C", "class", None, 1), ("k", "D", "class", None, 2), ("k", "v", "variable", 7, None), ("k", "w", "variable", None, None)], "k string, decl string, kind string, fn int, body int")
    functions = spark.createDataFrame([("k", 4, 1), ("k", 5, 1), ("k", 6, None), ("k", 7, 3)], "k string, fn int, holder int")
    assert rows(names.seed_functions(declared, functions, ["k"])) == [("k", "C", 4), ("k", "C", 5), ("k", "v", 7)]


def test_parents_equal_brute_force(spark):
    rnd = random.Random(3)
    spans = [(rnd.choice("ab"), i, a, a + rnd.randrange(15)) for i in range(70) for a in [rnd.randrange(25)]]
    want = []
    for k, i, a, b in spans:
        met = [(d - c, j) for m, j, c, d in spans if m == k and j != i and c <= a and d >= b and (d - c > b - a or j < i)]
        want += [(k, i, min(met)[1])] if met else []
    table = spark.createDataFrame(spans, "k string, id int, start int, end int")
    assert rows(names.parents(table, ["k"])) == order(want)


def test_alias_chains_end_in_a_logarithm_of_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, label, f=graph.materialize: written.append(label) or f(df, label))
    chain = [("c", i, i + 1) for i in range(1000)]
    other = [("d", 1, 2), ("d", 2, 3), ("d", 3, 1), ("d", 4, 1), ("d", 5, 5), ("d", 6, 8), ("d", 6, 7), ("d", None, 1), ("d", 9, None), (None, 1, 2)]
    made = graph.follow_aliases(spark.createDataFrame(chain + other, "k string, src int, dst int"), ["k"])
    assert rows(made) == order([("c", i, 1000, 1000 - i) for i in range(1000)] + [("d", 6, 7, 1)])
    assert len(written) <= 12
    assert graph.follow_aliases(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_references_cross_edges(spark):
    functions = spark.createDataFrame([("f", "f", "m/a/f.ts", "m/a", "p"), ("g", "g", "m/a/g.ts", "m/a", "p")], "fn_id string, name string, file string, module string, package string").selectExpr("*", "1 AS start", "9 AS end", "1 AS own", "0 AS inline")
    calls, stops = spark.createDataFrame([("f", "g")], "from_fn string, to_fn string"), spark.createDataFrame([], "from_fn string, reason string")
    uses = [("f", "reference", "T", "m/a/g.ts", "m/a", "p", False, True), ("g", "reference", "T", "m/b/h.ts", "m/b", "p", False, True), ("g", "reference", "T", "m/b/h.ts", "m/b", "p", False, False), ("g", "call", "x", None, None, "lib", True, False), ("f", "reference", "U", "z.ts", None, None, False, False)]
    references = spark.createDataFrame(uses, "from_fn string, kind string, name string, file string, module string, package string, external boolean, type_only boolean")
    seeds = spark.createDataFrame([("S", "f")], "symbol string, fn_id string")
    want = {
        "file": {("call", "g", "m/a", 1, False), ("reference", "T", "m/a", 1, True), ("reference", "U", None, 1, False)},
        "module": {("reference", "T", "m/b", 2, False), ("call", "x", None, 1, False), ("reference", "U", None, 1, False)},
        "package": {("call", "x", None, 1, False), ("reference", "U", None, 1, False)},
        "repo": {("call", "x", None, 1, False)},
    }
    for kind, crossed in want.items():
        walk = symbol.walk(seeds, functions, calls, stops, kind, references=references)
        assert {(r.kind, r["name"], r.module, r["count"], r.type_only) for r in walk.crossings.collect()} == crossed
    packages = rollups.roll_up(walk.crossings.where("external"), ["package"])
    assert rows(packages, "package", "calls", "references", "names") == [("lib", 1, 0, ("x",))]


A = """import { help as h, Shape } from './b';
import * as lib from './b';
export class Store extends Shape {
  private shape: Shape;
  save(n) { this.write(n); this.area(); h(n); lib.help(n); }
  write(n: Sink) { n.put(1); unknown(n); (n.x)(1); }
}
export const run = async (cb, s: Shape) => {
  const steps: Array<() => Promise<void>> = [];
  steps.push(() => h(1));
  steps.push(async () => void cb());
  steps.push(local);
  await Promise.all(steps.map((step) => step()));
  const st = new Store();
  st.save(2); s.area(); s.later();
  if (cb) { const h = (x) => x; h(2); }
  const held = [local, () => 2]; leak(held); held.forEach((q) => q());
  function local() { return h(3) }
};
interface Sink { put(n: number): void; other: string }
export default function () { run(1) }
for (const x of []) { var late = 1 }
"""
B = """export function help(x) { return x ? 1 : 2 }
export abstract class Shape { area() { return 1 } abstract later(): void; }
"""
CALLS = {
    (5, "save", "write", "write"), (5, "save", "area", "area"), (5, "save", "h", "help"), (5, "save", "help", "help"), (10, "run", "h", "help"), (10, "", "h", "help"), (13, "run", "step", "local"), (13, "", "step", "local"),
    (14, "run", "Store", "save"), (14, "run", "Store", "write"), (15, "run", "save", "save"), (15, "run", "area", "area"), (16, "run", "h", "h"), (17, "run", "q", "local"), (17, "", "q", "local"), (18, "run", "h", "help"),
    (18, "local", "h", "help"), (21, "", "run", "run"),
}
STOPS = {
    (6, "write", "put", "interface", "a.ts"), (6, "write", "unknown", "unresolved", None), (6, "write", "", "dynamic", None), (11, "run", "cb", "function-type", "a.ts"), (11, "", "cb", "function-type", "a.ts"),
    (15, "run", "later", "abstract", "b.ts"), (17, "run", "leak", "unresolved", None), (17, "run", "q", "function-type", "a.ts"), (17, "", "q", "function-type", "a.ts"),
}

#: What an array is given or how it is used: text, whether it adds a named or an anonymous function, whether all is known after it.
ELEMENTS = (("() => a()", "", True), ("async (x) => x", "", True), ("(() => 1)", "", True), ("function () { return 2 }", "", True), ("named", "named", True), ("held", "held", True), ("unknown", None, False), ("more", None, False), ("5", None, False))
USES = (("xs.length;", True), ("for (const x of xs) { }", True), ("xs.sort();", True), ("leak(xs);", False), ("xs.fill(1);", False), ("xs.push(...more);", False), ("xs?.at(0);", True), ("const ys = xs;", False))


def generated(seed, i):
    """A program around one array, and (functions held, complete, functions with names), or None where no array is seen."""
    rnd = random.Random(f"{seed}{i}")
    parts = [rnd.choice(ELEMENTS) if rnd.random() < 0.3 else rnd.choice(ELEMENTS[:6]) for _ in range(rnd.randrange(4))]
    pushed = [rnd.choice(ELEMENTS) if rnd.random() < 0.3 else rnd.choice(ELEMENTS[:6]) for _ in range(rnd.randrange(4))]
    used = [rnd.choice(USES) if rnd.random() < 0.4 else rnd.choice(USES[:3]) for _ in range(rnd.randrange(3))]
    lines = [*(f"xs.{rnd.choice(('push', 'unshift'))}({e[0]});" for e in pushed), *(u[0] for u in used)]
    rnd.shuffle(lines)
    fixed, method = rnd.random() < 0.9, rnd.choice(("map", "some", "forEach", "reduce"))
    text = "\n".join([f"function go(more) {{ {'const' if fixed else 'let'} xs: Array<() => void> = [{', '.join(p[0] for p in parts)}];", *lines, f"xs.{method}((g) => g()); }}", "function named() {}", "const held = () => 3;"])
    every = [*parts, *pushed]
    named = {e[1] for e in every if e[1]}
    known = all(e[2] for e in every) and all(u[1] for u in used)
    return text, (len(named) + sum(e[1] == "" for e in every), known, named) if fixed else None, fixed and method != "reduce"


@pytest.fixture(scope="module")
def scanned(spark):
    texts = [("a.ts", A), ("b.ts", B), ("c.ts", None), ("d.ts", ""), *((f"g{i}.ts", generated("s", i)[0]) for i in range(60))]
    files = spark.createDataFrame([("head", *t) for t in texts], "tree string, file string, text string")
    tables = [modules.resolve_imports(t(files), files, spark.createDataFrame([], "tree string, pkg string, dir string")) for t in (lexical.imports, lexical.reexports)]
    return program.scan_program(files, *tables, lexical.exports(files))


def test_calls_and_stops_of_a_program(scanned):
    named = {r.fn_id: r.name for r in scanned.functions.collect()}
    calls = scanned.calls.where("from_fn like 'a.ts%' or from_fn like 'b.ts%'").collect()
    assert {(r.line, named[r.from_fn], r.text, named[r.to_fn]) for r in calls} == CALLS
    assert {r.text for r in calls if r.via == "closure"} == {"step", "q"}
    stops = scanned.call_stops.where("from_fn like 'a.ts%' or from_fn like 'b.ts%'").collect()
    assert {(r.line, named[r.from_fn], r.text, r.reason, r.decl_file) for r in stops} == STOPS
    seeds = scanned.decl_seeds.where("file in ('a.ts', 'b.ts')").collect()
    assert sorted((r.file, r.name, named[r.fn_id]) for r in seeds) == [("a.ts", "Store", "save"), ("a.ts", "Store", "write"), ("a.ts", "default", ""), ("a.ts", "run", "run"), ("b.ts", "Shape", "area"), ("b.ts", "help", "help")]


def test_references_of_a_program(spark):
    texts = {"a.ts": "import { deep as d, type T } from './r0';\nimport * as ns from './z';\nimport React, { use } from '@x/react/sub';\nexport function f(p: T) { d(); ns.q(); use(React); const r = (d) => d; return { d: 1, e: d } }"}
    texts |= {f"r{i}.ts": f"export {{ deep, T }} from './r{i + 1}';" for i in range(9)} | {"r9.ts": "export * from './z';", "z.ts": "export function deep() {}\nexport type T = string\nexport function q() {}"}
    files = spark.createDataFrame([("t", *x) for x in texts.items()], "tree string, file string, text string")
    tables = [modules.resolve_imports(t(files), files, spark.createDataFrame([], "tree string, pkg string, dir string")) for t in (lexical.imports, lexical.reexports)]
    made = program.scan_program(files, *tables, lexical.exports(files))
    got = [(r.kind, r["name"], r.file, r.package, r.type_only) for r in made.references.where("from_fn like 'a.ts%'").collect() if r.line == 4]
    want = [("reference", "T", "z.ts", None, True), *[("reference", "d", "z.ts", None, False)] * 2, ("reference", "ns", "z.ts", None, False), ("reference", "use", None, "@x/react", True), ("call", "use", None, "@x/react", False), ("reference", "React", None, "@x/react", True)]
    assert order(got) == order(want)
    named = {r.fn_id: (r.file, r.name) for r in made.functions.collect()}
    assert {(r.text, *named[r.to_fn]) for r in made.calls.collect()} == {("d", "z.ts", "deep"), ("q", "z.ts", "q")}


def test_closures_of_generated_programs(scanned):
    arrays, calls, stops = {}, {}, set()
    for r in scanned.arrays.where("file like 'g%'").collect():
        arrays.setdefault(r.file, []).append((r.fn, r.complete))
    named = {r.fn_id: r.name for r in scanned.functions.collect()}
    for r in scanned.calls.where("text = 'g' and from_fn like 'g%'").collect():
        calls.setdefault(r.from_fn.split("#")[0], set()).add(named[r.to_fn])
    for r in scanned.call_stops.where("text = 'g'").collect():
        assert r.reason == "function-type"
        stops.add(r.from_fn.split("#")[0])
    seen = set()
    for i in range(60):
        _, want, followed = generated("s", i)
        file = f"g{i}.ts"
        got = arrays.get(file)
        assert (got is None) == (want is None)
        if want:
            assert (sum(f is not None for f, _ in got), {c for _, c in got}) == (want[0], {want[1]})
        assert calls.get(file, set()) == (want[2] if want and followed else set())
        assert (file in stops) == (not (want and followed and want[1]))
        seen.add((want and want[1], followed))
    assert len(seen) == 5
