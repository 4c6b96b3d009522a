"""Growing programs: equal to recomputation from scratch after every round; sources of built files."""

import random

from ripplescope.operators import growth

from .conftest import rows

SCHEMAS = {
    "seeds": "tree string, seed string, fn int", "calls": "tree string, src int, dst int", "built_calls": "tree string, src int, file string, name string", "sources": "tree string, file string, source string",
    "declared": "tree string, file string, name string, fn int", "loaded": "tree string, file string", "imports": "tree string, src string, dst string",
}


def closed(start, edges):
    found, frontier = set(start), set(start)
    while frontier:
        frontier = {d for s, d in edges if s in frontier} - found
        found |= frontier
    return found


def from_scratch(t, rounds):
    """Loads and walks the whole program again in each round."""
    loaded, first_file, first_fn, wanted = set(t["loaded"]), {}, {}, set()
    for turn in range(rounds + 1):
        loaded = closed(loaded | wanted, t["imports"])
        source = dict(t["sources"])
        asks = [(s, source[f], n) for s, f, n in t["built_calls"] if f in source]
        edges = set(t["calls"]) | {(s, fn) for s, f, n in asks if f in loaded for file, name, fn in t["declared"] if (file, name) == (f, n)}
        for seed in {s for s, _ in t["seeds"]}:
            for fn in closed({f for s, f in t["seeds"] if s == seed}, edges):
                first_fn.setdefault((seed, fn), turn)
        for file in loaded:
            first_file.setdefault(file, turn)
        wanted = {f for s, f, _ in asks if any(fn == s for _, fn in first_fn)} - loaded
        if not wanted:
            break
    return first_file, first_fn, wanted


def program(rnd, files, functions):
    name, some = (lambda f: f"s{f}"), (lambda n, make: list({make() for _ in range(n)}))
    return {
        "seeds": [("x", 0), ("x", 1), ("y", functions - 1)],
        "calls": some(functions // 2, lambda: (rnd.randrange(functions), rnd.randrange(functions))),
        "built_calls": some(functions, lambda: (rnd.randrange(functions), f"d{rnd.randrange(files + 3)}", rnd.choice("abc"))),
        "sources": [(f"d{f}", name((f * 3 + 1) % files)) for f in range(files)],
        "declared": some(functions, lambda: (name(rnd.randrange(files)), rnd.choice("abc"), rnd.randrange(functions))),
        "loaded": [(name(0))],
        "imports": some(files // 3, lambda: (name(rnd.randrange(files)), name(rnd.randrange(files)))),
    }


def frames(spark, programs, spoil=True):
    out = {}
    for table, schema in SCHEMAS.items():
        held = [(tree, *(row if isinstance(row, tuple) else (row,))) for tree, t in programs.items() for row in t[table]]
        nulls = [tuple([None] * len(schema.split(",")))] + [("b", *[None] * (len(schema.split(",")) - 1))] if spoil else []
        out[table] = spark.createDataFrame(held + held[:2] + nulls, schema)
    return out


def test_growth_equals_recomputation(spark):
    met = set()
    for seed, rounds in ((5, 3), (8, 3), (11, 1)):
        rnd = random.Random(seed)
        programs = {"b": program(rnd, 30, 40), "h": program(rnd, 24, 60)}
        got = growth.grow(**frames(spark, programs), rounds=rounds)
        want = {tree: from_scratch(t, rounds) for tree, t in programs.items()}
        assert {tuple(r) for r in got.loaded.collect()} == {(tree, f, n) for tree, w in want.items() for f, n in w[0].items()}
        assert rows(got.reached) == sorted(((tree, s, f, n) for tree, w in want.items() for (s, f), n in w[1].items()), key=lambda r: tuple((False, str(v)) for v in r))
        assert {tuple(r) for r in got.pending.collect()} == {(tree, f) for tree, w in want.items() for f in w[2]}
        assert got.reached.count() == got.reached.select("tree", "seed", "fn").distinct().count()
        met |= {n for w in want.values() for n in w[1].values()} | {"pending" for w in want.values() if w[2]}
    assert met >= {0, 1, 2, "pending"}


def test_growth_of_empty_tables(spark):
    tables = frames(spark, {"b": program(random.Random(1), 9, 9)}, spoil=False)
    none = growth.grow(**{k: v.where("false") for k, v in tables.items()})
    assert none.loaded.count() == none.reached.count() == none.pending.count() == 0
    alone = growth.grow(**{k: v if k in ("seeds", "loaded") else v.where("false") for k, v in tables.items()})
    assert (alone.loaded.count(), alone.reached.count(), alone.pending.count()) == (1, 3, 0)


def test_sources_of_built_files(spark):
    held = ["packages/a/src/x.ts", "packages/a/src/deep/index.tsx", "packages/b/src/y.ts", "packages/b/plain.ts", "packages/b/src/plain.ts", "packages/a/src/types.d.ts", "node_modules/out/src/z.ts"]
    files = spark.createDataFrame([("t", f) for f in held], "tree string, file string")
    workspace = spark.createDataFrame([("t", "@s/a", "packages/a"), ("t", "b", "packages/b"), ("t", "@s/a/deeper", "packages/none")], "tree string, pkg string, dir string")
    want = {
        "packages/a/dist/x.d.ts": "packages/a/src/x.ts",
        "packages/a/dist/deep.js": "packages/a/src/deep/index.tsx",
        "node_modules/@s/a/dist/x.d.ts": "packages/a/src/x.ts",
        "packages/a/node_modules/b/node_modules/@s/a/dist/deep/index.d.ts": "packages/a/src/deep/index.tsx",
        "node_modules/b/y.d.ts": "packages/b/src/y.ts",
        "node_modules/b/plain.d.ts": "packages/b/src/plain.ts",
    }
    lost = ["node_modules/out/dist/z.d.ts", "packages/a/dist/gone.d.ts", "packages/a/src/x.ts", "node_modules/@s/a/dist/types.d.ts", "node_modules/@s/a/deeper/dist/x.d.ts", None]
    built = spark.createDataFrame([("t", f) for f in (*want, *want, *lost)], "tree string, file string")
    assert {(r.file, r.source) for r in growth.built_sources(built, files, workspace).collect()} == set(want.items())
    assert growth.built_sources(built.where("false"), files, workspace).count() == growth.built_sources(built, files, workspace.where("false")).where("file like 'node%'").count() == 0
