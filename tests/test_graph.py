import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ripplescope.operators import graph, ranges

from .conftest import rows


def brute_hops(edges, start):
    best, frontier, h = {start: 0}, {start}, 0
    while frontier:
        h += 1
        frontier = {d for s, d in edges if s in frontier and d not in best}
        best |= dict.fromkeys(frontier, h)
    return best


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=16))
def test_indirect_deps_are_least_hops(spark, edges):
    direct = spark.createDataFrame([*edges], "src long, dst long")
    want = sorted((s, d, h) for s in {a for a, b in edges if a != b} for d, h in brute_hops({e for e in edges if e[0] != e[1]}, s).items() if 2 <= h <= 5)
    assert rows(graph.indirect_deps(direct)) == sorted(want, key=lambda r: tuple((False, str(v)) for v in r))


def test_closure_handles_cycles_and_loops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "b"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("s", "a"), ("t", "c")], "seed string, node string")
    assert rows(graph.closure(edges, seeds)) == [("s", "a"), ("s", "b"), ("s", "c"), ("t", "c")]


def test_search_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    held = [(t, rnd.randrange(40), rnd.randrange(40)) for t in ("b", "h") for _ in range(70)] + [("h", 50 + i, 51 + i) for i in range(12)]
    starts = [(t, f"s{i}", n) for t in ("b", "h") for i in range(9) for n in (i, i + 30)] + [("h", "long", 50)]
    edges = spark.createDataFrame([*held, ("b", None, 1), (None, 1, 2)], "tree string, src long, dst long")
    seeds = spark.createDataFrame([*starts, ("b", "s0", None), ("x", None, 3), ("h", "s1", 99)], "tree string, seed string, node long")
    alone = [("b", "s0", None, 0), ("x", None, 3, 0), ("h", "s1", 99, 0)]
    for limit, step in ((None, 1), (None, 4), (0, 3), (3, 2), (5, 3)):
        monkeypatch.setattr(graph, "ROUND_HOPS", step)
        want = {}
        for t, s, n in starts:
            for d, h in brute_hops({(a, b) for k, a, b in held if k == t}, n).items():
                if limit is None or h <= limit:
                    want[t, s, d] = min(h, want.get((t, s, d), h))
        assert rows(graph.bfs(edges, seeds, limit, ["tree"])) == sorted([*((*k, h) for k, h in want.items()), *alone], key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows(graph.bfs(edges.where("false"), seeds, None, ["tree"])) == sorted(rows(seeds.selectExpr("tree", "seed", "node", "0 AS hops")), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows(graph.bfs(edges, seeds.where("false"), None, ["tree"])) == []
    struct = seeds.selectExpr("tree", "struct(seed, 1 AS k) AS seed", "node")
    assert rows(graph.bfs(edges, struct, None, ["tree"]).selectExpr("tree", "seed.seed", "node", "hops")) == rows(graph.bfs(edges, seeds, None, ["tree"]))


def test_blast_radius_leaves_out_touched(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "c")], "src string, dst string")
    assert rows(graph.blast_radius(edges, spark.createDataFrame([("b",), ("c",)], "node string"))) == [("a",)]


EXPORTS = "tree string, file string, name string, line int, type_only boolean"
REEXPORTS = "tree string, from_file string, stmt_no int, pos int, star boolean, exported string, source string, to_file string"
WANTED = "tree string, file string, name string"


def follow(spark, exports, reexports, wanted, depth=6):
    return rows(graph.follow_reexports(spark.createDataFrame([("t", f, n, 1, False) for f, n in exports], EXPORTS), spark.createDataFrame([("t", *r) for r in reexports], REEXPORTS), spark.createDataFrame([("t", *w) for w in wanted], WANTED), depth), "file", "name", "origin_file", "origin_name", "chain")


def test_reexport_renames_and_precedence(spark):
    reexports = [("i", 0, 0, True, None, None, "s"), ("i", 1, 0, False, "A", "B", "n"), ("n", 0, 0, True, None, None, "d")]
    assert follow(spark, [("s", "A"), ("d", "B")], reexports, [("i", "A"), ("i", "B"), ("i", "Z")]) == [("i", "A", "d", "B", 2)]
    assert follow(spark, [("s", "A"), ("i", "A")], reexports, [("i", "A")]) == [("i", "A", "i", "A", 0)]


def test_reexport_depth_and_cycles(spark):
    chain = [(f"f{i}", 0, 0, True, None, None, f"f{i + 1}") for i in range(8)]
    assert follow(spark, [("f6", "A")], chain, [("f0", "A")]) == [("f0", "A", "f6", "A", 6)]
    assert follow(spark, [("f7", "A")], chain, [("f0", "A")]) == []
    loop = [("x", 0, 0, True, None, None, "y"), ("y", 0, 0, True, None, None, "x")]
    assert follow(spark, [], loop, [("x", "A")]) == []


def test_chain_depths(spark):
    edges = [("t", "a", 0, 0, True, None, None, "b"), ("t", "b", 0, 0, True, None, None, "c"), ("t", "d", 0, 0, True, None, None, "c")]
    assert rows(graph.chain_depths(spark.createDataFrame(edges, REEXPORTS))) == [("t", 1, 2), ("t", 2, 1)]


def test_containment_against_brute_force(spark):
    rnd = random.Random(3)
    rs = [(rnd.choice("ab"), f"r{i}", s := rnd.randrange(50), s + rnd.randrange(20)) for i in range(30)]
    ps = sorted({(rnd.choice("ab"), rnd.randrange(70)) for _ in range(40)})
    r, p = spark.createDataFrame(rs, "file string, id string, start int, end int"), spark.createDataFrame(ps, "file string, line int")
    want = sorted((f, l, i) for f, l in ps for g, i, a, b in rs if f == g and a <= l <= b)
    for bucket in (None, 7):
        assert sorted(rows(ranges.containing(p, r, ["file"], bucket=bucket), "file", "line", "id")) == want
    best = {}
    for f, l in ps:
        inside = [(b - a, i) for g, i, a, b in rs if f == g and a <= l <= b]
        if inside:
            best[f, l] = min(inside)[1]
    assert {(f, l): i for f, l, i in rows(ranges.innermost(p, r, ["file"], ["file", "line"], "id"))} == best


def test_coverage_counts_overlap_twice_and_keeps_unknown_null(spark):
    r = spark.createDataFrame([("s", "f", 1, 3), ("s", "f", 2, 2), ("u", "g", 1, 9)], "name string, file string, start int, end int")
    lines = spark.createDataFrame([("f", 2, 1), ("f", 3, 0), ("f", 9, 5)], "file string, line int, hits long")
    assert rows(ranges.line_coverage(r, lines, ["file"], ["name"])) == [("s", 2, 3, 2 / 3), ("u", 0, 0, None)]


def test_budgeted_search_holds_the_first_nodes(spark):
    rnd = random.Random(7)
    arcs = [(rnd.choice("pq"), rnd.randrange(60), rnd.randrange(60)) for _ in range(160)] + [("p", 100 + i, 101 + i) for i in range(11)]
    edges = spark.createDataFrame(arcs, "zone string, src int, dst int")
    seeds = spark.createDataFrame([(z, f"{z}{n}", n) for z in "pq" for n in (0, 1, 2, 3, 77)] + [("p", "p100", 100), ("p", "p100", 100)], "zone string, seed string, node int")
    first = lambda found, n: {s: sorted((h, x) for _, t, x, h in found if t == s)[:n] for s in {f[1] for f in found}}
    whole = rows(graph.bfs(edges, seeds, None, ["zone"]))
    for budget in (1, 11):
        some = rows(graph.bfs(edges, seeds, None, ["zone"], budget))
        assert first(some, budget) == first(whole, budget) and set(some) <= set(whole)
        for seed, met in first(whole, 10**6).items():
            assert (len(met) > budget) == (sum(t == seed for _, t, _, _ in some) > budget)
        # a chain stops in the round in which its budget ends
        assert budget > 1 or sum(s == "p100" for _, s, _, _ in some) == 1 + graph.ROUND_HOPS
    assert graph.bfs(edges, seeds.where("false"), None, ["zone"], 5).count() == 0


def test_reach_sums_list_no_pairs_below_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_EDGES", 10)
    rnd = random.Random(5)
    held = {(t, base + rnd.randrange(60), base + rnd.randrange(60)) for t, base in (("b", 0), ("b", 100), ("h", 0)) for _ in range(120)} | {("h", 200 + i, 201 + i) for i in range(9)}
    listed, search = [], graph.bfs

    def counted(edges, seeds, *rest):
        found = search(edges, seeds, *rest)
        listed.append(found.count())
        return found

    monkeypatch.setattr(graph, "bfs", counted)
    edges = spark.createDataFrame([*held, ("b", None, 1), ("b", 7, 7)], "tree string, src long, dst long")
    nodes = sorted({(t, n) for t, a, b in held for n in (a, b)} | {("b", 999)})
    weights = spark.createDataFrame([(t, n, 1, n % 7) for t, n in nodes if n != 3], "tree string, node long, reach long, n long")
    want, pairs = [], 0
    for t, n in nodes:
        met = brute_hops({(a, b) for k, a, b in held if k == t}, n)
        pairs += len(met)
        found = [m for m in met if m != 3]
        if found:
            want.append((t, n, len(found), sum(m % 7 for m in found)))
    assert rows(graph.reach_sums(edges, weights, edges.sparkSession.createDataFrame(nodes, "tree string, node long"), ["tree"])) == sorted(want, key=lambda r: tuple((False, str(v)) for v in r))
    assert pairs > 5 * sum(listed)


def _broadcasts(df):
    """What the plan that ran sends to all tasks."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("BroadcastExchange")


def test_a_search_broadcasts_no_large_tables(spark, monkeypatch):
    """Neither seen pairs nor many edges pass the driver in every round, however small Spark takes them for."""
    edges = spark.range(40).selectExpr("id src", "id + 1 dst")
    seeds = spark.createDataFrame([(0, 0), (1, 7)], "seed long, node long")
    plans, keep = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: (plans.append(_broadcasts(df)) if label == "hop" else None) or keep(df, label))
    want = sorted([(0, n, n) for n in range(8)] + [(1, n, n - 7) for n in range(7, 15)])
    assert sorted(map(tuple, graph.bfs(edges, seeds, 7).collect())) == want and max(plans) > 0
    plans.clear()
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, graph.bfs(edges, seeds, 7).collect())) == want and plans and max(plans) == 0
