"""Bounded graph operators over edge tables. Every key may carry leading columns such as tree.

A search is a loop of joins. A round takes the frontier a few hops on, drops what was seen, and is written once to the shared
folder, so the plan of a round never contains the rounds before it. A path is never enumerated: only (seed, node) pairs are kept,
each at its least hops.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .components import connected_components

#: Hops of one round: each costs a join and a shuffle, a round also a join with all that was seen and a table that is written.
ROUND_HOPS = 3
#: Tables of more rows are never broadcast in a search: each round would send them through the driver again.
BROADCAST_ROWS = 100_000
#: Sums over what is reached take graphs apart at hubs above so many edges, in so many turns at most.
HUB_EDGES, HUB_TURNS = 1_000, 5


def _beside(df: DataFrame, rows: int) -> DataFrame:
    """df as the side of a join that a loop repeats: shuffled where it is large, by Spark's own choice else."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def bfs(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None, keys: Sequence[str] = (), budget: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """edges(keys.., src, dst), seeds(keys.., seed, node) to (keys.., seed, node, hops) at the least hops; seeds are at 0.

    A seed that has met more than budget nodes at the end of a round goes no further; all nodes up to the hops it came to are
    there, so its first budget nodes by hops are those of the whole search, and it has more of them just where that has.
    known(keys.., seed, node) was met by an earlier search: it is neither entered nor returned nor part of the budget.
    Cycles and self-loops are harmless; max_hops None runs until nothing new is found. Rows with null keys or ends are no edges,
    and a null node leads nowhere.
    """
    keys = [*keys]
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, "src", "dst")])
    edges = materialize(edges.select(*keys, "src", "dst").where("src <> dst").where(whole).distinct(), "edges")
    start = seeds.select(*keys, "seed", "node").distinct()
    met_before = [] if known is None else [known.select(*keys, "seed", "node")]
    met_rows = 0 if known is None else known.count()
    for before in met_before:
        start = start.join(_beside(before, met_rows), [*keys, "seed", "node"], "left_anti")
    frontier = materialize(start.withColumn("hops", F.lit(0)), "hop")
    rounds, hops = [frontier], 0
    onward = _beside(edges, edges.count())
    met = None  # how many nodes each seed has
    while (max_hops is None or hops < max_hops) and not frontier.isEmpty():
        met_rows += rounds[-1].count()
        ahead, at = [], frontier.drop("hops")
        for _ in range(ROUND_HOPS if max_hops is None else min(ROUND_HOPS, max_hops - hops)):
            hops += 1
            at = at.withColumnRenamed("node", "src").join(onward, [*keys, "src"]).select(*keys, "seed", F.col("dst").alias("node")).distinct()
            ahead.append(at.withColumn("hops", F.lit(hops)))
        found = reduce(DataFrame.unionByName, ahead).groupBy(*keys, "seed", "node").agg(F.min("hops").alias("hops")) if len(ahead) > 1 else ahead[0]
        # what lies nearer may have been seen in any round; only nodes at the last hop have not led on yet
        seen = reduce(DataFrame.unionByName, [r.select(*keys, "seed", "node") for r in rounds] + met_before)
        rounds.append(materialize(found.join(_beside(seen, met_rows), [*keys, "seed", "node"], "left_anti"), "hop"))
        frontier = rounds[-1].where(F.col("hops") == hops)
        if budget is not None:
            counts = [r.groupBy(*keys, "seed").agg(F.count("*").alias("n")) for r in (rounds if met is None else rounds[-1:])] + ([] if met is None else [met])
            met = materialize(reduce(DataFrame.unionByName, counts).groupBy(*keys, "seed").agg(F.sum("n").alias("n")), "met")
            frontier = frontier.join(met.where(F.col("n") > budget), [*keys, "seed"], "left_anti")
    return reduce(DataFrame.unionByName, rounds)


def indirect_deps(direct: DataFrame, max_hops: int = 5, keys: Sequence[str] = (), only: DataFrame | None = None) -> DataFrame:
    """direct(keys.., src, dst) to (keys.., src, dst, hops): what each node reaches in 2 to max_hops hops but not in fewer.

    only(src) limits the search to those nodes from the start.
    """
    seeds = direct.select(*keys, F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
    if only is not None:
        seeds = seeds.join(only.select(F.col("src").alias("seed")).distinct(), "seed", "left_semi")
    found = bfs(direct, seeds, max_hops, keys).where("hops >= 2")
    return found.select(*keys, F.col("seed").alias("src"), F.col("node").alias("dst"), "hops")


def reach_from_set(direct: DataFrame, start: DataFrame, max_hops: int = 5, exclude: DataFrame | None = None) -> DataFrame:
    """start(node) is one seed set at hop 1; (node, hops) of what lies 2 to max_hops hops away, without the nodes of exclude."""
    seeds = start.select(F.lit(0).alias("seed"), "node")
    found = bfs(direct, seeds, max_hops - 1).where("hops >= 1").select("node", (F.col("hops") + 1).alias("hops"))
    return found.join(exclude.select("node"), "node", "left_anti") if exclude is not None else found


def closure(edges: DataFrame, seeds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All (keys.., seed, node) that the seeds reach, themselves included."""
    return bfs(edges, seeds, None, keys).drop("hops")


def reach_sums(edges: DataFrame, weights: DataFrame, seeds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """edges(keys.., src, dst), weights(keys.., node, numbers..), seeds(keys.., node) to (keys.., node, numbers..): sums over the
    distinct nodes that a seed reaches, itself included, where a node without weights counts nothing. Seeds that reach no weight have no row.

    What is reached is not listed by seed where a hub has it in common. D is what a hub reaches, U what reaches the hub: a seed of
    U has the sum of D and what it reaches without D, a seed outside U never comes to U. So a turn searches from hubs only and leaves
    two smaller graphs, and only pairs of these are listed in the end. Graphs are taken apart while they hold more paths of two hops
    than edges, that is, while searches widen; from the second turn on every connected part has its own hub.
    """
    keys, numbers = [*keys], [c for c in weights.columns if c not in (*keys, "node")]
    within = [*keys, "side", "part"]
    zero = [F.lit(0).alias("side"), F.lit(0).cast("long").alias("part")]
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, "src", "dst")])
    edges = materialize(edges.select(*keys, *zero, "src", "dst").where("src <> dst").where(whole).distinct(), "edges")
    seeds = seeds.select(*keys, *zero, "node").distinct()
    most = edges.count()
    shares: list[DataFrame] = []
    for turn in range(HUB_TURNS if most > HUB_EDGES else 0):
        hubs, widens = _hubs(edges, within)
        if not widens or edges.count() > 4 * most:
            break
        if turn:
            edges, seeds = _connected(edges, seeds, keys)
            hubs, _ = _hubs(edges, within)
        there = edges.withColumn("back", F.lit(False)).unionByName(edges.select(*within, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back")))
        start = hubs.select(*within, F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), F.col("node").alias("seed"), "node")
        met = materialize(bfs(there, start, None, [*within, "back"]).select(*within, "back", "node"), "met")
        below, above = met.where("not back").drop("back"), met.where("back").drop("back")
        common = below.join(weights, [*keys, "node"]).groupBy(*within).agg(*[F.sum(c).alias(c) for c in numbers])
        shares.append(materialize(seeds.join(above, [*within, "node"], "left_semi").join(common, within).select(*keys, "node", *numbers), "share"))
        side = lambda df, n: df.withColumn("side", F.col("side") * 2 + n)
        rest = side(seeds.join(above, [*within, "node"], "left_anti"), 0).unionByName(side(seeds.join(above, [*within, "node"], "left_semi").join(below, [*within, "node"], "left_anti"), 1))
        far = edges.join(hubs.select(*within), within, "left_semi").join(below.withColumnRenamed("node", "dst"), [*within, "dst"], "left_anti")
        near = edges.join(above.withColumnRenamed("node", "src"), [*within, "src"], "left_anti")
        edges, seeds = materialize(side(near, 0).unionByName(side(far, 1)), "edges"), materialize(rest, "seeds")
    left = bfs(edges, seeds.withColumn("seed", F.col("node")), None, within).join(weights, [*keys, "node"])
    shares.append(left.groupBy(*keys, F.col("seed").alias("node")).agg(*[F.sum(c).alias(c) for c in numbers]))
    return reduce(DataFrame.unionByName, shares).groupBy(*keys, "node").agg(*[F.sum(c).alias(c) for c in numbers])


def _hubs(edges: DataFrame, within: list[str]) -> tuple[DataFrame, bool]:
    """The node of most paths of two hops in each part that holds more of these than edges, and whether such parts hold most of all.

    Edges out of nodes that nothing leads to, and into nodes that lead nowhere, do not widen a search and are not counted.
    """
    entered, left = edges.select(*within, F.col("dst").alias("src")).distinct(), edges.select(*within, F.col("src").alias("dst")).distinct()
    core = materialize(edges.join(entered, [*within, "src"], "left_semi").join(left, [*within, "dst"], "left_semi"), "core")
    ends = core.select(*within, F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(core.select(*within, F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    degrees = ends.groupBy(*within, "node").agg((F.sum("i") * F.sum("o")).alias("through"), F.sum("o").alias("out"))
    parts = materialize(degrees.groupBy(*within).agg(F.max_by("node", F.struct("through", "node")).alias("node"), F.sum("through").alias("through"), F.sum("out").alias("out")), "hubs")
    wide = F.col("through") > F.col("out")
    widening, count = parts.agg(F.sum(F.when(wide, F.col("through"))), F.sum("out")).first()
    return parts.where(wide).drop("through", "out"), (widening or 0) * 2 > (count or 0)


def _connected(edges: DataFrame, seeds: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """edges and seeds with the connected part of each as part. Parts of one side share no node, so that a hash may take two for one changes no sum."""
    within = [*keys, "side"]
    code = lambda c: F.xxhash64(*within, c)
    roots = materialize(connected_components(edges.select(code("src").alias("u"), code("dst").alias("v"))), "parts")
    of = lambda df, c: df.withColumn("h", code(c)).join(roots.withColumnRenamed("node", "h"), "h", "left")
    part = F.coalesce("root", "h").alias("part")  # a root has no row
    edges = of(edges, "src").select(*within, part, "src", "dst")
    seeds = of(seeds, "node").select(*within, part, "node")
    return materialize(edges, "edges"), materialize(seeds, "seeds")


def dependents(direct: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys.., node, dependent): who depends on a node directly."""
    return direct.select(*keys, F.col("dst").alias("node"), F.col("src").alias("dependent")).distinct()


def blast_radius(direct: DataFrame, touched: DataFrame) -> DataFrame:
    """touched(node) to (node): direct dependents of touched nodes that are not touched."""
    near = direct.join(touched.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    return near.join(touched, "node", "left_anti")


def follow_reexports(exports: DataFrame, reexports: DataFrame, wanted: DataFrame, depth: int = 6) -> DataFrame:
    """wanted(tree, file, name) to (tree, file, name, origin_file, origin_name, chain): where a name is declared.

    A file's own export wins; then its named re-exports by statement, then its `export *` by statement, each searched in
    full before the next. depth + 1 files are visited at most on a chain. Every search path carries its precedence as an
    array, and the declared end with the smallest array wins, which is the order of a depth-first search. A path stops at a
    (file, name) that it has visited; paths do not share what they have visited, so a name that a shorter path may still
    reach is found here even if a longer one met its file first. Names that are not found have no row.
    """
    own = exports.select("tree", "file", "name").distinct()
    hops = reexports.where("to_file is not null").select(
        "tree", F.col("from_file").alias("at"), "star", "exported", "source", "to_file",
        F.array(F.col("star").cast("int"), F.col("stmt_no"), F.coalesce("pos", F.lit(0))).alias("step"),
    )
    state = wanted.select("tree", "file", "name", F.col("file").alias("at"), F.col("name").alias("want"), F.array().cast("array<int>").alias("order"), F.array(F.concat_ws("#", "file", "name")).alias("seen"))
    ends: list[DataFrame] = []
    for step in range(depth + 1):
        state = materialize(state, "reexports")
        here = own.select("tree", F.col("file").alias("at"), F.col("name").alias("want"))
        ends.append(state.join(here, ["tree", "at", "want"], "left_semi").select("tree", "file", "name", F.col("at").alias("origin_file"), F.col("want").alias("origin_name"), "order", F.lit(step).alias("chain")))
        left = state.join(here, ["tree", "at", "want"], "left_anti")
        if step == depth or left.isEmpty():
            break
        moved = left.join(hops, ["tree", "at"]).where("star or exported = want")
        moved = moved.withColumns({"want": F.when(F.col("star"), F.col("want")).otherwise(F.col("source")), "at": F.col("to_file")})
        key = F.concat_ws("#", "at", "want")
        state = moved.where(~F.array_contains("seen", key)).select("tree", "file", "name", "at", "want", F.concat("order", "step").alias("order"), F.concat("seen", F.array(key)).alias("seen"))
    found = reduce(DataFrame.unionByName, ends)
    best = found.groupBy("tree", "file", "name").agg(F.min(F.struct("order", "origin_file", "origin_name", "chain")).alias("x"))
    return best.select("tree", "file", "name", "x.origin_file", "x.origin_name", "x.chain")


def follow_aliases(aliases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """aliases(keys.., src, dst) to (keys.., src, end, hops): where a chain of aliases ends, by pointer jumping.

    A round doubles the length of every pointer that does not reach an end yet, so a chain of n aliases takes log2(n) rounds, each
    a join of pointers on their ends. Of several targets of one alias the least counts. Aliases on or before a cycle have no end
    and no row; rows with nulls are no aliases.
    """
    keys = [*keys]
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, "src", "dst")])
    first = aliases.where(known).groupBy(*keys, "src").agg(F.min("dst").alias("end"))
    starts = first.select(*keys, F.col("src").alias("end"), F.lit(True).alias("more"))
    state = materialize(first.join(starts, [*keys, "end"], "left").select(*keys, "src", "end", F.lit(1).cast("long").alias("hops"), F.col("more").isNull().alias("done")), "aliases")
    rounds, total = 0, state.count()
    while state.where("not done").limit(1).count() and 1 << rounds < total:
        on = state.select(*keys, F.col("src").alias("end"), F.col("end").alias("to"), F.col("hops").alias("further"), F.col("done").alias("ended"))
        moved = state.where("not done").join(on, [*keys, "end"]).select(*keys, "src", F.col("to").alias("end"), (F.col("hops") + F.col("further")).alias("hops"), F.col("ended").alias("done"))
        state = materialize(state.where("done").unionByName(moved), "aliases")
        rounds += 1
    return state.where("done").drop("done")


def chain_depths(reexports: DataFrame, depth: int = 12) -> DataFrame:
    """(tree, depth, barrels): how many files start a re-export chain of each greatest length."""
    edges = reexports.where("to_file is not null").select("tree", F.col("from_file").alias("src"), F.col("to_file").alias("dst")).distinct()
    starts = edges.select("tree", F.col("src").alias("file"), F.col("src").alias("at")).distinct()
    rounds, state = [], starts
    for d in range(1, depth + 1):
        state = materialize(state.join(edges, (state["tree"] == edges["tree"]) & (state["at"] == edges["src"])).select(state["tree"], "file", F.col("dst").alias("at")).distinct(), "chain")
        if state.isEmpty():
            break
        rounds.append(state.select("tree", "file").distinct().withColumn("depth", F.lit(d)))
    if not rounds:
        return reexports.sparkSession.createDataFrame([], "tree string, depth int, barrels long")
    return reduce(DataFrame.unionByName, rounds).groupBy("tree", "file").agg(F.max("depth").alias("depth")).groupBy("tree", "depth").agg(F.count("*").alias("barrels"))


def subclasses(heritage: DataFrame, constructed: DataFrame) -> DataFrame:
    """heritage(base, name), constructed(name) to (base, name, instantiated)."""
    made = constructed.select("name").distinct().withColumn("made", F.lit(True))
    return heritage.select("base", "name").distinct().join(made, "name", "left").select("base", "name", F.coalesce("made", F.lit(False)).alias("instantiated"))
