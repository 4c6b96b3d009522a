"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import paths
from ..functions.text import confidence, locale_order, one_line, pad, percent, signed
from ..operators import delta, facts, fields, graph, growth, modules, names, ranges, rollups, symbol
from ..sources import coverage, patterns, trees
from .bindings import call_edges, impact_tables, order_ranges, ship_points, table, tasks_for, transitions, url_paths, with_views
from .report import build_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_EDGES = ("transitions", "call_edges")


def query(sql: str | None, *views: str, recursive: bool = False):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *views, recursive=recursive) if views else sql
        return f

    return keep


# Dependencies and graph closure


@query("SELECT src, dst, count(*) AS n, bool_and(value < 50) AS type_only FROM transitions GROUP BY src, dst", "transitions")
def direct_deps(spark, sf_dir):
    """Edges of all consecutive events: how often, and whether all are of low value."""
    uses = transitions(spark, sf_dir).select("src", "dst", (F.col("value") < 50).alias("type_only"))
    return modules.count_dependencies(uses, ["src", "dst"]).withColumnRenamed("count", "n")


_REACH = "r(src, node, h) AS (SELECT DISTINCT src, dst, 1 FROM call_edges UNION SELECT r.src, e.dst, h + 1 FROM r JOIN call_edges e ON e.src = r.node WHERE h < {n})"


@query("+" + _REACH.format(n=5) + "SELECT src, node AS dst, min(h) AS hops FROM r WHERE node <> src GROUP BY src, node HAVING min(h) >= 2", *_EDGES, recursive=True)
def indirect_deps(spark, sf_dir):
    return graph.indirect_deps(call_edges(spark, sf_dir).select("src", "dst"), 5)


@query(
    "+s AS (SELECT DISTINCT arg_max(user_id, {'v': value, 'e': event_id}) AS node FROM events GROUP BY event_type),"
    "r(node, h) AS (SELECT node, 1 FROM s UNION SELECT e.dst, h + 1 FROM r JOIN call_edges e ON e.src = r.node WHERE h < 5)"
    "SELECT node, min(h) AS hops FROM r GROUP BY node HAVING min(h) >= 2",
    *_EDGES, recursive=True,
)
def reach_from_set(spark, sf_dir):
    """What the users with the dearest event of each type reach together."""
    start = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("user_id", F.struct("value", "event_id")).alias("node")).select("node").distinct()
    return graph.reach_from_set(call_edges(spark, sf_dir), start, 5)


@query("SELECT DISTINCT dst AS node, src AS dependent FROM call_edges", *_EDGES)
def dependents(spark, sf_dir):
    return graph.dependents(call_edges(spark, sf_dir))


_TOUCHED = "t AS (SELECT DISTINCT user_id AS node FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16')"


@query("+" + _TOUCHED + "SELECT DISTINCT src AS node FROM call_edges WHERE dst IN (FROM t) AND src NOT IN (FROM t)", *_EDGES)
def blast_radius(spark, sf_dir):
    """Users that lead to users who met an error on one day, without these."""
    touched = table(spark, sf_dir, "events").where("event_type = 'error' and ts >= timestamp'2024-01-15' and ts < timestamp'2024-01-16'").select(F.col("user_id").alias("node")).distinct()
    return graph.blast_radius(call_edges(spark, sf_dir), touched)


_SIDES = "b AS (SELECT DISTINCT src, dst FROM call_edges WHERE ts < TIMESTAMP '2024-01-16'), h AS (SELECT DISTINCT src, dst FROM call_edges WHERE ts >= TIMESTAMP '2024-01-16')"


@query(
    "+" + _SIDES + """, m AS (SELECT coalesce(b.src, h.src) AS src, coalesce(b.dst, h.dst) AS dst, b.src IS NOT NULL AS inb, h.src IS NOT NULL AS inh FROM b FULL JOIN h ON b.src = h.src AND b.dst = h.dst)
    SELECT src, count_if(inb) AS deps_base, count_if(inh) AS deps_head, count_if(inh) - count_if(inb) AS deps_delta,
    coalesce(list(dst ORDER BY dst) FILTER (WHERE inh AND NOT inb), []) AS deps_added, coalesce(list(dst ORDER BY dst) FILTER (WHERE inb AND NOT inh), []) AS deps_removed FROM m GROUP BY src""",
    *_EDGES,
)
def deps_added_removed(spark, sf_dir):
    edges = call_edges(spark, sf_dir).select("src", "dst", (F.col("ts") < F.lit("2024-01-16").cast("timestamp")).alias("early"))
    return delta.set_delta(edges.where("early"), edges.where("not early"), ["src"], "dst", "deps")


@query(
    "+e AS (SELECT DISTINCT src, dst FROM call_edges), w AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),"
    "r(seed, node) AS (SELECT DISTINCT src, src FROM e UNION SELECT r.seed, e.dst FROM r JOIN e ON e.src = r.node)"
    "SELECT seed, count(*) AS reach, CAST(sum(n) AS BIGINT) AS complexity FROM r JOIN w ON w.user_id = node GROUP BY seed",
    *_EDGES, recursive=True,
)
def closure_sum(spark, sf_dir):
    """Transitive weight of each node over the distinct nodes that it reaches, itself included."""
    edges = call_edges(spark, sf_dir).select("src", "dst").distinct()
    weight = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.lit(1).cast("long").alias("reach"), F.count("*").alias("complexity"))
    return graph.reach_sums(edges, weight, edges.select(F.col("src").alias("node"))).withColumnRenamed("node", "seed")


@query(
    "+e AS (SELECT DISTINCT src, dst FROM call_edges), k AS (SELECT user_id, arg_max(event_type, {'v': value, 'e': event_id}) AS module, count(*) AS n FROM events GROUP BY user_id),"
    "r(node, module) AS (SELECT DISTINCT src, module FROM e JOIN k ON user_id = src UNION SELECT e.dst, r.module FROM r JOIN e ON e.src = r.node)"
    "SELECT r.module, count(*) AS reach, CAST(sum(n) AS BIGINT) AS total_complexity FROM r JOIN k ON user_id = node GROUP BY r.module",
    *_EDGES, recursive=True,
)
def module_total(spark, sf_dir):
    """Weight of the union of what a module's nodes reach: each node once, so less than the sum over nodes."""
    edges = call_edges(spark, sf_dir).select("src", "dst").distinct()
    own = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.max_by("event_type", F.struct("value", "event_id")).alias("module"), F.count("*").alias("n"))
    seeds = edges.select(F.col("src").alias("node")).distinct().join(own, "node").select(F.col("module").alias("seed"), "node")
    return graph.closure(edges, seeds).join(own.select("node", "n"), "node").groupBy(F.col("seed").alias("module")).agg(F.count("*").alias("reach"), F.sum("n").alias("total_complexity"))


@query(
    "+e AS (SELECT DISTINCT src, dst FROM call_edges), r(file, cur, d) AS (SELECT DISTINCT src, dst, 1 FROM e UNION SELECT r.file, e.dst, d + 1 FROM r JOIN e ON e.src = r.cur WHERE d < 6)"
    "SELECT 'head' AS tree, depth, count(*) AS barrels FROM (SELECT file, max(d) AS depth FROM r GROUP BY file) GROUP BY depth",
    *_EDGES, recursive=True,
)
def chain_depths(spark, sf_dir):
    edges = call_edges(spark, sf_dir).select(F.lit("head").alias("tree"), F.col("src").cast("string").alias("from_file"), F.col("dst").cast("string").alias("to_file"))
    return graph.chain_depths(edges, 6)


_EXPORTS = (
    "x AS (SELECT DISTINCT user_id AS file, event_type AS name FROM events WHERE event_type IN ('view', 'signup') AND value > 60),"
    "q AS (SELECT DISTINCT src AS file, n AS name FROM call_edges, (SELECT unnest(['view', 'signup']) AS n)),"
    "s(file, name, cur, d, path) AS (SELECT file, name, file, 0, CAST([] AS BIGINT[]) FROM q UNION ALL "
    "SELECT s.file, s.name, e.dst, d + 1, list_append(path, e.dst) FROM s JOIN (SELECT DISTINCT src, dst FROM call_edges) e ON e.src = s.cur LEFT JOIN x ON x.file = s.cur AND x.name = s.name "
    "WHERE d < 3 AND x.file IS NULL AND NOT list_contains(path, e.dst) AND e.dst <> s.file)"
)


@query(
    "+" + _EXPORTS + "SELECT file, name, origin_file, chain FROM (SELECT s.file, s.name, s.cur AS origin_file, s.d AS chain, row_number() OVER (PARTITION BY s.file, s.name ORDER BY path) AS n FROM s JOIN x ON x.file = s.cur AND x.name = s.name) WHERE n = 1",
    *_EDGES, recursive=True,
)
def reexport_origin(spark, sf_dir):
    """Names followed over `export *` edges, smaller targets first, three files deep, to the first node that has them."""
    edges = call_edges(spark, sf_dir).select("src", "dst").distinct()
    text = lambda c: F.col(c).cast("string")
    exports = table(spark, sf_dir, "events").where("event_type in ('view', 'signup') and value > 60").select(F.lit("head").alias("tree"), text("user_id").alias("file"), F.col("event_type").alias("name")).distinct()
    nothing = F.lit(None).cast("string")
    stars = edges.select(F.lit("head").alias("tree"), text("src").alias("from_file"), F.col("dst").cast("int").alias("stmt_no"), F.lit(0).alias("pos"), F.lit(True).alias("star"), nothing.alias("exported"), nothing.alias("source"), text("dst").alias("to_file"))
    wanted = edges.select(F.lit("head").alias("tree"), text("src").alias("file"), F.explode(F.array(F.lit("view"), F.lit("signup"))).alias("name")).distinct()
    found = graph.follow_reexports(exports, stars, wanted, 3)
    return found.select(F.col("file").cast("long").alias("file"), "name", F.col("origin_file").cast("long").alias("origin_file"), "chain")


@query(
    "SELECT n.n_regionkey AS base, s.s_suppkey AS name, max(l.l_suppkey) IS NOT NULL AS instantiated FROM supplier s JOIN nation n ON n_nationkey = s_nationkey "
    "LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1) l ON l_suppkey = s_suppkey GROUP BY 1, 2"
)
def subclasses(spark, sf_dir):
    """Suppliers of a region as classes of a base; constructed ones sold a large, cheap line."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("base"))
    heritage = table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select("base", F.col("s_suppkey").alias("name"))
    made = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_discount >= 0.1D").select(F.col("l_suppkey").alias("name"))
    return graph.subclasses(heritage, made)


# Paths and specifiers



@query(
    """+a AS (SELECT page_id, file, unnest(range(1, len(string_split(file, '/')))) AS k FROM url_paths),
    d AS (SELECT page_id, k, array_to_string(list_slice(string_split(file, '/'), 1, k), '/') AS dir FROM a),
    m AS (SELECT page_id, arg_max(dir, k) AS module FROM d WHERE regexp_full_match(dir, '[^/]*/fr|blog\\.tionsh\\.example\\.com/[^/]*|[^/]*') AND (dir LIKE '%/fr' OR dir LIKE 'blog.tionsh.example.com/%' OR dir = 'tionble.example.org') GROUP BY page_id)
    SELECT page_id, module FROM url_paths LEFT JOIN m USING (page_id)""",
    "url_paths",
)
def module_of_file(spark, sf_dir):
    """Deepest ancestor directory of a page's path that a pattern selects."""
    return url_paths(spark, sf_dir).select("page_id", paths.module_of(F.col("file"), ("*/fr", "blog.tionsh.example.com/*", "tionble.example.org")).alias("module"))


_PACKAGES = "pk AS (SELECT DISTINCT pkg FROM (SELECT split_part(file, '/', 1) AS pkg FROM url_paths UNION ALL SELECT split_part(file, '/', 1) || '/' || split_part(file, '/', 2) FROM url_paths WHERE split_part(file, '/', 2) IN ('en', 'fr')))"


@query(
    "+" + _PACKAGES + """SELECT page_id, pkg, dir, regexp_replace(substr(file, length(pkg) + 1), '^/', '') AS rest FROM (SELECT page_id, file, pkg, 'lib/' || pkg AS dir, row_number() OVER (PARTITION BY page_id ORDER BY length(pkg) DESC) AS n
    FROM url_paths JOIN pk ON file = pkg OR starts_with(file, pkg || '/')) WHERE n = 1""",
    "url_paths",
)
def specifier_longest_prefix(spark, sf_dir):
    """Longest package that is a specifier or a leading path of it; packages are hosts and two of their languages."""
    files = url_paths(spark, sf_dir)
    parts = F.split("file", "/")
    host = files.select(parts[0].alias("pkg"))
    nested = files.where(F.get(parts, F.lit(1)).isin("en", "fr")).select(F.concat_ws("/", parts[0], parts[1]).alias("pkg"))
    workspace = host.unionByName(nested).distinct().select(F.lit("head").alias("tree"), "pkg", F.concat(F.lit("lib/"), F.col("pkg")).alias("dir"))
    specs = files.select(F.lit("head").alias("tree"), "page_id", F.col("file").alias("spec"))
    return modules.split_specifiers(specs, workspace).select("page_id", "pkg", "dir", "rest")


@query(
    """+f AS (SELECT DISTINCT file FROM url_paths), s AS (SELECT DISTINCT regexp_replace(regexp_replace(file, '/$', ''), '\\.html$', '') AS base FROM url_paths),
    c AS (SELECT base, 0 AS k, base || '.html' AS file FROM s UNION ALL SELECT base, 1, base FROM s UNION ALL SELECT base, 2, base || '/' FROM s)
    SELECT base, arg_min(c.file, k) AS to_file FROM c JOIN f USING (file) GROUP BY base""",
    "url_paths",
)
def resolve_candidates(spark, sf_dir):
    """First existing of ranked candidates: a page's .html, bare and directory form."""
    files = url_paths(spark, sf_dir).select("file").distinct()
    base = F.regexp_replace(F.regexp_replace("file", "/$", ""), r"\.html$", "")
    bases = files.select(base.alias("base")).distinct()
    tried = bases.select("base", F.posexplode(F.array(F.concat("base", F.lit(".html")), "base", F.concat("base", F.lit("/")))).alias("k", "file"))
    head = F.lit("head").alias("tree")
    return modules.first_existing(tried.select(head, "base", "k", "file"), files.select(head, "file"), ["base"], F.col("k"))


@query(
    """SELECT page_id, CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '.' END AS directory, regexp_extract(file, '[^/.](\\.[^./]*)$', 1) AS extension,
    regexp_extract(file, '^(@[^/]+/[^/]+|[^/]+)', 1) AS package, len(string_split(file, '/')) AS segments, ends_with(file, '.html') OR contains(file, '/fr/') AS is_test FROM url_paths""",
    "url_paths",
)
def path_functions(spark, sf_dir):
    f = F.col("file")
    return url_paths(spark, sf_dir).select("page_id", paths.dirname(f).alias("directory"), paths.extension(f).alias("extension"), paths.package_root(f).alias("package"), F.size(paths.ancestors(f)).cast("long").alias("segments"), paths.is_test_file(f, (".html", "/fr/")).alias("is_test"))


@query(
    "+d AS (SELECT DISTINCT split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS dir FROM url_paths), c AS (SELECT DISTINCT split_part(file, '/', 1) AS dir FROM url_paths WHERE split_part(file, '/', 2) = 'fr')"
    "SELECT d.dir, coalesce(c.dir, '.') AS config_dir FROM d LEFT JOIN c ON c.dir = split_part(d.dir, '/', 1)",
    "url_paths",
)
def nearest_config(spark, sf_dir):
    """Nearest directory at or above that has a configuration: hosts with French pages have one."""
    files = url_paths(spark, sf_dir).select(F.lit("head").alias("tree"), F.split("file", "/").alias("p"))
    directories = files.select("tree", F.concat_ws("/", F.col("p")[0], F.get("p", F.lit(1))).alias("dir")).distinct()
    configs = files.where(F.get("p", F.lit(1)) == "fr").select("tree", F.col("p")[0].alias("dir")).distinct()
    return modules.nearest_config(directories, configs).select("dir", "config_dir")


# Ranges


@query(
    """SELECT file, line, id FROM (SELECT p.file, p.line, r.id, row_number() OVER (PARTITION BY p.file, p.line ORDER BY r."end" - r."start", r.id) AS n
    FROM ship_points p JOIN order_ranges r ON p.file = r.file AND p.line BETWEEN r."start" AND r."end") WHERE n = 1""",
    "order_ranges", "ship_points",
)
def innermost_range(spark, sf_dir):
    """The shortest open order around each shipping day of a customer."""
    return ranges.innermost(ship_points(spark, sf_dir), order_ranges(spark, sf_dir), ["file"], ["file", "line"], "id")


@query('SELECT p.file, p.line, r.id FROM ship_points p JOIN order_ranges r ON p.file = r.file AND p.line BETWEEN r."start" AND r."end"', "order_ranges", "ship_points")
def containing_ranges(spark, sf_dir):
    """All open orders around each shipping day, with the axis in buckets of 64 days."""
    return ranges.containing(ship_points(spark, sf_dir), order_ranges(spark, sf_dir), ["file"], bucket=64).select("file", "line", "id")


@query(
    """SELECT r.id, CAST(coalesce(sum(CASE WHEN p.hits > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS covered, count(p.line) AS known, CAST(sum(CASE WHEN p.hits > 0 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(p.line), 0) AS value
    FROM order_ranges r LEFT JOIN ship_points p ON p.file = r.file AND p.line BETWEEN r."start" AND r."end" GROUP BY r.id""",
    "order_ranges", "ship_points",
)
def range_coverage(spark, sf_dir):
    """Share of hit days among the known days of each order's range; null where none is known."""
    return ranges.line_coverage(order_ranges(spark, sf_dir), ship_points(spark, sf_dir), ["file"], ["id"])


_CATALOG = {"mail": "[a-z]@[a-z]", "number": "[0-9]{3}-[0-9]{4}", "licence": "Licen[sc]e", "shout": "[A-Z]{4}!!"}


@query(
    "SELECT doc_id, list_sort(list(DISTINCT category)) AS effects FROM documents JOIN (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in _CATALOG.items())
    + ") c(category, pattern) ON regexp_matches(text, pattern) GROUP BY doc_id"
)
def effect_catalog(spark, sf_dir):
    """Categories with a pattern that some line of a document matches; the catalog is part of the projection, not a join."""
    files = table(spark, sf_dir, "documents").select(F.lit("head").alias("tree"), F.col("doc_id").alias("file"), "text")
    matches = trees.effect_matches(files, Config(effects={}, effect_lines={k: (v,) for k, v in _CATALOG.items()}))
    return matches.groupBy(F.col("file").alias("doc_id")).agg(F.array_sort(F.collect_set("category")).alias("effects"))


# Surfaces

_SEQUENCES = ("by the", "of $X and", "to the $X of", "die $X $Y der", "que le")


def _sequence_sql() -> str:
    parts = [[None if w.startswith("$") else w for w in p.split()] for p in _SEQUENCES]
    at = lambda i: "w" if i == 0 else f"lead(w, {i}) OVER o"
    words = ", ".join(f"{at(i)} AS w{i}" for i in range(max(map(len, parts))))
    hits = [f"SELECT file, {n} AS pattern, first, first + {len(p) - 1} AS last FROM n WHERE w{len(p) - 1} IS NOT NULL AND p1 NOT IN ('.', '?.', 'new', 'function') AND " + " AND ".join(f"w{i} = '{w}'" for i, w in enumerate(p) if w) for n, p in enumerate(parts)]
    return (
        "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents), "
        f"n AS (SELECT CAST(doc_id AS VARCHAR) AS file, CAST(i AS INTEGER) AS first, coalesce(lag(w) OVER o, '') AS p1, {words} FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)) " + " UNION ALL ".join(hits)
    )


@query(_sequence_sql())
def word_sequences(spark, sf_dir):
    """Where documents hold sequences of words with gaps."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", " ")).alias("at", "text"))
    tokens = words.select(_head(), "file", "at", F.lit("word").alias("kind"), "text", (F.col("at") + 1).alias("line"), *[F.lit(None).cast("int").alias(c) for c in ("pair", "around")])
    return patterns.match_sequences(tokens, [patterns.Pattern("words", p) for p in _SEQUENCES]).select("file", "pattern", "first", "last")


def _head() -> Column:
    return F.lit("head").alias("tree")


def _surface(names: DataFrame, declared: DataFrame, used_by: DataFrame) -> DataFrame:
    """boundary_status without entries, bypassed names and providers."""
    none = names.where("false")
    return symbol.boundary_status(names, declared.withColumn("file", F.lit(None).cast("string")), none, used_by, none.select("tree", "module", F.lit("").alias("entry")), none)


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1995-06-01')")
def unused_exports(spark, sf_dir):
    """Parts that no early order holds."""
    early = table(spark, sf_dir, "orders").where("o_orderdate < timestamp'1995-06-01'").select(F.col("o_orderkey").alias("l_orderkey"))
    part = table(spark, sf_dir, "part").select(_head(), F.col("p_brand").alias("module"), F.col("p_partkey").alias("name"))
    sold = table(spark, sf_dir, "lineitem").join(early, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").cast("string").alias("by")).distinct()
    return _surface(part, part.withColumn("type_only", F.lit(False)), sold.join(part, "name")).where("unused").select(F.col("name").alias("p_partkey"), F.col("module").alias("p_brand"))


@query(
    """WITH d AS (SELECT p_brand AS module, p_partkey AS name, p_size < 10 AS type_only FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')),
    u AS (SELECT p_brand AS module, p_partkey AS name, list_sort(list(DISTINCT l_suppkey)) AS used_by FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 GROUP BY 1, 2)
    SELECT coalesce(d.module, u.module) AS module, coalesce(d.name, u.name) AS name, coalesce(type_only, false) AS type_only,
    CASE WHEN u.name IS NULL THEN 'unused' WHEN d.name IS NULL THEN 'bypassed' ELSE 'used' END AS status, CAST(coalesce(len(used_by), 0) AS INTEGER) AS users FROM d FULL JOIN u ON d.module = u.module AND d.name = u.name"""
)
def surface_status(spark, sf_dir):
    """Declared parts of a brand against those that suppliers sell in bulk: used, bypassed or unused."""
    part = table(spark, sf_dir, "part").select(_head(), F.col("p_brand").alias("module"), F.col("p_partkey").alias("name"), "p_type", (F.col("p_size") < 10).alias("type_only"))
    declared = part.where("p_type in ('ECONOMY', 'STANDARD')").drop("p_type")
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").cast("string").alias("by")).distinct()
    used = sold.join(part.select("tree", "module", "name"), "name")
    names = declared.select("tree", "module", "name").unionByName(used.select("tree", "module", "name")).distinct()
    status = F.when(F.size("used_by") == 0, "unused").when(~F.col("on_surface"), "bypassed").otherwise("used")
    return _surface(names, declared, used).select("module", "name", "type_only", status.alias("status"), F.size("used_by").alias("users"))


_CROSSINGS = """x AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'call' ELSE 'reference' END AS kind, c_mktsegment AS name, o_custkey AS file, n_name AS module, o_totalprice < 200000 AS type_only, o_orderkey AS seq
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def _crossings(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice").join(customer, "o_custkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "call").otherwise("reference")
    return orders.select(kind.alias("kind"), F.col("c_mktsegment").alias("name"), F.col("o_custkey").alias("file"), F.col("n_name").alias("module"), (F.col("o_totalprice") < 200000).alias("type_only"), F.col("o_orderkey").alias("seq"))


@query("WITH " + _CROSSINGS + "SELECT kind, name, file, count(*) AS count, arg_min(module, seq) AS module, arg_min(type_only, seq) AS type_only FROM x GROUP BY kind, name, file")
def distinct_crossings(spark, sf_dir):
    return rollups.distinct_crossings(_crossings(spark, sf_dir))


@query(
    "WITH " + _CROSSINGS + """, y AS (SELECT kind, name, file, count(*) AS n, arg_min(module, seq) AS module, arg_min(type_only, seq) AS type_only FROM x GROUP BY kind, name, file)
    SELECT module, CAST(coalesce(sum(n) FILTER (WHERE kind = 'call'), 0) AS BIGINT) AS calls, CAST(coalesce(sum(n) FILTER (WHERE kind <> 'call'), 0) AS BIGINT) AS "references", bool_and(type_only) AS type_only, list_slice(list_sort(list(DISTINCT name)), 1, 3) AS names FROM y GROUP BY module"""
)
def crossing_rollup(spark, sf_dir):
    return rollups.roll_up(rollups.distinct_crossings(_crossings(spark, sf_dir)), ["module"], 3)


# Facts


@query("SELECT p_brand AS module, event_type AS reason, n AS count FROM (SELECT 'Brand#' || CAST(user_id % 25 AS VARCHAR) AS p_brand, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def stop_histogram(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("Brand#"), (F.col("user_id") % 25).cast("string")).alias("module"), F.col("event_type").alias("reason"))
    return rollups.histogram(events, ["module", "reason"])


@query(
    """SELECT user_id AS module, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - 0.5::DOUBLE * (CAST(count_if(event_type = 'error') AS DOUBLE) / count(*)) - 0.2::DOUBLE * (CAST(count_if(event_type = 'view') AS DOUBLE) / count(*)))) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS confidence
    FROM events GROUP BY user_id"""
)
def confidence_values(spark, sf_dir):
    share = lambda kind: F.count(F.when(F.col("event_type") == kind, 1)) / F.count("*")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("module")).agg(confidence(share("error"), share("view")).alias("confidence"))


_FACTS = """s AS (SELECT o_custkey AS module, o_orderpriority AS name, count(*) AS complexity, list_sort(list(DISTINCT o_orderstatus)) AS effects, list_sort(list(DISTINCT year(o_orderdate))) AS used_by, CAST(count_if(o_orderstatus = 'F') AS DOUBLE) / count(*) AS coverage
    FROM orders WHERE o_orderdate >= TIMESTAMP '{a}' AND o_orderdate < TIMESTAMP '{b}' GROUP BY 1, 2)"""
_SYMBOLS = _FACTS.format(a="1996-01-01", b="1997-01-01").replace("s AS", "b AS", 1) + ", " + _FACTS.format(a="1996-07-01", b="1997-07-01").replace("s AS", "h AS", 1)


def _symbols(spark, sf_dir, first, last):
    orders = table(spark, sf_dir, "orders").where(f"o_orderdate >= timestamp'{first}' and o_orderdate < timestamp'{last}'")
    facts = [F.count("*").alias("complexity"), F.array_sort(F.collect_set("o_orderstatus")).alias("effects"), F.array_sort(F.collect_set(F.year("o_orderdate"))).alias("used_by"), (F.count(F.when(F.col("o_orderstatus") == "F", 1)) / F.count("*")).alias("coverage")]
    return orders.groupBy(F.col("o_custkey").alias("module"), F.col("o_orderpriority").alias("name")).agg(*facts)


@query(
    "WITH " + _SYMBOLS + """SELECT coalesce(b.module, h.module) AS module, coalesce(b.name, h.name) AS name,
    CASE WHEN b.module IS NULL THEN 'added' WHEN h.module IS NULL THEN 'removed' WHEN b.complexity <> h.complexity OR b.effects <> h.effects THEN 'changed' ELSE 'same' END AS status,
    CAST(coalesce(len(b.used_by), 0) AS INTEGER) AS used_by_base, CAST(coalesce(len(h.used_by), 0) AS INTEGER) AS used_by_head, CAST(coalesce(len(h.used_by), 0) - coalesce(len(b.used_by), 0) AS INTEGER) AS used_by_delta,
    b.complexity AS complexity_base, h.complexity AS complexity_head, h.complexity - b.complexity AS complexity_delta, coalesce(b.effects, []) AS effects_base, coalesce(h.effects, []) AS effects_head,
    list_filter(coalesce(h.effects, []), lambda x: NOT list_contains(coalesce(b.effects, []), x)) AS effects_added, list_filter(coalesce(b.effects, []), lambda x: NOT list_contains(coalesce(h.effects, []), x)) AS effects_removed,
    b.coverage AS coverage_base, h.coverage AS coverage_head, h.coverage - b.coverage AS coverage_delta FROM b FULL JOIN h ON b.module = h.module AND b.name = h.name"""
)
def symbol_delta(spark, sf_dir):
    """Orders of a customer by priority in two overlapping years."""
    return delta.symbol_delta(_symbols(spark, sf_dir, "1996-01-01", "1997-01-01"), _symbols(spark, sf_dir, "1996-07-01", "1997-07-01"), ["module", "name"])


@query(
    "+" + _SIDES + """, t AS (SELECT DISTINCT user_id AS module FROM events WHERE event_type = 'error'),
    m AS (SELECT user_id AS module, ts < TIMESTAMP '2024-01-16' AS early, count(*) AS n, count_if(event_type = 'error') AS c FROM events GROUP BY 1, 2),
    e AS (SELECT src, list(dst) FILTER (WHERE inb) AS lb, list(dst) FILTER (WHERE inh) AS lh FROM (SELECT coalesce(b.src, h.src) AS src, coalesce(b.dst, h.dst) AS dst, b.src IS NOT NULL AS inb, h.src IS NOT NULL AS inh FROM b FULL JOIN h ON b.src = h.src AND b.dst = h.dst) GROUP BY src),
    d AS (SELECT dst, list_sort(list(src)) AS dependents FROM h GROUP BY dst)
    SELECT t.module, CASE WHEN mb.n IS NULL THEN 'added' WHEN mh.n IS NULL THEN 'removed' ELSE 'changed' END AS status,
    coalesce(mb.n, 0) AS files_base, coalesce(mh.n, 0) AS files_head, coalesce(mh.n, 0) - coalesce(mb.n, 0) AS files_delta, mb.c AS complexity_base, mh.c AS complexity_head, mh.c - mb.c AS complexity_delta,
    coalesce(len(lb), 0) AS direct_base, coalesce(len(lh), 0) AS direct_head, list_sort(list_filter(coalesce(lh, []), lambda x: NOT list_contains(coalesce(lb, []), x))) AS direct_added,
    list_sort(list_filter(coalesce(lb, []), lambda x: NOT list_contains(coalesce(lh, []), x))) AS direct_removed, coalesce(dependents, []) AS dependents
    FROM t LEFT JOIN m mb ON mb.module = t.module AND mb.early LEFT JOIN m mh ON mh.module = t.module AND NOT mh.early LEFT JOIN e ON e.src = t.module LEFT JOIN d ON d.dst = t.module""",
    *_EDGES,
)
def module_delta(spark, sf_dir):
    """Users as modules before and after the middle of the month: events, errors, dependencies."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("module"), "event_type", "ts")
    tree = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "base").otherwise("head").alias("tree")
    nothing = F.lit(None).cast("array<struct<count:bigint,reason:string>>").alias("reasons")
    facts = events.groupBy(tree, "module").agg(F.count("*").alias("file_count"), F.count(F.when(F.col("event_type") == "error", 1)).alias("total_complexity"))
    facts = facts.select("*", F.lit(0).cast("long").alias("boundary"), F.lit(1.0).alias("confidence"), F.lit(False).alias("type_only"), nothing)
    names = facts.select("tree", "module", F.lit("x").alias("name"), F.array().cast("array<string>").alias("used_by"))
    edges = call_edges(spark, sf_dir).select(tree, F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    touched = events.where("event_type = 'error'").select("module").distinct()
    out = delta.module_delta(touched, facts, names, edges, 2)
    longs = lambda c: F.array_sort(F.transform(c, lambda x: x.cast("long"))).alias(c)
    return out.select(F.col("module").cast("long").alias("module"), "status", *[F.col(f"file_count_{s}").alias(f"files_{s}") for s in ("base", "head", "delta")], *[F.col(f"total_complexity_{s}").alias(f"complexity_{s}") for s in ("base", "head", "delta")], "direct_base", "direct_head", longs("direct_added"), longs("direct_removed"), longs("dependents"))


@query("SELECT fn_id, own, inline, own + inline AS count FROM (SELECT o_orderkey AS fn_id, CAST(count(*) AS INTEGER) AS own, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS inline FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ORDER BY count DESC, fn_id LIMIT 15")
def hotspots(spark, sf_dir):
    """The fifteen orders of most lines and suppliers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    n = tasks_for(lines, 400_000)
    lines = lines.repartition(n, "l_orderkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")).repartition(n, "l_orderkey"), "l_orderkey", "left_semi")
    own = lines.groupBy(F.col("l_orderkey").alias("fn_id")).agg(F.count("*").cast("int").alias("own"), F.count_distinct("l_suppkey").cast("int").alias("inline"))
    return rollups.hotspots(own)


_PLACES = "f AS (SELECT user_id AS fn_id, CAST(user_id % 10 AS VARCHAR) AS file, CAST(user_id % 5 AS VARCHAR) AS module, CAST(count(*) AS INTEGER) AS own FROM events GROUP BY user_id), s AS (SELECT DISTINCT src AS seed FROM call_edges)"


def _walk_sql(kind: str, rule: str) -> str:
    n = f"n_{kind}"
    return f"""{n}(seed, node) AS (SELECT seed, seed FROM s UNION SELECT {n}.seed, e.dst FROM {n} JOIN ce e ON e.src = {n}.node JOIN f a ON a.fn_id = {n}.seed JOIN f b ON b.fn_id = e.dst WHERE {rule}),
    o_{kind} AS (SELECT x.seed AS symbol, '{kind}' AS edge, count(*) AS reach, CAST(sum(own) AS BIGINT) AS transitive FROM {n} x JOIN f ON f.fn_id = x.node GROUP BY x.seed),
    c_{kind} AS (SELECT x.seed AS symbol, count(DISTINCT e.dst) AS crossings, count(DISTINCT b.module) AS modules FROM {n} x JOIN ce e ON e.src = x.node JOIN f a ON a.fn_id = x.seed JOIN f b ON b.fn_id = e.dst WHERE NOT ({rule}) GROUP BY x.seed)"""


_RULES = {"file": "a.file = b.file", "module": "a.module = b.module", "package": "a.module = b.module", "repo": "true"}


def _event_functions(spark, sf_dir):
    """Users as functions in ten files and five modules, and the calls between them."""
    ids = F.col("user_id")
    functions = table(spark, sf_dir, "events").groupBy(ids.alias("fn_id")).agg(F.count("*").cast("int").alias("own"))
    text = F.col("fn_id").cast("string")
    functions = functions.select("fn_id", text.alias("name"), (F.col("fn_id") % 10).cast("string").alias("file"), (F.col("fn_id") % 5).cast("string").alias("module"), (F.col("fn_id") % 5).cast("string").alias("package"), F.lit(0).alias("start"), F.lit(0).alias("end"), "own", F.lit(0).alias("inline"))
    edges = call_edges(spark, sf_dir).select(F.col("src").alias("from_fn"), F.col("dst").alias("to_fn")).distinct()
    return functions, edges


@query(
    "+" + _PLACES + ", ce AS (SELECT DISTINCT src, dst FROM call_edges), " + ",\n".join(_walk_sql(k, r) for k, r in _RULES.items())
    + " UNION ALL ".join(f" SELECT o.symbol, edge, reach, transitive, coalesce(crossings, 0) AS crossings, coalesce(modules, 0) AS modules FROM o_{k} o LEFT JOIN c_{k} c ON c.symbol = o.symbol" for k in _RULES),
    *_EDGES, recursive=True,
)
def edge_comparison(spark, sf_dir):
    """Reach, weight and crossings of every caller under the four edge rules."""
    functions, edges = _event_functions(spark, sf_dir)
    seeds = edges.select(F.col("from_fn").alias("symbol"), F.col("from_fn").alias("fn_id")).distinct()
    stops = edges.select("from_fn", F.lit("dynamic").alias("reason")).where("false")
    return symbol.compare_edges(seeds, functions, edges, stops, None, None).select("symbol", "edge", "reach", "transitive", "crossings", "modules")


@query(
    "+" + _REACH.format(n=5) + """, m AS (SELECT src AS symbol, node, min(h) AS h FROM (SELECT * FROM r UNION SELECT DISTINCT src, src, 0 FROM call_edges) GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY h, node) AS n FROM m WHERE h <= 4), t AS (SELECT DISTINCT symbol FROM m WHERE h = 5)
    SELECT k.symbol, count_if(n <= 12) AS reach, CAST(max(CASE WHEN n <= 12 THEN h END) AS INTEGER) AS depth, max(n) > 12 OR bool_or(t.symbol IS NOT NULL) AS truncated FROM k LEFT JOIN t ON t.symbol = k.symbol GROUP BY k.symbol""",
    *_EDGES, recursive=True,
)
def walk_limits(spark, sf_dir):
    """Every caller's walk of four hops and twelve functions at most, and whether one of the limits cut it."""
    functions, edges = _event_functions(spark, sf_dir)
    seeds = edges.select(F.col("from_fn").alias("symbol"), F.col("from_fn").alias("fn_id")).distinct()
    w = symbol.walk(seeds, functions, edges, edges.select("from_fn", F.lit("dynamic").alias("reason")).where("false"), "repo", 4, 12)
    out = w.nodes.groupBy("symbol").agg(F.count("*").alias("reach"), F.max("depth").alias("depth"))
    return out.join(w.truncated.withColumn("truncated", F.lit(True)), "symbol", "left").na.fill(False)


_NESTED = """o AS (SELECT o_orderkey AS fn_id, CASE WHEN lag(o_custkey) OVER w = o_custkey THEN lag(o_orderkey) OVER w END AS parent, o_orderkey % 3 = 0 AS anonymous FROM orders WINDOW w AS (ORDER BY o_custkey, o_orderkey)),
    own AS (SELECT fn_id, parent, anonymous, CAST(1 + count(l_orderkey) AS INTEGER) AS own FROM o LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) ON l_orderkey = fn_id GROUP BY 1, 2, 3),
    r(seed, node) AS (SELECT fn_id, fn_id FROM o UNION SELECT r.seed, o.parent FROM r JOIN o ON o.fn_id = r.node WHERE o.anonymous AND o.parent IS NOT NULL)"""


@query(
    "WITH RECURSIVE " + _NESTED + """, i AS (SELECT node, sum(own - 1) AS n FROM r JOIN own ON fn_id = seed WHERE seed <> node GROUP BY node), t AS (SELECT seed, node FROM r JOIN o ON fn_id = node WHERE NOT (anonymous AND parent IS NOT NULL))
    SELECT own.fn_id, own, CAST(coalesce(n, 0) AS INTEGER) AS inline, t.node AS unit_id FROM own LEFT JOIN i ON i.node = own.fn_id LEFT JOIN t ON t.seed = own.fn_id"""
)
def function_counts(spark, sf_dir):
    """Orders as functions, each inside the customer's order before it: own weight, the decisions of anonymous ones inside, and who counts it."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fn_id"), F.lag("o_orderkey").over(before).alias("parent"), (F.col("o_orderkey") % 3 == 0).alias("anonymous"))
    nodes = table(spark, sf_dir, "lineitem").select(_head(), F.col("l_orderkey").alias("owner"), (F.col("l_quantity") > 25).alias("decision"))
    return facts.function_counts(nodes, orders.select(_head(), "fn_id", "parent", "anonymous")).drop("tree")


# The whole report


@query(
    """+k AS (SELECT user_id, 'm/' || CAST(user_id % 25 AS VARCHAR) AS m, CAST(1 + count(*) % 7 AS INTEGER) AS own FROM events GROUP BY user_id),
    e AS (SELECT DISTINCT t.tree, c.src, c.dst FROM call_edges c JOIN (VALUES ('base'), ('head')) t(tree) ON t.tree = 'head' OR c.ts < TIMESTAMP '2024-01-16'),
    x AS (SELECT e.tree, a.m AS user_m, b.m AS module, e.dst FROM e JOIN k a ON a.user_id = e.src JOIN k b ON b.user_id = e.dst WHERE a.m <> b.m),
    r(tree, m, node) AS (SELECT tree, module, dst FROM x UNION SELECT r.tree, r.m, e.dst FROM r JOIN e ON e.tree = r.tree AND e.src = r.node JOIN k ON k.user_id = e.dst WHERE k.m = r.m),
    b AS (SELECT tree, module, count(DISTINCT dst) AS boundary FROM x GROUP BY 1, 2),
    d AS (SELECT tree, user_m AS module, count(DISTINCT module) AS direct FROM x GROUP BY 1, 2),
    s AS (SELECT z.tree, z.m AS module, CAST(sum(own) AS BIGINT) AS total FROM (SELECT DISTINCT * FROM r) z JOIN k ON user_id = node GROUP BY 1, 2),
    n AS (SELECT m AS module, count(*) AS file_count FROM k GROUP BY 1)
    SELECT n.module, 'changed' AS status, file_count AS file_count_head, coalesce(b1.boundary, 0) AS boundary_base, coalesce(b2.boundary, 0) AS boundary_head, coalesce(s1.total, 0) AS complexity_base, coalesce(s2.total, 0) AS complexity_head,
        coalesce(d1.direct, 0) AS direct_base, coalesce(d2.direct, 0) AS direct_head
    FROM n LEFT JOIN b b1 ON b1.module = n.module AND b1.tree = 'base' LEFT JOIN b b2 ON b2.module = n.module AND b2.tree = 'head' LEFT JOIN s s1 ON s1.module = n.module AND s1.tree = 'base'
        LEFT JOIN s s2 ON s2.module = n.module AND s2.tree = 'head' LEFT JOIN d d1 ON d1.module = n.module AND d1.tree = 'base' LEFT JOIN d d2 ON d2.module = n.module AND d2.tree = 'head'
    WHERE n.module IN (SELECT m FROM k WHERE user_id < 20)""",
    *_EDGES, recursive=True,
)
def impact_report(spark, sf_dir):
    """The two-snapshot report with users as files of 25 modules, calls of half the month as base, and the first users' files changed."""
    modules_ = build_report(impact_tables(spark, sf_dir), Config(modules=("m/*",))).modules
    total = [F.col(f"total_complexity_{t}").alias(f"complexity_{t}") for t in ("base", "head")]
    return modules_.select("module", "status", "file_count_head", "boundary_base", "boundary_head", *total, "direct_base", "direct_head")


# Call statistics

_CALLS = """k AS (SELECT c_mktsegment AS file, o_orderpriority AS pr, o_orderstatus AS st, o_totalprice AS p, c_acctbal AS b, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey),
    g AS (SELECT *, CASE WHEN pr LIKE '5%' THEN 'dynamic' WHEN pr LIKE '4%' AND p < 100000 THEN 'param' WHEN b < 0 THEN 'unresolved' WHEN st = 'F' AND p < 250000 THEN 'body:module' WHEN st = 'F' AND p < 400000 THEN 'body:repo' WHEN p < 400000 THEN 'no-body:repo' ELSE 'external' END AS bucket FROM k)"""


def _classified(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("file"), "c_acctbal")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice").join(customer, "o_custkey")
    p = F.col("o_totalprice")
    flags = {"is_dynamic": F.col("o_orderpriority").startswith("5"), "is_param": F.col("o_orderpriority").startswith("4") & (p < 100000), "resolved": F.col("c_acctbal") >= 0, "has_body": F.col("o_orderstatus") == "F", "in_module": p < 250000, "in_repo": p < 400000}
    return rollups.classify_calls(rows.withColumns(flags))


@query("WITH " + _CALLS + "SELECT file, bucket, count(*) AS count FROM g GROUP BY file, bucket")
def call_buckets(spark, sf_dir):
    return rollups.histogram(_classified(spark, sf_dir), ["file", "bucket"])


@query("WITH " + _CALLS + "SELECT file, CAST(count_if(bucket = 'body:module') AS DOUBLE) / nullif(count_if(bucket IN ('body:module', 'unresolved', 'param', 'no-body:repo')), 0) AS followability FROM g GROUP BY file")
def followability(spark, sf_dir):
    return rollups.followability(_classified(spark, sf_dir), ["file"])


@query("WITH " + _CALLS + "SELECT bucket, o_orderkey FROM (SELECT bucket, o_orderkey, row_number() OVER (PARTITION BY bucket ORDER BY o_orderkey) AS n FROM g) WHERE n <= 5")
def call_samples(spark, sf_dir):
    """The first five calls of each bucket, the report's sample."""
    return rollups.first_per_bucket(_classified(spark, sf_dir).select("bucket", "o_orderkey"), ["bucket"], ["o_orderkey"], 5)


@query(
    """SELECT l_returnflag AS file, count(*) AS calls, count_if(a IS NOT NULL AND b IS NULL) AS only_first, count_if(a IS NULL AND b IS NOT NULL) AS only_second, count_if(a IS NULL AND b IS NULL) AS neither,
    CAST(count_if(a <> b) AS DOUBLE) / count(*) AS disagreement FROM (SELECT l_returnflag, CASE WHEN l_discount > 0.02::DOUBLE THEN l_suppkey END AS a, CASE WHEN l_tax > 0.02::DOUBLE THEN l_suppkey + l_linenumber // 6 END AS b FROM lineitem) GROUP BY l_returnflag"""
)
def strategy_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("file"), F.when(F.col("l_discount") > 0.02, F.col("l_suppkey")).alias("a"), F.when(F.col("l_tax") > 0.02, F.col("l_suppkey") + F.floor(F.col("l_linenumber") / 6)).alias("b"))
    return rollups.merge_strategies(rows, "a", "b", ["file"])


@query("""SELECT conv_id AS file, count_if(token IN ('the', 'and', 'und', 'et', 'y')) AS decisions, count(*) AS tokens FROM (SELECT conv_id, unnest(string_split_regex(lower(text), '[ \\t\\n]+')) AS token FROM conversations) WHERE token <> '' GROUP BY conv_id""")
def token_counts(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.explode(F.split(F.lower("text"), "[ \\t\\n]+")).alias("token")).where("token <> ''")
    return rollups.token_counts(words, ["file"], ("the", "and", "und", "et", "y"))


@query("SELECT split_part(file, '/', 1) AS package, count(*) AS count FROM url_paths GROUP BY 1 ORDER BY count DESC, package LIMIT 10", "url_paths")
def top_packages(spark, sf_dir):
    """The ten packages of most files, the report's list."""
    rows = url_paths(spark, sf_dir).select(paths.package_root(F.col("file")).alias("package"))
    return rollups.histogram(rows, ["package"]).orderBy(F.desc("count"), "package").limit(10)


# Views and sources


@query(
    """SELECT c_custkey, CASE WHEN length(c_name) >= 12 THEN substr(c_name, 1, 10) || ' ' ELSE rpad(c_name, 12, ' ') END AS padded, CASE WHEN c_nationkey > 0 THEN '+' || CAST(c_nationkey AS VARCHAR) ELSE CAST(c_nationkey AS VARCHAR) END AS signed,
    CAST(CAST(floor(c_nationkey / 24.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) || '%' AS share, substr(trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g')), 1, 24) AS label FROM customer"""
)
def text_functions(spark, sf_dir):
    n = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", pad(F.col("c_name"), 12).alias("padded"), signed(n).alias("signed"), percent(n / 24.0).alias("share"), one_line(F.concat("c_name", F.lit("  "), "c_mktsegment"), 24).alias("label"))


@query("SELECT 'head' AS tree, 'c' || file || '.ts' AS file, line, hits FROM ship_points", "ship_points")
def lcov_lines(spark, sf_dir):
    """Days of shipping written as reports of fifty, each file named twice: its last block counts, and there its last line."""
    n = tasks_for(table(spark, sf_dir, "lineitem"), 200_000)
    lines = ship_points(spark, sf_dir).repartition(n, "file").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "hits"))).alias("x"))
    record = lambda shown: F.concat(F.lit("SF:/r/c"), F.col("file").cast("string"), F.lit(".ts\n"), F.array_join(F.transform("x", shown), "\n"), F.lit("\nend_of_record"))
    da = lambda x, hits: F.concat(F.lit("DA:"), x["line"].cast("string"), F.lit(","), hits.cast("string"))
    stale = record(lambda x: da(x, F.lit(99)))
    fresh = record(lambda x: F.concat(da(x, F.lit(7)), F.lit("\n"), da(x, x["hits"])))
    reports = lines.select(F.floor(F.col("file") / 50).alias("report"), "file", F.explode(F.array(F.struct(F.lit(0).alias("turn"), stale.alias("text")), F.struct(F.lit(1).alias("turn"), fresh.alias("text")))).alias("y"))
    texts = reports.groupBy("report").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y.turn", "file", "y.text"))), lambda z: z["text"]), "\n").alias("text"))
    return coverage.lcov_lines(texts.select(F.lit("head").alias("tree"), F.concat(F.lit("TN:\n"), "text").alias("text")), "/r", n)


@query(
    """SELECT 'head' AS tree, 'c' || file || '.ts' AS file, CAST(line AS INTEGER) AS line, max(id % 5) AS hits FROM (SELECT file, id, unnest(range("start", "end" + 1)) AS line FROM order_ranges) GROUP BY ALL""",
    "order_ranges",
)
def istanbul_lines(spark, sf_dir):
    """Orders written as statements of a customer's file, a report for every customer."""
    at = lambda c: F.struct(F.col(c).alias("line"))
    spans = order_ranges(spark, sf_dir).select("file", F.col("id").cast("string").alias("k"), F.struct(at("start").alias("start"), at("end").alias("end")).alias("at"), (F.col("id") % 5).alias("n"))
    n = tasks_for(spans, 20_000)
    files = spans.repartition(n, "file").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "at"))).alias("statementMap"), F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("s"))
    text = F.to_json(F.create_map(F.concat(F.lit("/r/c"), F.col("file").cast("string"), F.lit(".ts")), F.struct("statementMap", "s")))
    return coverage.istanbul_lines(files.select(F.lit("head").alias("tree"), text.alias("text")), "/r", n)


@query(
    """SELECT CASE WHEN event_type = 'signup' THEN 'n/' ELSE 'm/' END || user_id || '/' || event_id || '.ts' AS path, CASE event_type WHEN 'signup' THEN 'R' WHEN 'error' THEN 'D' ELSE 'M' END AS status,
    CASE WHEN event_type = 'signup' THEN 'm/' || user_id || '/' || event_id || '.ts' END AS renamed_from FROM events"""
)
def change_set(spark, sf_dir):
    """Events written as the lines of a change list: a signup is a renamed file, an error a deleted one."""
    path = lambda top: F.concat(F.lit(top), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".ts"))
    kind = F.col("event_type")
    line = F.when(kind == "signup", F.concat_ws("\t", F.format_string("R%03d", (F.col("event_id") % 101).cast("int")), path("m/"), path("n/"))).otherwise(F.concat_ws("\t", F.when(kind == "error", "D").otherwise("M"), path("m/")))
    return trees.change_set(table(spark, sf_dir, "events").select(line.alias("value")))


# Names, callees, seeds and closures


_NAMED = (
    "u AS (SELECT DISTINCT file, line AS use, line % 3 AS name FROM ship_points),"
    "d AS (SELECT file, id, id % 3 AS name, \"start\", \"end\" FROM order_ranges)"
)


def _named_points(spark, sf_dir):
    """Days of shipping as uses of one of three names, open orders as declarations that are visible while they are open."""
    uses = ship_points(spark, sf_dir).select("file", F.col("line").alias("use"), F.col("line").alias("at"), (F.col("line") % 3).cast("long").alias("name"))
    spans = order_ranges(spark, sf_dir).select("file", F.col("id").alias("decl"), (F.col("id") % 3).alias("name"), F.col("start").alias("from"), F.col("end").alias("to"))
    return uses, spans


@query(
    "+" + _NAMED + "SELECT file, use, decl FROM (SELECT u.file, use, d.id AS decl, rank() OVER (PARTITION BY u.file, use ORDER BY \"end\" - \"start\", \"start\" DESC) AS n FROM u JOIN d ON d.file = u.file AND d.name = u.name AND use BETWEEN \"start\" AND \"end\") WHERE n = 1",
    "order_ranges", "ship_points",
)
def visible_declarations(spark, sf_dir):
    """The declaration that a name means: of the orders that bear it, the shortest that is open."""
    return names.visible_declarations(*_named_points(spark, sf_dir), ["file"])


_KINDS = ("function", "class", "variable", "abstract", "parameter", "signature", "outside")


@query(
    "+" + _NAMED + """, k AS (SELECT *, CASE id % 7 WHEN 0 THEN 'body' WHEN 1 THEN 'holder' WHEN 2 THEN 'holder' WHEN 3 THEN 'abstract' WHEN 4 THEN 'function-type' WHEN 5 THEN 'interface' ELSE 'external' END AS outcome,
        CASE id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 ELSE 6 END AS place FROM d),
    r AS (SELECT u.file, use, k.id AS decl, outcome, rank() OVER (PARTITION BY u.file, use ORDER BY place) AS n FROM u JOIN k ON k.file = u.file AND k.name = u.name AND use BETWEEN "start" AND "end")
    SELECT u.file, u.use AS call, coalesce(outcome, CASE WHEN u.use % 2 = 0 THEN 'unresolved' ELSE 'dynamic' END) AS outcome, decl FROM u LEFT JOIN r ON r.file = u.file AND r.use = u.use AND n = 1""",
    "order_ranges", "ship_points",
)
def callee_choice(spark, sf_dir):
    """Where a call leads if any order open on its day may be meant: bodies first, then holders, then the reasons in their order."""
    uses, spans = _named_points(spark, sf_dir)
    calls = uses.select("file", F.col("use").alias("call"), (F.col("use") % 2 == 0).alias("by_name"))
    met = ranges.containing(uses, spans, ["file", "name"], "at", "from", "to")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("decl") % 7 + 1).cast("int"))
    return names.choose_callees(calls, met.select("file", F.col("use").alias("call"), "decl", kind.alias("kind"), (F.col("decl") % 7 == 0).alias("has_body")), ["file"])


_PARENTS = (
    "p AS (SELECT file, inner_id AS id, arg_min(outer_id, {'l': length, 'i': outer_id}) AS parent FROM (SELECT i.file, i.id AS inner_id, o.id AS outer_id, o.\"end\" - o.\"start\" AS length FROM order_ranges i JOIN order_ranges o"
    " ON o.file = i.file AND i.\"start\" BETWEEN o.\"start\" AND o.\"end\" AND o.\"end\" >= i.\"end\" AND o.id <> i.id AND (o.\"end\" - o.\"start\" > i.\"end\" - i.\"start\" OR o.id < i.id)) GROUP BY file, inner_id)"
)


@query("+" + _PARENTS + "SELECT file, id, parent FROM p", "order_ranges")
def span_parents(spark, sf_dir):
    """The forest of nested orders."""
    return names.parents(order_ranges(spark, sf_dir), ["file"])


@query(
    "+" + _PARENTS + ", r(file, src, cur, hops) AS (SELECT file, id, parent, 1 FROM p UNION ALL SELECT r.file, src, parent, hops + 1 FROM r JOIN p ON p.file = r.file AND p.id = r.cur)"
    "SELECT file, src, arg_max(cur, hops) AS \"end\", CAST(max(hops) AS BIGINT) AS hops FROM r GROUP BY file, src",
    "order_ranges", recursive=True,
)
def alias_ends(spark, sf_dir):
    """Every nested order as an alias of the one around it, followed to the outermost."""
    up = names.parents(order_ranges(spark, sf_dir), ["file"])
    return graph.follow_aliases(up.select("file", F.col("id").alias("src"), F.col("parent").alias("dst")), ["file"])


@query("+" + _PARENTS + "SELECT file, id AS decl, id AS fn FROM order_ranges WHERE id % 4 <> 0 UNION SELECT file, parent, id FROM p WHERE parent % 4 = 0 AND id % 4 <> 0", "order_ranges")
def seed_functions(spark, sf_dir):
    """Every fourth order is a class, the others are functions: a class seeds the functions directly inside."""
    spans = order_ranges(spark, sf_dir)
    holders = names.parents(spans, ["file"])
    is_class = F.col("id") % 4 == 0
    declared = spans.select("file", F.col("id").alias("decl"), F.when(is_class, "class").otherwise("function").alias("kind"), F.when(~is_class, F.col("id")).alias("fn"), F.col("id").alias("body"))
    functions = spans.where(~is_class).join(holders, ["file", "id"], "left").select("file", F.col("id").alias("fn"), F.col("parent").alias("holder"))
    return names.seed_functions(declared, functions, ["file"])


@query(
    """WITH u AS (SELECT user_id AS "array", bool_and(value < 99) AS a FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id),
    e AS (SELECT user_id AS "array", CASE WHEN value >= 1 THEN event_id END AS fn FROM events WHERE event_type = 'purchase'),
    b AS (SELECT "array", bool_and(fn IS NOT NULL) AS b FROM e GROUP BY "array")
    SELECT s."array", e.fn, coalesce(a, true) AND coalesce(b, true) AS complete FROM (SELECT DISTINCT user_id AS "array" FROM events) s LEFT JOIN u ON u."array" = s."array" LEFT JOIN b ON b."array" = s."array"
    LEFT JOIN (SELECT DISTINCT * FROM e WHERE fn IS NOT NULL) e ON e."array" = s."array" """
)
def held_closures(spark, sf_dir):
    """Users as arrays: what they bought is put in, what they looked at may let other values in."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "array").withColumn("all", F.lit(1))
    uses = events.where("event_type in ('view', 'click')").select("all", "array", (F.col("value") < 99).alias("known"))
    elements = events.where("event_type = 'purchase'").select("all", "array", F.when(F.col("value") >= 1, F.col("event_id")).alias("fn"))
    return names.held_closures(events, uses, elements, ["all"]).drop("all")


@query(
    """WITH RECURSIVE s AS (SELECT c_custkey AS cls, 0 AS field, c_custkey % 4 + 1 AS property FROM customer UNION ALL SELECT c_custkey, 1, c_custkey % 3 + 4 FROM customer),
    k AS (SELECT o_orderkey AS site, o_custkey AS cls, CASE WHEN o_orderstatus = 'P' THEN 'other' WHEN o_orderpriority = '5-LOW' THEN 'none' ELSE 'object' END AS form FROM orders),
    g AS (SELECT l_orderkey AS site, l_linenumber AS property, CASE WHEN l_quantity <= 45 THEN l_returnflag || l_linestatus END AS type, CASE WHEN l_quantity > 45 AND l_returnflag = 'A' THEN l_suppkey * 3 END AS from_cls, l_linenumber % 2 AS from_field FROM lineitem),
    d AS (SELECT s.cls, s.field, k.site, s.property, form, g.site IS NOT NULL AS there, type, t.cls AS to_cls, t.field AS to_field FROM s JOIN k ON k.cls = s.cls LEFT JOIN g ON g.site = k.site AND g.property = s.property
        LEFT JOIN s t ON t.cls = g.from_cls AND t.field = g.from_field),
    e AS (SELECT DISTINCT cls, field, to_cls, to_field FROM d WHERE form = 'object' AND to_cls IS NOT NULL),
    r(cls, field, to_cls, to_field, hops) AS (SELECT cls, field, cls, field, 0 FROM s UNION SELECT r.cls, r.field, e.to_cls, e.to_field, hops + 1 FROM r JOIN e ON e.cls = r.to_cls AND e.field = r.to_field WHERE hops < 40),
    m AS (SELECT cls, field, to_cls, to_field, min(hops) AS hops FROM r GROUP BY 1, 2, 3, 4)
    SELECT DISTINCT m.cls, m.field, d.site, d.property, CASE WHEN form = 'none' THEN 'no-argument' WHEN form <> 'object' THEN 'not-literal' WHEN NOT there THEN 'no-property' WHEN type IS NULL THEN 'unknown' ELSE 'bound' END AS outcome,
        CASE WHEN form = 'object' THEN type END AS type, m.hops FROM m JOIN d ON d.cls = m.to_cls AND d.field = m.to_field WHERE form <> 'object' OR d.to_cls IS NULL"""
)
def field_bindings(spark, sf_dir):
    """Customers as classes of two fields, orders as constructions, lines as values: some are a field of another customer."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cls"))
    slots = customers.select("cls", F.lit(0).alias("field"), (F.col("cls") % 4 + 1).alias("property")).unionByName(customers.select("cls", F.lit(1).alias("field"), (F.col("cls") % 3 + 4).alias("property")))
    form = F.when(F.col("o_orderstatus") == "P", "other").when(F.col("o_orderpriority") == "5-LOW", "none").otherwise("object")
    sites = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"), F.col("o_custkey").alias("cls"), form.alias("form"))
    passed = (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "A")
    given = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("site"), F.col("l_linenumber").cast("long").alias("property"), F.when(F.col("l_quantity") <= 45, F.concat("l_returnflag", "l_linestatus")).alias("type"),
        F.when(passed, F.col("l_suppkey") * 3).alias("from_cls"), (F.col("l_linenumber") % 2).cast("int").alias("from_field"),
    )
    return fields.bind_fields(slots, sites, given)


@query(
    """WITH w AS (SELECT DISTINCT lang, unnest(string_split(text, ' ')) AS word FROM documents)
    SELECT lang, lower(left(word, 1)) AS letter, word, row_number() OVER (PARTITION BY lang, lower(left(word, 1)) ORDER BY word COLLATE en_US, word) AS place FROM w WHERE length(word) BETWEEN 2 AND 6"""
)
def name_order(spark, sf_dir):
    """Short words of a language by first letter, in the order of the report's names."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", " ")).alias("word")).distinct().where("length(word) between 2 and 6")
    letter = F.lower(F.left("word", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("lang", letter).orderBy(locale_order(F.col("word")), "word"))
    return words.select("lang", letter.alias("letter"), "word", place.cast("long").alias("place"))


def _growth_sql(rounds: int) -> str:
    """Every round closes the files and then the functions anew, from all that the rounds before have."""
    parts = [
        """+t AS (SELECT t.*, tree FROM transitions t, (SELECT unnest(['base', 'head']) AS tree) WHERE tree = 'head' OR ts < TIMESTAMP '2024-01-16'),
    c AS (SELECT DISTINCT tree, src, dst FROM t WHERE src_type = 'error' AND dst_type = 'purchase' AND value < 25),
    i AS (SELECT DISTINCT tree, src // 2 AS src, dst // 2 AS dst FROM t WHERE src_type = 'view' AND dst_type = 'signup' AND value < 15),
    a AS (SELECT DISTINCT tree, src, dst // 2 + CASE WHEN dst // 2 % 7 = 3 THEN 1 ELSE 0 END AS source, dst AS name FROM t WHERE src_type = 'signup' AND dst_type = 'error' AND value < 25 AND dst // 2 % 5 <> 0),
    o AS (SELECT tree, src, name AS dst, source FROM a WHERE source = name // 2),
    s AS (SELECT DISTINCT tree, seed FROM (SELECT arg_max(user_id, {'v': value, 'e': event_id}) AS seed FROM events GROUP BY date_trunc('day', ts)), (SELECT unnest(['base', 'head']) AS tree))"""
    ]
    for n in range(rounds + 1):
        files = "SELECT tree, seed // 2 AS file FROM s" if n == 0 else f"SELECT tree, file FROM l{n - 1} UNION SELECT a.tree, a.source FROM a JOIN r{n - 1} r ON r.tree = a.tree AND r.fn = a.src"
        functions = "SELECT tree, seed, seed AS fn FROM s" if n == 0 else f"SELECT tree, seed, fn FROM r{n - 1}"
        parts.append(f"l{n}(tree, file) AS (SELECT tree, file FROM ({files}) UNION SELECT i.tree, i.dst FROM l{n} l JOIN i ON i.tree = l.tree AND i.src = l.file)")
        parts.append(f"e{n} AS (SELECT tree, src, dst FROM c UNION SELECT o.tree, o.src, o.dst FROM o JOIN l{n} l ON l.tree = o.tree AND l.file = o.source)")
        parts.append(f"r{n}(tree, seed, fn) AS (SELECT tree, seed, fn FROM ({functions}) UNION SELECT r.tree, r.seed, e.dst FROM r{n} r JOIN e{n} e ON e.tree = r.tree AND e.src = r.fn)")
    rows = " UNION ALL ".join(f"SELECT tree, 'file' AS kind, CAST(NULL AS BIGINT) AS seed, file AS item, {n} AS n FROM l{n} UNION ALL SELECT tree, 'function', seed, fn, {n} FROM r{n}" for n in range(rounds + 1))
    return ",\n    ".join(parts) + f"\n    SELECT tree, kind, seed, item, CAST(min(n) AS INTEGER) AS round FROM ({rows}) GROUP BY tree, kind, seed, item"


@query(_growth_sql(growth.GROWTH_ROUNDS), "transitions", recursive=True)
def program_growth(spark, sf_dir):
    """Users as functions, two to a file: what the users with the dearest event of a day reach, and the files that are loaded for it."""
    trees_ = F.explode(F.array(F.lit("base"), F.lit("head"))).alias("tree")
    moved = transitions(spark, sf_dir).select("*", trees_).where((F.col("tree") == "head") | (F.col("ts") < F.lit("2024-01-16").cast("timestamp")))
    of = lambda a, b, below: moved.where((F.col("src_type") == a) & (F.col("dst_type") == b) & (F.col("value") < below))
    file = lambda user: F.expr(f"{user} div 2")
    built = of("signup", "error", 25).select("tree", "src", file("dst").alias("file"), F.col("dst").alias("name"))
    source = F.col("file") + F.when(F.col("file") % 7 == 3, 1).otherwise(0)  # those of some built files do not declare the name
    users = table(spark, sf_dir, "events").select("user_id", trees_).distinct()
    seeds = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts")).agg(F.max_by("user_id", F.struct("value", "event_id")).alias("seed")).select("seed").distinct().select(trees_, "seed", F.col("seed").alias("fn"))
    grown = growth.grow(
        seeds, of("error", "purchase", 25), built, built.where("file % 5 <> 0").select("tree", "file", source.alias("source")).distinct(),
        users.select("tree", file("user_id").alias("file"), F.col("user_id").alias("name"), F.col("user_id").alias("fn")), seeds.select("tree", file("seed").alias("file")),
        of("view", "signup", 15).select("tree", file("src").alias("src"), file("dst").alias("dst")),
    )
    files = grown.loaded.select("tree", F.lit("file").alias("kind"), F.lit(None).cast("long").alias("seed"), F.col("file").alias("item"), "round")
    return files.unionByName(grown.reached.select("tree", F.lit("function").alias("kind"), "seed", F.col("fn").alias("item"), "round"))


@query(
    """WITH d AS (SELECT o_custkey AS symbol, o_orderkey AS decl, CASE WHEN o_totalprice < 60000 THEN 'interface' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'variable' ELSE 'function' END AS kind,
        date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS line, o_orderstatus = 'P' AS exported, o_orderpriority = '5-LOW' AS is_default, o_orderstatus = 'F' AS given FROM orders),
    g AS (SELECT symbol, arg_min(kind, {'l': line, 'd': decl}) AS kind, arg_min(line, {'l': line, 'd': decl}) AS line, bool_or(exported) AS exported, bool_or(is_default) AS default_export,
        bool_and(kind = 'interface' OR kind = 'variable' AND NOT given) AS type_only, count(*) AS overloads FROM d GROUP BY symbol),
    f AS (SELECT o_custkey AS symbol, count(DISTINCT l_partkey) AS seeds FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT g.symbol, kind, CAST(line AS INTEGER) AS line, exported, default_export, type_only, overloads, coalesce(seeds, 0) AS seeds FROM g LEFT JOIN f ON f.symbol = g.symbol"""
)
def symbol_identity(spark, sf_dir):
    """Customers as symbols, their orders as declarations, returned parts as seed functions."""
    orders = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_totalprice") < 60000, "interface").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "variable").otherwise("function")
    declared = orders.select(
        F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("decl"), kind.alias("kind"), F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("line"),
        (F.col("o_orderstatus") == "P").alias("exported"), (F.col("o_orderpriority") == "5-LOW").alias("is_default"), (F.col("o_orderstatus") == "F").alias("given"),
    )
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("fn_id"))
    return symbol.identities(declared, returned.join(orders.select("o_orderkey", F.col("o_custkey").alias("symbol")), "o_orderkey"), ())
