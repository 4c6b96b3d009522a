"""Generic tables seen as the engine's inputs: graphs from events, ranges from orders, paths from page urls.

They exercise the operators on data that a SQL oracle can read too; they are no source trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TABLES
from ..storage import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, rows: int) -> int:
    """Partitions of about so many rows of a table, whose count is read from its files' footers: a task's memory does not grow with the table."""
    return df.count() // rows + 1


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of an hour: (src, dst) users, (src_type, dst_type), ts, value, event_id."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    w = Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    moved = events.select(F.lag("user_id").over(w).alias("src"), F.col("user_id").alias("dst"), F.lag("event_type").over(w).alias("src_type"), F.col("event_type").alias("dst_type"), "ts", "value", "event_id")
    return moved.where("src is not null and src <> dst")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse graph: an error followed by a purchase."""
    return transitions(spark, sf_dir).where("src_type = 'error' and dst_type = 'purchase'")


def order_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of days per customer: an order is open from its date for 5 to 94 days."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("id"), day.alias("start"), (day + 5 + F.col("o_orderkey") % 90).cast("int").alias("end"))


def ship_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a customer's lines were shipped: (file, line, hits), a line once per day."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("file"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).alias("line"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("hit"))
    return lines.join(orders, "l_orderkey").groupBy("file", "line").agg(F.sum("hit").alias("hits"))


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, file): host and path of a page's url, without query and fragment."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "").alias("file"))


def impact_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every user is a file of one function in one of 25 modules; call edges before the 16th are the base tree, all are the head."""
    trees = F.explode(F.array(F.lit("base"), F.lit("head"))).alias("tree")
    in_base = F.lit("2024-01-16").cast("timestamp")
    file = lambda user: F.concat(F.lit("m/"), (F.col(user) % 25).cast("string"), F.lit("/u"), F.col(user).cast("string"), F.lit(".ts"))
    text = lambda value: F.lit(value).cast("string")
    # both are read many times by the report, and events only once for each
    weights = materialize(table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") % 7 + 1).cast("int").alias("own")), "users")
    pairs = materialize(call_edges(spark, sf_dir).groupBy("src", "dst").agg((F.min("ts") < in_base).alias("early")), "calls")
    users = weights.select("*", trees, file("user_id").alias("file"), F.col("user_id").cast("string").alias("fn_id"))
    edges = pairs.select("src", "dst", "early", trees).where("tree = 'head' or early").select("tree", "src", "dst")
    named = F.concat(F.lit("f"), F.col("fn_id")).alias("name")
    wanted = [F.concat(F.lit("f"), F.col("dst").cast("string")).alias("name"), F.concat(F.lit("../"), (F.col("dst") % 25).cast("string"), F.lit("/u"), F.col("dst").cast("string")).alias("spec")]
    out = {k: spark.createDataFrame([], v) for k, v in TABLES.items()}
    out |= {
        "files": users.select("tree", "file", F.lit(False).alias("is_js"), F.lit(False).alias("is_barrel"), text("function").alias("text")),
        "imports": edges.select("tree", file("src").alias("from_file"), F.col("dst").cast("int").alias("stmt_no"), *wanted, F.lit(False).alias("type_only"), F.lit(1).alias("line"), text(None).alias("to_file")),
        "exports": users.select("tree", "file", named, F.lit(1).alias("line"), F.lit(False).alias("type_only")),
        "functions": users.select("tree", "fn_id", "file", F.lit(1).alias("start"), F.lit(9).alias("end"), named, text("function").alias("kind"), "own", F.lit(0).alias("inline"), F.lit(True).alias("exported"), F.lit(False).alias("is_async"), F.col("fn_id").alias("unit_id")),
        "calls": edges.select("tree", F.col("src").cast("string").alias("from_fn"), F.col("dst").cast("int").alias("call_no"), F.col("dst").cast("string").alias("to_fn"), F.lit(1).alias("line"), text("").alias("text"), text(None).alias("via")),
        "decl_seeds": users.select("tree", "file", named, "fn_id"),
        "change_set": users.where("tree = 'head' and user_id < 20").select(F.col("file").alias("path"), text("M").alias("status"), text(None).alias("renamed_from")),
    }
    return out


#: The same views in SQL, in front of each oracle that names them.
SQL = {
    "transitions": """transitions AS (SELECT * FROM (SELECT lag(user_id) OVER w AS src, user_id AS dst, lag(event_type) OVER w AS src_type, event_type AS dst_type, ts, value, event_id
        FROM events WINDOW w AS (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id)) WHERE src IS NOT NULL AND src <> dst)""",
    "call_edges": "call_edges AS (SELECT * FROM transitions WHERE src_type = 'error' AND dst_type = 'purchase')",
    "order_ranges": """order_ranges AS (SELECT o_custkey AS file, o_orderkey AS id, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS "start",
        date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 5 + o_orderkey % 90 AS "end" FROM orders)""",
    "ship_points": """ship_points AS (SELECT o_custkey AS file, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS line, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS hits
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
    "url_paths": "url_paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS file FROM pages)",
}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names) + (",\n" if sql.lstrip().startswith("+") else "\n") + sql.lstrip().removeprefix("+")
