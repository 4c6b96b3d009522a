"""Roll-ups of crossings, files, hotspots and call statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAME_CAP = 12  # fixed value: names listed per roll-up
HOTSPOTS = 15  # fixed value


def distinct_crossings(crossings: DataFrame) -> DataFrame:
    """(kind, name, file, ..) with count: one row per kind, name and file; other columns of the first row by seq."""
    rest = [c for c in crossings.columns if c not in ("kind", "name", "file", "seq")]
    first = F.min_by(F.struct(*rest), "seq").alias("x") if rest else F.lit(None).alias("x")
    out = crossings.groupBy("kind", "name", "file").agg(F.count("*").alias("count"), first)
    return out.select("kind", "name", "file", "count", *[F.col(f"x.{c}") for c in rest])


def roll_up(crossings: DataFrame, by: Sequence[str], cap: int = NAME_CAP) -> DataFrame:
    """(by.., calls, references, type_only, names): sums by kind, type-only if all are, the first names in order."""
    call = F.col("kind") == "call"
    return crossings.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(call, F.col("count"))), F.lit(0)).alias("calls"),
        F.coalesce(F.sum(F.when(~call, F.col("count"))), F.lit(0)).alias("references"),
        F.bool_and("type_only").alias("type_only"),
        F.slice(F.array_sort(F.collect_set("name")), 1, cap).alias("names"),
    )


def hotspots(functions: DataFrame, limit: int = HOTSPOTS) -> DataFrame:
    """The functions of most own and inline complexity; fn_id breaks ties."""
    return functions.withColumn("count", F.col("own") + F.col("inline")).orderBy(F.desc("count"), "fn_id").limit(limit)


def per_file(functions: DataFrame) -> DataFrame:
    return functions.groupBy("file").agg(F.count("*").alias("functions"), F.sum(F.col("own") + F.col("inline")).alias("complexity"))


def histogram(rows: DataFrame, by: Sequence[str], name: str = "count") -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def first_per_bucket(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], limit: int) -> DataFrame:
    """A bounded sample: the first rows of each bucket in an order."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("__n") <= limit).drop("__n")


# Buckets of a call by what its callee turned out to be.
BUCKETS = ("body:module", "body:repo", "no-body:repo", "external", "param", "unresolved", "dynamic")


def classify_calls(calls: DataFrame) -> DataFrame:
    """calls with bucket, from has_body, in_module, in_repo, is_param, is_dynamic, resolved."""
    c = F.col
    bucket = (
        F.when(c("is_dynamic"), "dynamic")
        .when(c("is_param"), "param")
        .when(~c("resolved"), "unresolved")
        .when(c("has_body") & c("in_module"), "body:module")
        .when(c("has_body") & c("in_repo"), "body:repo")
        .when(c("in_repo"), "no-body:repo")
        .otherwise("external")
    )
    return calls.withColumn("bucket", bucket)


def followability(calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of in-module bodies among the calls that a walk inside the module should follow; null without any."""
    n = lambda *names: F.count(F.when(F.col("bucket").isin(*names), 1))
    return calls.groupBy(*by).agg((n("body:module") / F.nullif(n("body:module", "unresolved", "param", "no-body:repo"), F.lit(0).cast("long"))).alias("followability"))


def merge_strategies(calls: DataFrame, first: str, second: str, by: Sequence[str]) -> DataFrame:
    """Two answers to one question: how often only one, both or neither has one, and how often two differ."""
    a, b = F.col(first), F.col(second)
    n = lambda c: F.count(F.when(c, 1))
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"), n(a.isNotNull() & b.isNull()).alias("only_first"), n(a.isNull() & b.isNotNull()).alias("only_second"),
        n(F.coalesce(a, b).isNull()).alias("neither"), (n(a.isNotNull() & b.isNotNull() & (a != b)) / F.count("*")).alias("disagreement"),
    )


def token_counts(tokens: DataFrame, by: Sequence[str], decisions: Sequence[str]) -> DataFrame:
    """Decision tokens per group: an independent count to hold against the sum over functions."""
    return tokens.groupBy(*by).agg(F.count(F.when(F.col("token").isin(*decisions), 1)).alias("decisions"), F.count("*").alias("tokens"))


def compare_counts(functions: DataFrame, outside: DataFrame, tokens: DataFrame) -> DataFrame:
    """Files where the sum of own - 1 and the decisions outside functions differ from the token count."""
    inside = functions.groupBy("file").agg(F.sum(F.col("own") - 1).alias("inside"))
    both = tokens.join(inside, "file", "full_outer").join(outside.select("file", F.col("decisions").alias("beside")), "file", "left")
    total = F.coalesce("inside", F.lit(0)) + F.coalesce("beside", F.lit(0))
    return both.where(total != F.coalesce("decisions", F.lit(0))).select("file", total.alias("counted"), F.coalesce("decisions", F.lit(0)).alias("tokens"))
