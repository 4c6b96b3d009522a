"""Base and head compared: symbols, modules, dependencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MAX_HOPS
from ..functions import paths
from .graph import blast_radius, dependents, indirect_deps


def changed_paths(change_set: DataFrame) -> DataFrame:
    """Every path that a change names, both of a rename, once."""
    return change_set.select(F.explode(F.array_compact(F.array("path", "renamed_from"))).alias("path")).distinct()


def touched_modules(change_set: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return changed_paths(change_set).select(paths.module_of(F.col("path"), patterns).alias("module")).where("module is not null").distinct()


def renamed_modules(change_set: DataFrame, patterns: Sequence[str], order: str = "path") -> DataFrame:
    """(from_module, to_module) of renames across modules; the last by order wins."""
    moved = change_set.where("renamed_from is not null").select(order, paths.module_of(F.col("renamed_from"), patterns).alias("from_module"), paths.module_of(F.col("path"), patterns).alias("to_module"))
    moved = moved.where("from_module is not null and to_module is not null and from_module <> to_module")
    return moved.groupBy("from_module").agg(F.max_by("to_module", order).alias("to_module"))


def symbol_delta(base: DataFrame, head: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base and head: (keys.., complexity, effects, used_by, coverage [, provider, type_only, stops]) joined in full.

    A symbol changed if its complexity or its effects differ; use and coverage play no part.
    """
    keys = [*keys]
    both = base.withColumn("in_base", F.lit(True)).alias("b").join(head.withColumn("in_head", F.lit(True)).alias("h"), keys, "full_outer")
    none = F.array().cast("array<string>")
    b = lambda c: F.col(f"b.{c}")
    h = lambda c: F.col(f"h.{c}")
    effects = lambda side: F.coalesce(side("effects"), none)
    same = b("complexity").eqNullSafe(h("complexity")) & (effects(b) == effects(h))
    status = F.when(b("in_base").isNull(), "added").when(h("in_head").isNull(), "removed").when(~same, "changed").otherwise("same")
    size = lambda side: F.coalesce(F.size(side("used_by")), F.lit(0))
    used = lambda side: F.when(side("used_by").isNull(), 0).otherwise(size(side))
    extra = [F.coalesce(h(c), b(c)).alias(c) for c in ("provider", "type_only") if c in head.columns]
    extra += [F.coalesce(h("stops"), none).alias("stops")] if "stops" in head.columns else []
    return both.select(
        *keys, status.alias("status"),
        used(b).alias("used_by_base"), used(h).alias("used_by_head"), (used(h) - used(b)).alias("used_by_delta"),
        b("complexity").alias("complexity_base"), h("complexity").alias("complexity_head"), (h("complexity") - b("complexity")).alias("complexity_delta"),
        effects(b).alias("effects_base"), effects(h).alias("effects_head"),
        F.array_except(effects(h), effects(b)).alias("effects_added"), F.array_except(effects(b), effects(h)).alias("effects_removed"),
        b("coverage").alias("coverage_base"), h("coverage").alias("coverage_head"), (h("coverage") - b("coverage")).alias("coverage_delta"), *extra,
    )


def set_delta(base: DataFrame, head: DataFrame, keys: Sequence[str], item: str, prefix: str) -> DataFrame:
    """Counts and differences of a set per key: <prefix>_base, _head, _delta, _added, _removed.

    Only added and removed items are collected; the counts are plain sums.
    """
    keys = [*keys]
    marked = base.select(*keys, item, F.lit(1).alias("b"), F.lit(0).alias("h")).distinct().unionByName(head.select(*keys, item, F.lit(0).alias("b"), F.lit(1).alias("h")).distinct())
    merged = marked.groupBy(*keys, item).agg(F.max("b").alias("b"), F.max("h").alias("h"))
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(item))))
    out = merged.groupBy(*keys).agg(F.sum("b").alias("b"), F.sum("h").alias("h"), pick(F.expr("h > b")).alias("added"), pick(F.expr("b > h")).alias("removed"))
    return out.select(*keys, F.col("b").alias(f"{prefix}_base"), F.col("h").alias(f"{prefix}_head"), (F.col("h") - F.col("b")).alias(f"{prefix}_delta"), F.col("added").alias(f"{prefix}_added"), F.col("removed").alias(f"{prefix}_removed"))


def module_delta(touched: DataFrame, modules: DataFrame, symbols: DataFrame, direct: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """One row per touched module; absent sides count as empty, but their complexity stays null, and so does the difference.

    Dependents and unused exports are the head's. A module in neither tree is reported as added.
    """
    side = lambda df, t: df.where(F.col("tree") == t).drop("tree")
    wanted = touched.select("module")
    edges = direct.select("tree", "src", "dst")
    far = indirect_deps(edges, max_hops, ["tree"], only=wanted.withColumnRenamed("module", "src"))
    b, h = [side(modules, t).select("module", *[F.col(c).alias(f"{c}_{t}") for c in ("file_count", "boundary", "total_complexity", "confidence", "type_only", "reasons")], F.lit(True).alias(f"in_{t}")) for t in ("base", "head")]
    out = wanted.join(b, "module", "left").join(h, "module", "left")
    for frame, prefix in ((edges, "direct"), (far, "indirect")):
        mine = frame.withColumnRenamed("src", "module").join(wanted, "module", "left_semi")
        out = out.join(set_delta(side(mine, "base"), side(mine, "head"), ["module"], "dst", prefix), "module", "left")
    near = dependents(side(edges, "head")).withColumnRenamed("node", "module").join(wanted, "module", "left_semi")
    out = out.join(near.groupBy("module").agg(F.array_sort(F.collect_list("dependent")).alias("dependents")), "module", "left")
    unused = side(symbols, "head").where(F.size("used_by") == 0).join(wanted, "module", "left_semi")
    out = out.join(unused.groupBy("module").agg(F.array_sort(F.collect_list("name")).alias("unused_exports")), "module", "left")
    status = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "removed").otherwise("changed")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    count = lambda c, t: F.coalesce(f"{c}_{t}", zero)
    trio = lambda c: [count(c, "base").alias(f"{c}_base"), count(c, "head").alias(f"{c}_head"), (count(c, "head") - count(c, "base")).alias(f"{c}_delta")]
    sets = [x for p in ("direct", "indirect") for x in (*[F.coalesce(f"{p}_{s}", zero).alias(f"{p}_{s}") for s in ("base", "head", "delta")], *[F.coalesce(f"{p}_{s}", none).alias(f"{p}_{s}") for s in ("added", "removed")])]
    return out.select(
        "module", status.alias("status"), F.coalesce("type_only_head", F.lit(False)).alias("type_only"), *trio("file_count"), *trio("boundary"),
        "total_complexity_base", "total_complexity_head", (F.col("total_complexity_head") - F.col("total_complexity_base")).alias("total_complexity_delta"),
        F.coalesce("confidence_base", F.lit(0.0)).alias("confidence_base"), F.coalesce("confidence_head", F.lit(0.0)).alias("confidence_head"), F.col("reasons_head").alias("reasons"),
        *sets, F.coalesce("dependents", none).alias("dependents"), F.coalesce("unused_exports", none).alias("unused_exports"),
    )


__all__ = ["blast_radius", "changed_paths", "module_delta", "renamed_modules", "set_delta", "symbol_delta", "touched_modules"]
