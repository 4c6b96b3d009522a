"""Names and callees as relations: which declaration a name means, what a call leads to, what an array of functions holds.

Positions are numbers on one axis per key (tokens of a file, days of a customer); a declaration is visible in an extent of them.
Every join has the keys and a name or an id as equi-keys, so names are resolved by a shuffle join and not file by file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import containing

#: What a call may lead to, best first; a reason names the kind of declaration that a call stops at.
BODY, HOLDER, EXTERNAL = "body", "holder", "external"
UNRESOLVED, DYNAMIC, ABSTRACT, FUNCTION_TYPE, INTERFACE = "unresolved", "dynamic", "abstract", "function-type", "interface"  # fixed values


def visible_declarations(uses: DataFrame, declarations: DataFrame, keys: Sequence[str], bucket: int | None = None) -> DataFrame:
    """uses(keys.., use, name, at), declarations(keys.., decl, name, from, to) to (keys.., use, decl).

    A use means the declarations of its name whose extent holds it and is the shortest, of equal ones the one that starts last;
    declarations of one extent, such as overloads, are all meant. A name that nothing visible declares has no row, and rows with
    a null name or key match nothing. bucket splits a long axis, as in ranges.containing.
    """
    pairs = containing(uses.select(*keys, "name", "use", "at"), declarations.select(*keys, "name", "decl", "from", "to"), [*keys, "name"], "at", "from", "to", bucket)
    inner = Window.partitionBy(*keys, "use").orderBy(F.col("to").cast("long") - F.col("from"), F.desc("from"))
    return pairs.withColumn("__rank", F.rank().over(inner)).where("__rank = 1").select(*keys, "use", "decl").distinct()


def _outcome(kind: Column, has_body: Column) -> Column:
    plain = F.when(kind.isin("class", "variable"), HOLDER).when(kind == "abstract", ABSTRACT).when(kind.isin("parameter", "function-type"), FUNCTION_TYPE)
    return F.when(has_body, BODY).otherwise(plain.when(kind.isin("signature", "interface"), INTERFACE).otherwise(EXTERNAL))


def choose_callees(calls: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """calls(keys.., call, by_name), candidates(keys.., call, decl, kind, has_body) to (keys.., call, outcome, decl).

    Declarations with a body win; then classes and variables (holder); then the call stops at abstract methods, function types
    and parameters, or interface members, in this order; what is left lies outside. All candidates of the best outcome are kept.
    A call without any candidate is unresolved if its callee is a name or a property, else dynamic; its decl is null.
    """
    order = F.array(*[F.lit(x) for x in (BODY, HOLDER, ABSTRACT, FUNCTION_TYPE, INTERFACE, EXTERNAL)])
    known = candidates.select(*keys, "call", "decl", _outcome(F.col("kind"), F.coalesce("has_body", F.lit(False))).alias("outcome")).distinct()
    ranked = known.withColumn("__rank", F.rank().over(Window.partitionBy(*keys, "call").orderBy(F.array_position(order, F.col("outcome"))))).where("__rank = 1").drop("__rank")
    lost = F.when(F.col("by_name"), UNRESOLVED).otherwise(DYNAMIC)
    return calls.select(*keys, "call", "by_name").join(ranked, [*keys, "call"], "left").select(*keys, "call", F.coalesce("outcome", lost).alias("outcome"), "decl")


def parents(spans: DataFrame, keys: Sequence[str], bucket: int | None = None) -> DataFrame:
    """spans(keys.., id, start, end) to (keys.., id, parent): the shortest other span around each, the smaller id on ties.

    Of two equal spans the smaller id is around the other, so the result is a forest. Spans that nothing holds have no row.
    """
    inner = spans.select(*keys, F.col("id").alias("inner"), F.col("start").alias("line"), F.col("end").alias("to"))
    pairs = containing(inner, spans.select(*keys, "id", "start", "end"), keys, bucket=bucket).where((F.col("end") >= F.col("to")) & (F.col("id") != F.col("inner")))
    length = F.col("end") - F.col("start")
    around = pairs.where((length > F.col("to") - F.col("line")) | (F.col("id") < F.col("inner")))
    return around.groupBy(*keys, F.col("inner").alias("id")).agg(F.min(F.struct(length.alias("length"), F.col("id").alias("id"))).alias("x")).select(*keys, "id", F.col("x.id").alias("parent"))


def seed_functions(declarations: DataFrame, functions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """declarations(keys.., decl, kind, fn, body), functions(keys.., fn, holder) to (keys.., decl, fn).

    A class seeds all functions that its body holds directly; any other declaration its own function, or what it is given.
    """
    members = declarations.where("kind = 'class'").select(*keys, "decl", F.col("body").alias("holder")).join(functions.where("holder is not null").select(*keys, "holder", "fn"), [*keys, "holder"])
    own = declarations.where("kind <> 'class' and fn is not null").select(*keys, "decl", "fn")
    return own.unionByName(members.select(*keys, "decl", "fn")).distinct()


def held_closures(arrays: DataFrame, uses: DataFrame, elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """arrays(keys.., array), uses(keys.., array, known), elements(keys.., array, fn) to (keys.., array, fn, complete).

    One row per function that an array holds, and one with a null fn for an array without any. complete: every use is one that
    can bring no other value in, and every element is a known function. Uses and elements are summed up per array before they
    are joined, so a much used array is one row there.
    """
    summed = [uses.groupBy(*keys, "array").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("a")), elements.groupBy(*keys, "array").agg(F.bool_and(F.col("fn").isNotNull()).alias("b"))]
    out = arrays.select(*keys, "array").distinct()
    for part in (*summed, elements.where("fn is not null").select(*keys, "array", "fn").distinct()):
        out = out.join(part, [*keys, "array"], "left")
    return out.select(*keys, "array", "fn", (F.coalesce("a", F.lit(True)) & F.coalesce("b", F.lit(True))).alias("complete"))
