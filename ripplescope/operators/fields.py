"""What the fields of classes hold, by where their classes are constructed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .graph import bfs

BOUND, UNKNOWN, NO_PROPERTY, NOT_LITERAL, NO_ARGUMENT = "bound", "unknown", "no-property", "not-literal", "no-argument"


def bind_fields(slots: DataFrame, sites: DataFrame, given: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """slots(keys.., cls, field, property): the property of its argument from which a class's constructor takes a field;
    sites(keys.., site, cls, form): constructions, form is object, none or other; given(keys.., site, property, type, from_cls,
    from_field): values in a construction's argument, their type if known, or the field that they are
    to (keys.., cls, field, site, property, outcome, type, hops).

    A value that is a field with a slot of its own stands for what that field holds: there is a row for each construction where
    it may come from, hops counts the fields on the shortest way. So each round follows only what the round before found anew,
    and cycles end. Other outcomes: the value's type is unknown, the object has no such property, the argument is no object,
    there is none. A slot whose class is never constructed has no row. Rows with a null class, field or site play no part.
    """
    keys = [*keys]
    slots = slots.where("cls is not null and field is not null").select(*keys, "cls", "field", "property").distinct()
    values = given.where("property is not null").select(*keys, "site", "property", "type", "from_cls", "from_field", F.lit(True).alias("there")).distinct()
    direct = slots.join(sites.where("site is not null").select(*keys, "site", "cls", "form").distinct(), [*keys, "cls"]).join(values, [*keys, "site", "property"], "left")
    known = slots.select(*keys, F.col("cls").alias("from_cls"), F.col("field").alias("from_field"), F.lit(True).alias("passed_on")).distinct()
    direct = direct.join(known, [*keys, "from_cls", "from_field"], "left")
    literal = F.col("form") == "object"
    outcome = (
        F.when(F.col("form") == "none", NO_ARGUMENT).when(~F.coalesce(literal, F.lit(False)), NOT_LITERAL).when(F.col("there").isNull(), NO_PROPERTY)
        .when(F.col("passed_on"), F.lit(None)).when(F.col("type").isNull(), UNKNOWN).otherwise(BOUND)
    )
    slot = lambda cls, field: F.struct(F.col(cls).alias("cls"), F.col(field).alias("field"))
    direct = materialize(direct.select(*keys, slot("cls", "field").alias("node"), F.when(literal & F.col("passed_on"), slot("from_cls", "from_field")).alias("to"), "site", "property", outcome.alias("outcome"), F.when(literal, F.col("type")).alias("type")), "given")
    found = bfs(direct.where("to is not null").select(*keys, F.col("node").alias("src"), F.col("to").alias("dst")), slots.select(*keys, slot("cls", "field").alias("seed"), slot("cls", "field").alias("node")), None, keys)
    ends = direct.where("outcome is not null").drop("to").distinct()
    return found.join(ends, [*keys, "node"]).select(*keys, "seed.cls", "seed.field", "site", "property", "outcome", "type", "hops").groupBy(*keys, "cls", "field", "site", "property", "outcome", "type").agg(F.min("hops").alias("hops"))
