"""Calls, their stops and the seeds of declarations, joined from token rows.

Python only cuts texts into tokens and finds functions (syntax.py). What is declared, where it is visible, what a callee means,
and which functions an array holds are joins of token rows. There are no types: a receiver is known if it is `this`, a class, a
namespace, or a variable or parameter with a named type or a `new` of a class; other receivers stay unresolved. Members that a
class inherits are looked up along `extends`, three classes up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.facts import function_counts
from ..operators.fields import bind_fields
from ..operators.graph import follow_aliases, follow_reexports
from ..operators.names import BODY, EXTERNAL, FUNCTION_TYPE, HOLDER, choose_callees, held_closures, seed_functions, visible_declarations
from ..operators.ranges import containing, innermost
from ..operators.symbol import identities
from ..storage import materialize
from .syntax import decision_nodes, scan_functions, token_rows

KEY = ["tree", "file"]
_END = 2**31 - 1
_HERITAGE = 3

# Methods of arrays that hand an element to their first argument first, that add their arguments, and members
# that add nothing.
ELEMENT_FIRST = "map forEach filter find findIndex findLast findLastIndex some every flatMap".split()
WRITERS = "push unshift".split()
READERS = [*"length reduce reduceRight slice at concat join indexOf lastIndexOf includes entries keys values pop shift reverse sort splice toString".split(), *ELEMENT_FIRST]

_NO_CALLEE = "if for while switch catch with function return typeof await new super import case of in void delete throw yield do else instanceof".split()
# Names that the language or its hosts declare; what they lead to lies outside.
GLOBALS = "Array ArrayBuffer BigInt Boolean Buffer Date Error Function Intl JSON Map Math Number Object Promise Proxy Reflect RegExp Set String Symbol WeakMap WeakSet URL console document fetch globalThis process window parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent setTimeout clearTimeout setInterval clearInterval setImmediate queueMicrotask structuredClone require".split()
_NEW_STATEMENT = "const let var function class return if for while switch try throw export import interface type enum".split()


@dataclass
class Program:
    """Rows of schemas.TABLES of the same names, and what they were joined from."""

    functions: DataFrame
    calls: DataFrame
    call_stops: DataFrame
    decl_seeds: DataFrame
    declarations: DataFrame  # tree, file, decl, name, kind, at, from, to, fn, body, ..
    arrays: DataFrame  # tree, file, array (the decl), fn, complete
    references: DataFrame  # tree, from_fn, kind, name, line, file (null: external), package (of externals), external, type_only
    slots: DataFrame  # tree, cls, field, property: see operators.fields
    sites: DataFrame  # tree, file, site, cls, form, line
    given: DataFrame  # tree, site, property, type, from_cls, from_field


def contexts(tokens: DataFrame) -> DataFrame:
    """Token rows with the tokens before (p1 to p4) and after (n1 to n3), and what follows under the same bracket."""
    order = Window.partitionBy(*KEY).orderBy("at")
    # backwards, so that what follows is what was met last: one pass over a file
    after, beside = (Window.partitionBy(*k).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1) for k in (KEY, [*KEY, "around"]))
    following = lambda which: F.last(F.when(which, F.col("at")), ignorenulls=True).over(beside)
    return tokens.select(
        "*", *[F.lag("text", i).over(order).alias(f"p{i}") for i in (1, 2, 3, 4)], *[F.lead("text", i).over(order).alias(f"n{i}") for i in (1, 2, 3)], F.lead("pair", 1).over(order).alias("n1_pair"),
        following(F.col("text") == "{").alias("brace"), following(F.col("text") == "=").alias("equals"), following(F.col("text").isin(";", *_NEW_STATEMENT)).alias("ends"),
        F.last(F.when(F.col("kind") == "string", F.col("text")), ignorenulls=True).over(after).alias("string_after"),
    )


def _brackets(near: DataFrame) -> DataFrame:
    """(tree, file, open, close, bracket, p1 to p3, outer, from, to, outer_from, outer_to): from and to are where names that are
    declared directly inside are visible. A for statement's round bracket reaches over its block."""
    opened = near.where("pair > at").select(*KEY, F.col("at").alias("open"), F.col("text").alias("bracket"), "p1", "p2", "p3", F.col("pair").alias("close"), F.col("around").alias("outer"))
    closed = near.where("pair < at").select(*KEY, F.col("at").alias("close"), F.col("n1").alias("then"), "n1_pair")
    to = F.when(F.col("bracket") == "{", F.col("close")).when((F.col("bracket") == "(") & (F.col("then") == "{"), F.col("n1_pair")).otherwise(F.lit(_END))
    found = opened.join(closed, [*KEY, "close"]).select(*KEY, "open", "close", "bracket", "p1", "p2", "p3", "outer", F.col("open").alias("from"), to.alias("to"))
    outer = found.select(*KEY, F.col("open").alias("outer"), F.col("from").alias("outer_from"), F.col("to").alias("outer_to"))
    whole = found.join(outer, [*KEY, "outer"], "left")
    return whole.withColumns({"outer_from": F.coalesce("outer_from", F.lit(-1)), "outer_to": F.coalesce("outer_to", F.lit(_END))})


def _declarations(near: DataFrame, brackets: DataFrame, functions: DataFrame) -> DataFrame:
    """(tree, file, decl, name, kind, at, line, from, to, fixed, value, literal, type, base, body, first_place, spec, source, fn): all but
    members of classes.

    value is the first token that a variable is given, type the name of its type or of what it is a `new` of, base the class that
    a class extends, body the brace of a class or interface, source the name that an import asks of spec. fixed: a const; literal:
    it is given an array, a text or a number.
    """
    none = {k: F.lit(None).cast(t) for k, t in (("fixed", "boolean"), ("value", "int"), ("type", "string"), ("base", "string"), ("body", "int"), ("first_place", "boolean"), ("spec", "string"), ("source", "string"))}
    shape = lambda df, **given: df.select(*KEY, F.col("text").alias("name"), "at", "line", "from", "to", *[(given.get(k, v)).alias(k) for k, v in {"kind": None, **none}.items()])
    words = near.where("kind = 'word'")
    block = brackets.select(*KEY, F.col("open").alias("around"), "from", "to")
    anywhere = lambda df: df.join(block, [*KEY, "around"], "left").withColumns({"from": F.coalesce("from", F.lit(-1)), "to": F.coalesce("to", F.lit(_END))})
    given = F.when((F.col("equals") < F.coalesce("ends", F.lit(_END))) & F.col("n1").isin("=", ":"), F.col("equals") + 1)
    typed = F.when(F.col("n1") == ":", F.col("n2")).when((F.col("n1") == "?") & (F.col("n2") == ":"), F.col("n3"))
    made = F.when((F.col("n1") == "=") & (F.col("n2") == "new"), F.col("n3"))

    variables = anywhere(words.where("p1 in ('const', 'let', 'var')")).withColumns({"is_var": F.col("p1") == "var", "id": F.col("at")})
    # var is visible in the whole function around it
    around = innermost(variables.where("is_var").select(*KEY, "id", "at"), functions.select(*KEY, "fn", "first", "last"), KEY, [*KEY, "id"], "fn", line="at", start="first", end="last")
    around = around.join(functions.select(*KEY, "fn", F.col("first").alias("v_from"), F.col("last").alias("v_to")), [*KEY, "fn"]).drop("fn")
    variables = variables.join(around, [*KEY, "id"], "left")
    variables = variables.withColumns({"from": F.when(F.col("is_var"), F.coalesce("v_from", F.lit(-1))).otherwise(F.col("from")), "to": F.when(F.col("is_var"), F.coalesce("v_to", F.lit(_END))).otherwise(F.col("to"))})
    variables = shape(variables, kind=F.lit("variable"), fixed=F.col("p1") == "const", value=given, type=F.coalesce(made, typed))
    opened = brackets.where("bracket in ('{', '[') and p1 in ('const', 'let', 'var')").select(*KEY, F.col("open").alias("around"), F.col("outer_from").alias("from"), F.col("outer_to").alias("to"))
    taken = shape(words.where("n1 in (',', '}', ']', '=')").join(opened, [*KEY, "around"]), kind=F.lit("variable"), fixed=F.lit(False))
    keyword = F.when(F.col("p1") == "*", F.col("p2")).otherwise(F.col("p1"))
    named = anywhere(words.where("p1 in ('function', 'class', 'interface', 'type', 'enum') or p1 = '*' and p2 = 'function'"))
    named = shape(named, kind=keyword, body=F.when(keyword.isin("class", "interface"), F.col("brace")), base=F.when((keyword == "class") & (F.col("n1") == "extends"), F.col("n2")), value=F.when(keyword == "function", F.col("at") - F.when(F.col("p1") == "*", 2).otherwise(1)))
    listed = functions.where("parameters is not null").select(*KEY, F.col("parameters").alias("around"), F.col("first").alias("from"), F.col("last").alias("to"))
    listed = words.where("p1 in ('(', ',', '...', 'private', 'public', 'protected', 'readonly') and n1 in (',', ')', ':', '=', '?')").join(listed, [*KEY, "around"])
    parameters = shape(listed, kind=F.lit("parameter"), type=typed, first_place=F.col("at") == F.col("around") + 1)
    alone = functions.where("kind = 'arrow' and parameters is null").select(*KEY, F.col("first").alias("at"), F.col("first").alias("from"), F.col("last").alias("to"))
    parameters = parameters.unionByName(shape(words.join(alone, [*KEY, "at"]), kind=F.lit("parameter"), first_place=F.lit(True)))
    caught = shape(anywhere(words.where("p1 = '(' and p2 = 'catch'")), kind=F.lit("parameter"), first_place=F.lit(False))
    spec = F.regexp_replace("string_after", "^['\"]|['\"]$", "")
    whole = {"from": F.lit(-1), "to": F.lit(_END)}
    braces = brackets.where("bracket = '{' and (p1 = 'import' or p1 = 'type' and p2 = 'import' or p1 = ',' and 'import' in (p3, p2))").select(*KEY, F.col("open").alias("around"))
    some = words.where("n1 in (',', '}')").join(braces, [*KEY, "around"], "left_semi").withColumns(whole)
    imported = shape(some, kind=F.lit("import"), spec=spec, source=F.when(F.col("p1") == "as", F.col("p2")).otherwise(F.col("text")))
    default = words.where("(p1 = 'import' or p1 = 'type' and p2 = 'import') and n1 in ('from', ',')").withColumns(whole)
    space = words.where("p1 = 'as' and p2 = '*' and p3 in ('import', ',', 'type')").withColumns(whole)
    parts = [taken, named, parameters, caught, imported, shape(default, kind=F.lit("import"), spec=spec, source=F.lit("default")), shape(space, kind=F.lit("import"), spec=spec, source=F.lit("*"))]
    for part in parts:
        variables = variables.unionByName(part)
    own = functions.select(*KEY, "fn", F.col("first").alias("value"))
    late = functions.where("is_async").select(*KEY, "fn", (F.col("first") - 1).alias("value"))
    starts = near.select(*KEY, F.col("at").alias("value"), F.when((F.col("text") == "[") | F.col("kind").isin("string", "number"), True).alias("literal"))
    found = variables.join(own.unionByName(late), [*KEY, "value"], "left").join(starts, [*KEY, "value"], "left").withColumn("decl", F.concat_ws("@", "file", "at"))
    return found.select(*KEY, "decl", "name", "kind", "at", "line", "from", "to", "fixed", "value", "literal", "type", "base", "body", "first_place", "spec", "source", "fn")


def _members(near: DataFrame, declarations: DataFrame, functions: DataFrame) -> DataFrame:
    """(tree, file, body, name, decl, kind, fn): what stands directly in a class or an interface."""
    bodies = declarations.where("body is not null").select(*KEY, F.col("body").alias("around"), F.col("kind").alias("of"))
    inside = near.where("kind in ('word', 'string') and n1 in ('(', '=', ':', '?', '<')").join(bodies, [*KEY, "around"])
    value = F.when(F.col("n1").isin("=", ":") & (F.col("equals") < F.coalesce("ends", F.lit(_END))), F.col("equals") + 1)
    inside = inside.withColumns({"value": F.when(F.col("n1").isin("(", "<"), F.col("at")).otherwise(value), "decl": F.concat_ws("@", "file", "at"), "name": F.regexp_replace("text", "^['\"]|['\"]$", "")})
    bodied = functions.select(*KEY, F.col("first").alias("value"), "fn").unionByName(functions.where("is_async").select(*KEY, (F.col("first") - 1).alias("value"), "fn"))
    kind = F.when(F.col("of") == "interface", "signature").when(F.array_contains(F.array("p1", "p2", "p3"), "abstract"), "abstract").when(F.col("n1").isin("(", "<"), "method").otherwise("property")
    return inside.join(bodied, [*KEY, "value"], "left").select(*KEY, F.col("around").alias("body"), "name", "decl", kind.alias("kind"), "fn").where("kind <> 'property' or fn is not null")


def _followed(found: DataFrame, declarations: DataFrame, targets: DataFrame) -> DataFrame:
    """found(tree, file, use, decl): imports among the declarations give way to what they import, where that is known.

    Gives (tree, file, use, decl, at_file): the declaration's own file.
    """
    keep = declarations.select(*KEY, "decl", "kind")
    named = found.join(keep, [*KEY, "decl"])
    plain = named.where("kind <> 'import'").select(*KEY, "use", "decl", F.col("file").alias("at_file"))
    across = named.where("kind = 'import'").join(targets, [*KEY, "decl"], "left")
    return plain.unionByName(across.select(*KEY, "use", F.coalesce("to_decl", "decl").alias("decl"), F.coalesce("to_file", "file").alias("at_file")))


def scan_program(files: DataFrame, imports: DataFrame, reexports: DataFrame, exports: DataFrame, depth: int = 6) -> Program:
    """files(tree, file, text); imports and re-exports resolved (to_file), exports as of schemas.TABLES.

    A call belongs to every function around it. Calls outside any function, and calls of a name with type arguments, are not seen. A call whose callee is a parameter that
    takes the elements of a const array counts as resolved if all that the array can hold is known and counted where it stands.
    Texts that are null or empty have no rows.
    """
    near = materialize(contexts(token_rows(files)), "tokens")
    scanned = materialize(scan_functions(files).withColumnRenamed("fn_id", "fn"), "functions")
    functions = scanned.join(near.select(*KEY, F.col("at").alias("first"), F.col("around").alias("holder")), [*KEY, "first"])
    brackets = materialize(_brackets(near), "brackets")
    declarations = materialize(_declarations(near, brackets, functions), "declarations")
    members = materialize(_members(near, declarations, functions), "members")

    # what an import means: a declaration at the top of the file where its name comes from
    bound = declarations.where("kind = 'import' and source <> '*'").select(*KEY, "decl", "spec", "source")
    reached = imports.where("to_file is not null").select("tree", F.col("from_file").alias("file"), "spec", "to_file").distinct()
    bound = bound.join(reached, [*KEY, "spec"])
    asked = bound.select("tree", F.col("to_file").alias("file"), F.col("source").alias("name")).distinct()
    # chains of named re-exports are followed to their end, then what is exported with a star, some files deep
    place = lambda file, name: F.struct(F.col(file).alias("file"), F.col(name).alias("name"))
    passed_on = reexports.where("not star and to_file is not null and exported is not null and source is not null").join(exports.select("tree", F.col("file").alias("from_file"), F.col("name").alias("exported")), ["tree", "from_file", "exported"], "left_anti")
    ends = follow_aliases(passed_on.select("tree", place("from_file", "exported").alias("src"), place("to_file", "source").alias("dst")), ["tree"]).select("tree", "src.*", "end")
    asked = asked.join(ends, ["tree", "file", "name"], "left").withColumn("end", F.coalesce("end", place("file", "name")))
    found = follow_reexports(exports, reexports, asked.select("tree", "end.*").distinct(), depth).select("tree", place("file", "name").alias("end"), "origin_file", "origin_name")
    origins = asked.join(found, ["tree", "end"]).select("tree", F.col("file").alias("to_file"), F.col("name").alias("source"), "origin_file", "origin_name")
    top = declarations.where("from = -1 and kind <> 'import'").select("tree", F.col("file").alias("origin_file"), F.col("name").alias("origin_name"), F.col("decl").alias("to_decl"))
    targets = bound.join(origins, ["tree", "to_file", "source"]).join(top, ["tree", "origin_file", "origin_name"])
    targets = materialize(targets.select(*KEY, "decl", "to_decl", F.col("origin_file").alias("to_file")), "targets")
    resolve = lambda uses: _followed(visible_declarations(uses, declarations, KEY), declarations, targets)

    # calls: a name, a property of a receiver, or something else before a bracket
    named = functions.select(*KEY, F.col("first").alias("at"))
    called = near.where((F.col("kind") == "word") & (F.col("n1") == "(") & ~F.col("text").isin(*_NO_CALLEE) & (F.col("p1").isNull() | ~F.col("p1").isin("function", "*")))
    listed = functions.where("parameters is not null").select(*KEY, (F.col("parameters") - 1).alias("at"))  # async, or a name
    called = called.join(named.unionByName(listed), [*KEY, "at"], "left_anti").join(members.select(*KEY, F.split("decl", "@")[1].cast("int").alias("at")), [*KEY, "at"], "left_anti")
    receiver = F.when(F.col("p1").isin(".", "?."), F.when(F.coalesce(F.col("p3"), F.lit("")).isin(".", "?."), F.lit("")).otherwise(F.col("p2")))
    sites = called.select(*KEY, F.col("at").alias("use"), "at", "line", F.col("text").alias("name"), receiver.alias("receiver"), F.lit(True).alias("by_name"))
    passed = near.where("text = '(' and pair is not null and p1 in (')', ']')").join(brackets.where(F.col("p1").isin(*_NO_CALLEE)).select(*KEY, (F.col("close") + 1).alias("at")), [*KEY, "at"], "left_anti")
    passed = passed.join(functions.where("parameters is not null").select(*KEY, F.col("parameters").alias("at")), [*KEY, "at"], "left_anti")
    other = passed.select(*KEY, F.col("at").alias("use"), "at", "line", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("receiver"), F.lit(False).alias("by_name"))
    sites = materialize(sites.unionByName(other), "calls")
    # a walk goes through nested functions too, so a call is one of every function around it
    around = containing(sites.select(*KEY, F.col("use").alias("call"), "at", "line", F.coalesce("name", F.lit("")).alias("text")), functions.select(*KEY, F.col("fn").alias("from_fn"), "first", "last"), KEY, "at", "first", "last")
    at = materialize(around.drop("at", "first", "last"), "around")

    direct = resolve(sites.where("receiver is null and name is not null").select(*KEY, "use", "name", "at"))
    outside = sites.where(F.col("name").isin(*GLOBALS) & F.col("receiver").isNull() | F.col("receiver").isin(*GLOBALS))
    outside = outside.select(*KEY, "use", F.lit(None).cast("string").alias("decl"), F.lit("outside").alias("kind"), F.lit(None).cast("string").alias("fn"))
    candidates = _candidates(direct, declarations).unionByName(outside).unionByName(_by_receiver(sites, declarations, members, targets, resolve, brackets, exports, reached))
    chosen = materialize(choose_callees(sites.select(*KEY, F.col("use").alias("call"), "by_name"), candidates.select(*KEY, F.col("use").alias("call"), "decl", "kind", F.col("fn").isNotNull().alias("has_body")), KEY), "callees")

    references = _references(near, declarations, targets, reached, sites, at, functions)

    # functions behind the declarations that calls lead to
    holders = declarations.select("tree", "decl", "kind", "fn", F.col("file").alias("in_file"), "body").unionByName(members.select("tree", "decl", "kind", "fn", F.col("file").alias("in_file"), F.lit(None).cast("int").alias("body")))
    placed = holders.withColumn("body", F.concat_ws("@", "in_file", F.col("body").cast("string")))
    held = functions.select("tree", "fn", F.concat_ws("@", "file", F.col("holder").cast("string")).alias("holder"))
    seeds = materialize(seed_functions(placed, held, ["tree"]).join(placed.select("tree", "decl", "in_file"), ["tree", "decl"]), "seeds")
    led = chosen.where(F.col("outcome").isin(BODY, HOLDER)).join(seeds, ["tree", "decl"]).join(at, [*KEY, "call"])
    plain = led.select("tree", "from_fn", F.col("call").alias("call_no"), F.col("fn").alias("to_fn"), "line", "text", F.lit(None).cast("string").alias("via"))

    # closures that arrays hold
    counts = function_counts(decision_nodes(scanned.withColumnRenamed("fn", "fn_id")), scanned.withColumnRenamed("fn", "fn_id"))
    arrays = materialize(_arrays(near, brackets, declarations, functions, resolve), "arrays")
    taken = _element_calls(chosen, declarations, near, functions, resolve)
    unit = counts.select("tree", F.col("fn_id").alias("fn"), F.col("unit_id").alias("unit"))
    own_unit = at.join(unit.select("tree", F.col("fn").alias("from_fn"), F.col("unit").alias("own")), ["tree", "from_fn"])
    met = taken.join(arrays, [*KEY, "array"]).join(unit, ["tree", "fn"], "left").join(own_unit, [*KEY, "call"])
    apart = F.col("fn").isNull() | (F.col("unit") == F.col("fn"))
    accounted = met.groupBy(*KEY, "call", "from_fn").agg(F.bool_and(F.col("complete") & (apart | (F.col("unit") == F.col("own")))).alias("ok")).where("ok").select(*KEY, "call", "from_fn")
    through = met.where(F.col("fn").isNotNull() & apart).select("tree", "from_fn", F.col("call").alias("call_no"), F.col("fn").alias("to_fn"), "line", "text", F.lit("closure").alias("via"))
    calls = plain.unionByName(through).distinct()

    reasons = chosen.where(~F.col("outcome").isin(BODY, HOLDER, EXTERNAL)).join(at, [*KEY, "call"]).join(accounted, [*KEY, "call", "from_fn"], "left_anti")
    where = placed.select("tree", "decl", F.col("in_file").alias("decl_file"))
    stops = reasons.join(where, ["tree", "decl"], "left")
    stops = stops.groupBy("tree", "from_fn", F.col("call").alias("call_no"), F.col("outcome").alias("reason"), "line", "text").agg(F.min("decl_file").alias("decl_file"))
    shown = declarations.where("from = -1 and kind <> 'import'").select(*KEY, "name", "decl").join(seeds.select("tree", "decl", F.col("fn").alias("fn_id")), ["tree", "decl"])
    unnamed = near.where("text = 'default' and p1 = 'export'").select(*KEY, (F.col("at") + 1).alias("first"))
    default = functions.join(unnamed.unionByName(unnamed.withColumn("first", F.col("first") + 1)), [*KEY, "first"]).select(*KEY, F.lit("default").alias("name"), F.col("fn").alias("fn_id"))
    table = scanned.withColumnRenamed("fn", "fn_id").select("tree", "fn_id", "file", "start", "end", "name", "kind", "exported", "is_async").join(counts, ["tree", "fn_id"])
    return Program(
        functions=table.select("tree", "fn_id", "file", "start", "end", "name", "kind", "own", "inline", "exported", "is_async", "unit_id"),
        calls=materialize(calls, "calls"), call_stops=materialize(stops.select("tree", "from_fn", "call_no", "reason", "decl_file", "line", "text"), "stops"),
        decl_seeds=materialize(shown.select(*KEY, "name", "fn_id").unionByName(default).distinct(), "decl-seeds"), declarations=declarations, arrays=arrays,
        references=materialize(references, "references"), **_constructions(near, brackets, declarations, functions, resolve),
    )


def symbol_identities(program: Program, exports: DataFrame) -> DataFrame:
    """(tree, file, symbol, kind, line, exported, default_export, type_only, overloads, seeds) of what files declare at their top.

    exports(tree, file, name, line); a declaration is the default export if its line says so.
    """
    declared = program.declarations.where("from = -1 and kind <> 'import' and name is not null")
    shown = exports.where("name <> 'default'").select(*KEY, "name", F.lit(True).alias("exported")).distinct()
    default = exports.where("name = 'default'").select(*KEY, "line", F.lit(True).alias("is_default")).distinct()
    declared = declared.join(shown, [*KEY, "name"], "left").join(default, [*KEY, "line"], "left")
    declared = declared.select(*KEY, F.col("name").alias("symbol"), "decl", "kind", "line", (F.col("exported") | F.col("is_default")).alias("exported"), "is_default", F.col("value").isNotNull().alias("given"))
    declared = declared.withColumn("exported", F.coalesce("exported", F.lit(False)))
    return identities(declared, program.decl_seeds.withColumnRenamed("name", "symbol"), KEY)


def field_bindings(program: Program) -> DataFrame:
    """(tree, class, field, file, line, property, outcome, type, hops): what constructions give to the fields of classes.

    A constructor gives a field if it assigns a plain name to it, the last one if there are several; the construction's first
    argument is then searched for a property of that name. A value's type is that of a declared variable or parameter, what it is
    a `new` of, or that of a literal.
    """
    found = bind_fields(program.slots, program.sites, program.given, ["tree"])
    named = program.declarations.where("kind = 'class'").select("tree", F.col("decl").alias("cls"), F.col("name").alias("class"))
    return found.join(program.sites.select("tree", "site", "file", "line"), ["tree", "site"]).join(named, ["tree", "cls"]).select("tree", "class", "field", "file", "line", "property", "outcome", "type", "hops")


def _constructions(near, brackets, declarations, functions, resolve) -> dict[str, DataFrame]:
    """slots, sites and given of a Program; nothing is computed until they are asked for."""
    classes = declarations.where("kind = 'class' and body is not null").select(*KEY, "decl", F.col("body").alias("open"))
    spans = classes.join(brackets.select(*KEY, "open", "close"), [*KEY, "open"]).select(*KEY, F.col("decl").alias("cls"), F.col("open").alias("start"), F.col("close").alias("end"))
    around = lambda df, *columns: innermost(df, spans, KEY, [*KEY, *columns], "cls", line="at")
    after = near.select(*KEY, (F.col("at") - 1).alias("at"), F.col("line").alias("n_line"))
    ends = F.col("n1").isNull() | F.col("n1").isin(";", "}", ",") | (F.col("n_line") > F.col("line")) & (F.col("n1").rlike(r"^[\w$#@]") & ~F.col("n1").isin("as", "in", "instanceof", "satisfies"))
    plain = (F.col("kind") == "word") & ~F.col("text").isin(*_NO_CALLEE, "this", "true", "false", "null", "undefined")
    assigned = near.where("p1 = '=' and p3 = '.' and p4 = 'this'").where(plain).join(after, [*KEY, "at"], "left").where(ends).select(*KEY, "at", F.col("p2").alias("field"), F.col("text").alias("property"))
    inside = containing(assigned, functions.where("kind = 'constructor'").select(*KEY, "first", "last"), KEY, "at", "first", "last").select(*KEY, "at", "field", "property").distinct()
    slots = around(inside, "at", "field", "property").groupBy("tree", "cls", "field").agg(F.max_by("property", "at").alias("property"))

    made = near.where("p1 = 'new' and kind = 'word' and n1 = '('").select(*KEY, F.col("at").alias("use"), "at", F.col("text").alias("name"), "line", "n2")
    form = F.when(F.col("n2") == "{", "object").when(F.col("n2") == ")", "none").otherwise("other")
    meant = resolve(made.select(*KEY, "use", "name", "at")).join(classes.select("tree", "decl"), ["tree", "decl"], "left_semi").select(*KEY, "use", F.col("decl").alias("cls"))
    sites = made.join(meant, [*KEY, "use"]).select(*KEY, F.concat_ws("@", "file", "use").alias("site"), "cls", form.alias("form"), "line", (F.col("use") + 2).alias("around"))

    listed = near.where("kind = 'word' and p1 in ('{', ',') and n1 in (':', ',', '}')").join(sites.where("form = 'object'").select(*KEY, "around", "site").distinct(), [*KEY, "around"])
    listed = listed.select(*KEY, "site", F.col("text").alias("property"), F.when(F.col("n1") == ":", F.col("at") + 2).otherwise(F.col("at")).alias("at"))
    values = listed.join(near.select(*KEY, "at", "kind", "text", "n1", "n2", "n3"), [*KEY, "at"])
    last = lambda c: F.col(c).isin(",", "}")
    words = values.where((F.col("kind") == "word") & (last("n1") | (F.col("n1") == ":"))).select(*KEY, F.col("at").alias("use"), F.col("text").alias("name"), "at").distinct()
    types = resolve(words).join(declarations.select("tree", "decl", F.col("type").alias("declared")), ["tree", "decl"]).groupBy(*KEY, F.col("use").alias("at")).agg(F.min("declared").alias("declared"))
    own = around(values.where(F.col("text") == "this").select(*KEY, "at").distinct(), "at").select(*KEY, "at", F.col("cls").alias("from_cls"))
    field = F.when((F.col("text") == "this") & (F.col("n1") == ".") & last("n3"), F.col("n2"))
    type_ = (
        F.when((F.col("text") == "new") & (F.col("kind") == "word"), F.col("n1")).when((F.col("kind") == "string") & last("n1"), "string")
        .when((F.col("kind") == "number") & last("n1"), "number").when(F.col("text").isin("true", "false") & last("n1"), "boolean").otherwise(F.col("declared"))
    )
    given = values.join(types, [*KEY, "at"], "left").join(own, [*KEY, "at"], "left").select("tree", "site", "property", type_.alias("type"), F.when(field.isNotNull(), F.col("from_cls")).alias("from_cls"), field.alias("from_field"))
    return {"slots": slots, "sites": sites.select(*KEY, "site", "cls", "form", "line"), "given": given}


def _candidates(found: DataFrame, declarations: DataFrame) -> DataFrame:
    """found(tree, file, use, decl, at_file) with the kind and function of the declaration."""
    return found.select(*KEY, "use", "decl").join(declarations.select("tree", "decl", "kind", "fn"), ["tree", "decl"]).select(*KEY, "use", "decl", "kind", "fn")


def _by_receiver(sites, declarations, members, targets, resolve, brackets, exports, reached) -> DataFrame:
    """Candidates of calls on a receiver: members of its class or interface, or what a namespace exports."""
    asked = sites.where("receiver is not null").select(*KEY, "use", "at", F.col("name").alias("member"), "receiver")
    bodies = declarations.where("body is not null").select("tree", F.col("file").alias("at_file"), "decl", "kind", "body", "base", F.col("at").alias("decl_at"))
    spans = declarations.where("kind = 'class' and body is not null").join(brackets.select(*KEY, F.col("open").alias("body"), "close"), [*KEY, "body"]).select(*KEY, "decl", F.col("body").alias("start"), F.col("close").alias("end"))
    own = innermost(asked.where("receiver in ('this', 'super')").select(*KEY, "use", "at", "member"), spans, KEY, [*KEY, "use", "member"], "decl", line="at").withColumn("at_file", F.col("file"))
    # a name: the class itself, or the type of a variable or parameter, looked up where that is declared
    meant = resolve(asked.where("receiver not in ('this', 'super', '')").select(*KEY, "use", F.col("receiver").alias("name"), "at")).join(asked.select(*KEY, "use", "member"), [*KEY, "use"])
    held = declarations.select("tree", "decl", "kind", "type", "literal", F.col("at").alias("decl_at"))
    known = meant.join(held, ["tree", "decl"])
    built_in = known.where(F.col("literal") | F.col("type").isin(*GLOBALS)).select(*KEY, "use", "decl", F.lit("outside").alias("kind"), F.lit(None).cast("string").alias("fn"))
    types = known.where("type is not null").select("tree", F.col("at_file").alias("file"), F.col("decl").alias("of"), F.col("type").alias("name"), F.col("decl_at").alias("at")).distinct()
    classes = resolve(types.withColumn("use", F.col("of")).select(*KEY, "use", "name", "at")).select("tree", F.col("use").alias("of"), F.col("decl").alias("as"), F.col("at_file").alias("as_file"))
    typed = known.select(*KEY, "use", "member", F.col("decl").alias("of")).join(classes, ["tree", "of"]).select(*KEY, "use", "member", F.col("as").alias("decl"), F.col("as_file").alias("at_file"))
    level = own.select(*KEY, "use", "member", "decl", "at_file").unionByName(known.where("kind in ('class', 'interface')").select(*KEY, "use", "member", "decl", "at_file")).unionByName(typed)
    listed = members.select("tree", F.col("file").alias("at_file"), "body", F.col("name").alias("member"), F.col("decl").alias("to_decl"), F.col("kind").alias("to_kind"), "fn")
    out = built_in
    for step in range(_HERITAGE + 1):
        level = materialize(level.distinct(), "receivers")
        at = level.join(bodies, ["tree", "at_file", "decl"])
        hit = at.join(listed, ["tree", "at_file", "body", "member"]).select(*KEY, "use", F.col("to_decl").alias("decl"), F.col("to_kind").alias("kind"), "fn")
        out = out.unionByName(hit)
        if step == _HERITAGE:
            break
        up = at.where("base is not null").join(hit.select(*KEY, "use"), [*KEY, "use"], "left_anti")
        if up.isEmpty():
            break
        bases = up.select("tree", F.col("at_file").alias("file"), F.col("decl").alias("of"), F.col("base").alias("name"), F.col("decl_at").alias("at")).distinct()
        above = resolve(bases.withColumn("use", F.col("of")).select(*KEY, "use", "name", "at")).select("tree", F.col("use").alias("of"), F.col("decl").alias("as"), F.col("at_file").alias("as_file"))
        level = up.select(*KEY, "use", "member", F.col("decl").alias("of")).join(above, ["tree", "of"]).select(*KEY, "use", "member", F.col("as").alias("decl"), F.col("as_file").alias("at_file"))
    # a namespace: what its file exports under that name
    spaces = declarations.where("kind = 'import' and source = '*'").select(*KEY, "decl", "spec").join(reached, [*KEY, "spec"]).select("tree", "decl", "to_file")
    shown = exports.select("tree", F.col("file").alias("to_file"), F.col("name").alias("member")).distinct()
    top = declarations.where("from = -1 and kind <> 'import'").select("tree", F.col("file").alias("to_file"), F.col("name").alias("member"), F.col("decl").alias("to_decl"), F.col("kind").alias("to_kind"), "fn")
    inside = meant.join(spaces, ["tree", "decl"]).join(shown, ["tree", "to_file", "member"], "left_semi").join(top, ["tree", "to_file", "member"])
    return out.unionByName(inside.select(*KEY, "use", F.col("to_decl").alias("decl"), F.col("to_kind").alias("kind"), "fn"))


def _references(near, declarations, targets, reached, sites, at, functions) -> DataFrame:
    """Uses of imported names in functions: where the name is declared, or of which external package it is.

    A namespace stands for its file. Calls of external names are there as calls, too; a use of an external name counts as a type.
    """
    bound = declarations.where("kind = 'import'")
    words = near.where("kind = 'word' and not coalesce(p1 in ('.', '?.'), false) and not (n1 = ':' and coalesce(p1 in ('{', ','), false))")
    words = words.join(bound.select(*KEY, F.col("name").alias("text")).distinct(), [*KEY, "text"], "left_semi").select(*KEY, F.col("at").alias("use"), F.col("text").alias("name"), "at", "line")
    used = visible_declarations(words, declarations, KEY).join(bound.select(*KEY, "decl", "spec", "source", F.col("at").alias("site")), [*KEY, "decl"]).where("use <> site")
    used = used.join(words.select(*KEY, "use", "name", "line"), [*KEY, "use"]).join(targets.withColumnRenamed("to_file", "end_file"), [*KEY, "decl"], "left").join(reached, [*KEY, "spec"], "left")
    kinds = declarations.select("tree", F.col("decl").alias("to_decl"), F.col("kind").isin("interface", "type").alias("is_type"))
    used = used.join(kinds, ["tree", "to_decl"], "left")
    external = F.col("to_file").isNull() & ~F.col("spec").startswith(".")
    used = used.where(external | F.col("end_file").isNotNull() | (F.col("source") == "*") & F.col("to_file").isNotNull())
    shown = used.select(*KEY, "use", "line", "name", external.alias("external"), F.coalesce("end_file", "to_file").alias("in_file"), F.when(external, F.regexp_extract("spec", "^((?:@[^/]+/)?[^/]+)", 1)).alias("package"), F.when(external, True).otherwise(F.coalesce("is_type", F.lit(False))).alias("type_only"))
    spans = functions.select(*KEY, F.col("fn").alias("from_fn"), "first", "last")
    inside = containing(shown, spans, KEY, "use", "first", "last")
    called = sites.where("receiver is null").select(*KEY, "use").unionByName(sites.where("receiver is not null and receiver <> ''").select(*KEY, (F.col("use") - 2).alias("use")))
    calls = inside.where("external").join(called, [*KEY, "use"], "left_semi")
    columns = ["tree", "from_fn", "name", "line", F.col("in_file").alias("file"), "package", "external"]
    return inside.select(*columns, F.lit("reference").alias("kind"), "type_only").unionByName(calls.select(*columns, F.lit("call").alias("kind"), F.lit(False).alias("type_only")))


def _functions_of(values: DataFrame, near: DataFrame, declarations: DataFrame, functions: DataFrame, resolve) -> DataFrame:
    """values(tree, file, id, at) to (.., id, fn): the function that an expression which starts at a token is, itself or by name.

    Round brackets around a function are looked through. fn is null for anything else.
    """
    own = functions.select(*KEY, "fn", F.col("first").alias("at"))
    begins = own.unionByName(functions.where("is_async").select(*KEY, "fn", (F.col("first") - 1).alias("at")))
    begins = begins.unionByName(begins.join(near.where("text = '(' and pair is not null").select(*KEY, (F.col("at") + 1).alias("at")), [*KEY, "at"], "left_semi").select(*KEY, "fn", (F.col("at") - 1).alias("at")))
    begins = begins.groupBy(*KEY, "at").agg(F.max_by("fn", F.split("fn", "#")[1].cast("int") * -1).alias("literal"))
    words = near.where("kind = 'word' and n1 in (',', ')', ']')").select(*KEY, "at", "text")
    named = resolve(values.join(words, [*KEY, "at"]).select(*KEY, F.col("id").alias("use"), F.col("text").alias("name"), "at"))
    by_name = named.join(declarations.select("tree", "decl", F.col("fn").alias("named")), ["tree", "decl"]).where("named is not null and at_file = file").groupBy(*KEY, F.col("use").alias("id")).agg(F.min("named").alias("named"))
    return values.join(begins, [*KEY, "at"], "left").join(by_name, [*KEY, "id"], "left").select(*values.columns, F.coalesce("literal", "named").alias("fn"))


def _arrays(near, brackets, declarations, functions, resolve) -> DataFrame:
    """(tree, file, array, fn, complete) of const arrays that begin with a literal; array is the declaration's token."""
    listed = declarations.where("kind = 'variable' and fixed and value is not null").select(*KEY, F.col("at").alias("array"), "decl", "name", F.col("value").alias("open"))
    listed = listed.join(brackets.where("bracket = '['").select(*KEY, "open"), [*KEY, "open"])
    mentions = near.where("kind = 'word' and not coalesce(p1 in ('.', '?.'), false)").join(listed.select(*KEY, F.col("name").alias("text")).distinct(), [*KEY, "text"], "left_semi")
    found = resolve(mentions.select(*KEY, F.col("at").alias("use"), F.col("text").alias("name"), "at")).join(listed.select(*KEY, "decl", "array"), [*KEY, "decl"]).where("use <> array")
    uses = found.select(*KEY, "array", F.col("use").alias("at")).join(near.select(*KEY, "at", "p1", "n1", "n2", "n3"), [*KEY, "at"])
    member = F.col("n1").isin(".", "?.")
    writes = member & F.col("n2").isin(*WRITERS) & (F.col("n3") == "(")
    known = writes | (member & F.col("n2").isin(*READERS)) | ((F.col("p1") == "of") & (F.col("n1") == ")"))
    written = uses.where(writes).select(*KEY, "array", (F.col("at") + 3).alias("around"))
    inner = near.where("p1 in ('(', '[', ',') and around is not null and text not in (')', ']')").select(*KEY, "around", "at", "text")
    added = written.join(inner, [*KEY, "around"])
    first = listed.select(*KEY, "array", F.col("open").alias("around")).join(inner, [*KEY, "around"])
    spread = added.where("text = '...'").select(*KEY, "array", F.lit(False).alias("known"))
    values = first.unionByName(added.where("text <> '...'")).select(*KEY, F.col("at").alias("id"), "at", "array")
    elements = _functions_of(values, near, declarations, functions, resolve)
    return held_closures(listed, uses.select(*KEY, "array", known.alias("known")).unionByName(spread), elements, KEY)


def _element_calls(chosen, declarations, near, functions, resolve) -> DataFrame:
    """(tree, file, call, array): calls of the first parameter of a callback that an array's method hands its elements to."""
    first = declarations.where("kind = 'parameter' and first_place").select(*KEY, "decl", F.col("from").alias("first"))
    calls = chosen.where(F.col("outcome") == FUNCTION_TYPE).select(*KEY, "call", "decl").join(first, [*KEY, "decl"])
    begins = functions.select(*KEY, "first", (F.col("first") - F.col("is_async").cast("int")).alias("at"))
    given = begins.join(near.select(*KEY, "at", "p1", "p2", "p3", "p4"), [*KEY, "at"]).where((F.col("p1") == "(") & F.col("p2").isin(*ELEMENT_FIRST) & F.col("p3").isin(".", "?."))
    sources = resolve(given.select(*KEY, F.col("first").alias("use"), F.col("p4").alias("name"), (F.col("at") - 4).alias("at"))).where("at_file = file")
    named = declarations.select(*KEY, "decl", F.col("at").alias("array"))
    return calls.join(sources.join(named, [*KEY, "decl"]).select(*KEY, F.col("use").alias("first"), "array"), [*KEY, "first"]).select(*KEY, "call", "array")
