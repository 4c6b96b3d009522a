"""Identity facts of symbols: by hand, and of a program."""

from ripplescope.operators import modules, symbol
from ripplescope.sources import lexical, program


def test_identities(spark):
    held = [
        ("f", "a", "f@1", "function", 3, False, None, None), ("f", "a", "f@0", "function", 3, True, None, True), ("f", "a", "f@9", "interface", 1, None, None, None),
        ("f", "b", "f@2", "variable", 7, None, True, None), ("f", "b", "f@3", "type", 8, None, None, None), ("f", "c", "f@4", "variable", 9, None, None, True),
        ("f", None, "f@5", "type", 1, True, None, None), (None, "a", "f@6", "type", 1, True, None, None), ("f", "d", None, "type", 1, True, None, None), ("f", "e", "f@7", None, None, None, None, None),
    ]
    declared = spark.createDataFrame(held + held[:3], "file string, symbol string, decl string, kind string, line int, exported boolean, is_default boolean, given boolean")
    seeds = spark.createDataFrame([("f", "a", "x"), ("f", "a", "x"), ("f", "a", "y"), ("g", "a", "z"), ("f", "b", None), (None, "c", "x")], "file string, symbol string, fn_id string")
    want = {("f", "a", "interface", 1, True, False, False, 3, 2), ("f", "b", "variable", 7, False, True, True, 2, 0), ("f", "c", "variable", 9, False, False, False, 1, 0), ("f", "e", None, None, False, False, False, 1, 0)}
    assert {tuple(r) for r in symbol.identities(declared, seeds, ["file"]).collect()} == want
    assert symbol.identities(declared.where("false"), seeds, ["file"]).count() == 0


TEXT = """export function over(a: string): void
export function over(a: number): void
export function over(a) { return a }
export interface Both { x: number }
const Both = 1;
type Alone = string;
let later;
export default class Thing { one() {} two() {} }
export function shown(a: string):
  Map<string, number> |
  string
export function shown(a):
  a is
  string { return true }
"""


def test_identities_of_a_program(spark):
    files = spark.createDataFrame([("t", "a.ts", TEXT), ("t", "b.ts", None)], "tree string, file string, text string")
    tables = [modules.resolve_imports(t(files), files, spark.createDataFrame([], "tree string, pkg string, dir string")) for t in (lexical.imports, lexical.reexports)]
    exports = lexical.exports(files)
    made = program.scan_program(files, *tables, exports)
    got = {r.symbol: (r.kind, r.line, r.exported, r.default_export, r.type_only, r.overloads, r.seeds) for r in program.symbol_identities(made, exports).collect()}
    assert got == {
        "over": ("function", 1, True, False, False, 3, 1), "Both": ("interface", 4, True, False, False, 2, 0), "Alone": ("type", 6, False, False, True, 1, 0),
        "shown": ("function", 9, True, False, False, 2, 1), "later": ("variable", 7, False, False, True, 1, 0), "Thing": ("class", 8, True, True, False, 1, 2),
    }
    # an overload without a body or a semicolon does not reach into the function after it
    assert {(r.name, r.start, r.end) for r in made.functions.collect()} == {("over", 3, 3), ("one", 8, 8), ("two", 8, 8), ("shown", 12, 14)}
