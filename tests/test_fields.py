"""Bindings of fields: the relation against brute force, and a program whose constructions are known."""

import random

from ripplescope.operators import fields, modules
from ripplescope.sources import lexical, program

from .conftest import rows


def brute(slots, sites, given):
    """Outcomes of every slot by a search of its own."""
    out = {}
    for cls, field, _ in slots:
        seen, frontier, hops = {(cls, field)}, {(cls, field)}, 0
        while frontier:
            ahead = set()
            for at in frontier:
                for site, _, form in [s for s in sites if s[1] == at[0]]:
                    for prop in [p for c, f, p in slots if (c, f) == at]:
                        hit = [g for g in given if g[:2] == (site, prop)]
                        outcome = "no-argument" if form == "none" else "not-literal" if form != "object" else "no-property" if not hit else None
                        for _, _, type_, c, f in hit if outcome is None else [(0, 0, None, None, None)]:
                            if outcome is None and any(s[:2] == (c, f) for s in slots):
                                ahead.add((c, f))
                            else:
                                key = (cls, field, site, prop, outcome or ("unknown" if type_ is None else "bound"), type_)
                                out[key] = min(out.get(key, hops), hops)
            frontier, hops = ahead - seen, hops + 1
            seen |= ahead
    return [(*k, v) for k, v in out.items()]


SCHEMAS = ("cls string, field string, property string", "site int, cls string, form string", "site int, property string, type string, from_cls string, from_field string")


def test_bindings_equal_brute_force(spark):
    for seed in (3, 4):
        rnd = random.Random(seed)
        slots = [(c, f, rnd.choice("pqr")) for c in "ABCDEFG" for f in "xyz" if rnd.random() < 0.85]
        sites = [(i, rnd.choice("ABCDEFGH"), rnd.choice(["object"] * 5 + ["none", "other"])) for i in range(25)]
        given = [(s, p, *((rnd.choice(("T", "U", None)), None, None) if rnd.random() < 0.4 else (None, rnd.choice("ABCDEFGH"), rnd.choice("xyz")))) for s, _, form in sites if form == "object" for p in "pqr" if rnd.random() < 0.8]
        tables = [spark.createDataFrame(t, s) for t, s in zip((slots + slots[:2], sites + [(None, "A", "object")], given + given[:3]), SCHEMAS)]
        want = brute(slots, sites, given)
        assert {w[4] for w in want} == {"bound", "unknown", "no-property", "not-literal", "no-argument"} and max(w[6] for w in want) > 1
        got = fields.bind_fields(*tables).select("cls", "field", "site", "property", "outcome", "type", "hops")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert fields.bind_fields(tables[0].where("false"), *tables[1:]).count() == fields.bind_fields(tables[0], tables[1].where("false"), tables[2]).count() == 0


MANAGER = """import { Store } from './store';
export class Manager {
  private storage: Store; private logs; private count; private late;
  constructor({ sourceStorage, logStorage, n }: Deps) {
    this.storage = early;
    this.storage = sourceStorage;
    this.logs = logStorage
    if (n) { this.count = n }
    this.late = n.value;
  }
  reset() { this.storage = other; }
}
export class Outer {
  inner; store;
  constructor({ given }) { this.store = given; this.inner = new Manager({ sourceStorage: this.store, n: 1 }); }
}
"""
USE = """import { Manager, Outer } from './manager';
import { RealStore } from './store';
const real: RealStore = make();
new Manager({ sourceStorage: new RealStore(1), logStorage: real });
const logStorage = new RealStore();
export const m = new Manager({ logStorage, n: 'x', sourceStorage: make() }), e = new Manager(), o = new Manager(options);
function f() { class Manager { } return new Manager({ sourceStorage: real }) }
new Outer({ given: real });
"""
STORE = "export abstract class Store { }\nexport class RealStore extends Store { }\n"


def test_bindings_of_a_program(spark):
    files = spark.createDataFrame([("t", "manager.ts", MANAGER), ("t", "use.ts", USE), ("t", "store.ts", STORE), ("t", "none.ts", None)], "tree string, file string, text string")
    tables = [modules.resolve_imports(t(files), files, spark.createDataFrame([], "tree string, pkg string, dir string")) for t in (lexical.imports, lexical.reexports)]
    made = program.scan_program(files, *tables, lexical.exports(files))
    got = {(r["class"], r.field, r.file, r.line, r.outcome, r.type, r.hops) for r in program.field_bindings(made).collect()}
    manager = lambda field, *found: {("Manager", field, *f) for f in found}
    empty = [("use.ts", 6, "no-argument", None, 0), ("use.ts", 6, "not-literal", None, 0)]
    assert got == (
        manager("storage", ("use.ts", 4, "bound", "RealStore", 0), ("use.ts", 6, "unknown", None, 0), ("use.ts", 8, "bound", "RealStore", 1), *empty)
        | manager("logs", ("use.ts", 4, "bound", "RealStore", 0), ("use.ts", 6, "bound", "RealStore", 0), ("manager.ts", 15, "no-property", None, 0), *empty)
        | manager("count", ("use.ts", 4, "no-property", None, 0), ("use.ts", 6, "bound", "string", 0), ("manager.ts", 15, "bound", "number", 0), *empty)
        | {("Outer", "store", "use.ts", 8, "bound", "RealStore", 0)}
    )
    assert rows(made.slots.select("field", "property")) == [("count", "n"), ("logs", "logStorage"), ("storage", "sourceStorage"), ("store", "given")]
