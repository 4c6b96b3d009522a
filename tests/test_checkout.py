"""From two folders of sources to the report."""

from ripplescope.config import Config
from ripplescope.plans.checkout import checkout_tables
from ripplescope.plans.report import build_report

from .conftest import rows

FILES = {
    "m/a/index.ts": "import { help } from '@s/lib';\nimport { Queue } from './queue';\nexport function run(x) { if (x) help(x); const q = new Queue(); return q.push(x) }\nexport const idle = () => 1;\n",
    "m/a/queue.ts": "export class Queue { push(x) { return x ? [x] : [] } }\n",
    "m/b/index.ts": "import { run } from '../a';\nexport function go(cb) { run(1); cb(); }\n",
    "packages/lib/package.json": '{"name": "@s/lib"}',
    "packages/lib/src/index.ts": "export function help(x) { return x && fetch(x) }\n",
}
HEAD = {"m/a/queue.ts": "export class Queue { push(x) { const all = [() => x, () => step(x)]; all.forEach((f) => f()); return x ? (x || 1) : 2 } }\nfunction step(x) { while (x) { x-- } }\n"}


def test_two_checkouts_to_the_report(spark, tmp_path):
    roots = {}
    for tree, files in (("base", FILES), ("head", FILES | HEAD)):
        roots[tree] = str(tmp_path / tree)
        for name, text in files.items():
            path = tmp_path / tree / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    (tmp_path / "head.info").write_text(f"SF:{tmp_path}/head/m/a/index.ts\nDA:3,2\nDA:4,0\nend_of_record\n")
    changes = spark.createDataFrame([("M\tm/a/queue.ts",)], "value string")
    tables = checkout_tables(spark, roots, changes, Config(modules=("m/*", "packages/*")), {"head": str(tmp_path / "head.info")})
    report = build_report(tables, Config(modules=("m/*", "packages/*")))
    symbols = {r["name"]: r for r in report.symbols.collect()}
    # run 2 and push 2, then push 3 and step 2; the array's closures are counted in push
    assert (symbols["run"].status, symbols["run"].complexity_base, symbols["run"].complexity_head, symbols["run"].complexity_delta) == ("changed", 4, 7, 3)
    assert symbols["idle"].status == "same" and symbols["idle"].complexity_head == 1
    assert rows(report.dependents_of_touched) == [("m/b",)]
    facts = {(r.tree, r["name"]): r for r in report.facts.symbols.where("module = 'm/a'").collect()}
    assert facts["head", "run"].stops == [] and facts["head", "run"].used_by == ["m/b"] and facts["head", "run"].coverage == 1.0
    stops = {(r.tree, r.text, r.reason) for r in tables["call_stops"].collect()}
    assert stops == {("base", "cb", "function-type"), ("head", "cb", "function-type")}
    assert rows(report.model.direct_deps.where("tree = 'head'").select("src", "dst")) == [("m/a", "packages/lib"), ("m/b", "m/a")]
