"""Complexity of functions by their tokens: generated programs whose counts the generator knows, and forms that are easy to misread."""

import random

import pytest

from ripplescope.sources.syntax import Source, function_table, tokenize

from .conftest import rows


def generated(rnd, depth):
    """A statement, what it adds to its function, and what the anonymous functions directly inside it add."""
    if depth == 0:
        return "step();", 0, 0
    inner, own, inline = generated(rnd, depth - 1)
    text, points = expression(rnd)
    form = rnd.randrange(12)
    if form == 0:
        return f"if ({text}) {{ {inner} }} else {{ other() }}", own + points + 1, inline
    if form == 1:
        return f"for (const i of {text}) {{ {inner} }}", own + points + 1, inline
    if form == 2:
        return f"while ({text}) {{ {inner} }}", own + points + 1, inline
    if form == 3:
        return f"do {{ {inner} }} while ({text});", own + points + 1, inline
    if form == 4:
        cases = rnd.randrange(4)
        return f"switch ({text}) {{ {' '.join(f'case {i}: {inner} break;' if i == 0 else f'case {i}:' for i in range(cases))} default: }}", (own if cases else 0) + points + cases, inline if cases else 0
    if form == 5:
        return f"try {{ {inner} }} catch (e) {{ note(e) }} finally {{ {text}; }}", own + points + 1, inline
    if form == 6:
        return f"function named{rnd.randrange(9)}(v) {{ {inner} return {text}; }}", 0, 0
    if form == 7:
        return f"call((v) => {{ {inner} return {text}; }});", 0, own + points + inline
    if form == 8:
        return f"const kept = (v) => {{ {inner} return {text} }};", 0, 0
    if form == 9:
        return f"target {rnd.choice(('&&=', '||=', '??=', '+='))} {text}; {inner}", own + points, inline
    if form == 10:
        return f"const m = /&&|if(x)/.test(`${{{text}}} case`); {inner} // while (x) ?\n", own + points, inline
    return f"const z: {{ a?: number; b?(): void }} = {text} as (A extends B ? C : D); {inner}", own + points, inline


def expression(rnd, depth=2):
    if depth == 0:
        return rnd.choice(("a", "b.c?.d?.()", "x?.[0]", "'a ? b : c'", "1")), 0
    (left, m), (right, n) = expression(rnd, depth - 1), expression(rnd, depth - 1)
    form = rnd.randrange(4)
    if form == 0:
        return f"({left} ? {right} : 0)", m + n + 1
    if form == 1:
        return f"({left} {rnd.choice(('&&', '||', '??'))} {right})", m + n + 1
    return f"f({left}, {right})", m + n


@pytest.mark.parametrize("seed", range(40))
def test_counts_of_generated_functions(seed):
    rnd = random.Random(seed)
    parts = [generated(rnd, rnd.randrange(4)) for _ in range(rnd.randrange(6))]
    default, points = expression(rnd)
    head = rnd.choice(("function go(p?: T, q = {}) {{ {} }}", "const go = async (p?: T, q = {}) => {{ {} }}", "class K {{ static async go(p?: T, q = {}): Promise<void> {{ {} }} }}"))
    counted(head.format(default, "\n".join(p[0] for p in parts)), 1 + points + sum(p[1] for p in parts), sum(p[2] for p in parts))


#: text, own and inline complexity of its first function
MISREAD = (
    ("function go() { call(function named(x) { if (x) {} }) }", 1, 1),
    ("function go(cb = () => a || b) {}", 1, 1),
    ("function go() { return `${a ? `${b || c}` : 'if (x)'}` /* && */ + /if ? x/.source }  // ||", 3, 0),
    ("async function go() { for await (const x of y) { p.catch((e) => e && log(e)) } }", 2, 1),
    ("function go(a) { if (a) /x&&y||z/.test(a) }", 2, 0),
    ("function go(a) { while (a) /x&&y/.exec(a); return (a) / b / c ? 1 : 2 }", 3, 0),
    ("function go(x: { foo?(): void }) {}", 1, 0),
    ("function go(x) { const y: T extends string ? 1 : 2 = x }", 1, 0),
    ("function go(x) { return x as (A extends B ? C : D extends E ? F : G) }", 1, 0),
    ("class K { [x]?(): void; b?(): void; private static c?(): void; go() { return a ? (b) : (c) } }", 2, 0),
    ("function go(a) { const x = { b: a ? (1) : 2 }; a ? (b) : (c) }", 3, 0),
)


@pytest.mark.parametrize("text, own, inline", MISREAD)
def test_counts_of_misread_forms(text, own, inline):
    counted(text, own, inline)


def counted(text, own, inline):
    fs = Source(text).functions

    def below(k):
        return sum(len(f.decisions) + below(j) for j, f in enumerate(fs) if f.parent == k and f.anonymous)

    assert (1 + len(fs[0].decisions), below(0)) == (own, inline), text


def test_names_and_exports_are_found_however_far_back():
    long = ", ".join(f"K{i}: V{i}" for i in range(200))
    text = f"export const one: {{ {long} }} = () => 1\nconst held: A<B> = [];\nconst two = () => 2\nexport default async function three<{', '.join(f'T{i}' for i in range(500))}>() {{ }}"
    assert [(f.name, f.exported) for f in Source(text).functions] == [("one", True), ("two", False), ("three", True)]


def test_types_hold_no_functions_and_names_come_from_what_they_are_given_to():
    text = """
interface I { run: (x: string) => void; stop?(): void }
type F = (a: A) => B | C
type G = A extends B ? C : D;
export const one = async (x: string): Promise<void> => {}
const two: (x: string) => void = (x) => x
class K<T> extends L { private three: () => void = () => {}; constructor() { super() } get four(): { a: T } { return a } five<U>(cb: (e: Error | null) => void): Map<string, { b: U }> { } }
const o = { six: (x) => x, 'seven'() {}, eight: function () {} }
o.nine = () => 1
export default function () {}
"""
    found = [(f.name, f.kind, f.anonymous) for f in Source(text).functions]
    assert found == [
        ("one", "arrow", False), ("two", "arrow", False), ("three", "arrow", False), ("constructor", "constructor", True), ("four", "accessor", True), ("five", "method", False),
        ("six", "arrow", False), ("seven", "method", False), ("eight", "expression", False), ("nine", "arrow", False), ("", "expression", True),
    ]
    assert Source(text).functions[0].is_async and Source(text).functions[0].exported


def test_broken_texts_end(spark):
    for text in ("", "`${", "function", "function (", "=>", "({[", "a ? b", "}}}", "class", "'", "/", "type A =", "interface B", "x => {", "f(", "/* "):
        Source(text)
        assert "".join(t.text for t in tokenize(text)) is not None
    files = spark.createDataFrame([("t", "a.ts", "function f(a) {\n  if (a) a.map((x) => x || 1)\n}\nconst g = () => 1"), ("t", "b.ts", None), ("t", "c.ts", "")], "tree string, file string, text string")
    assert rows(function_table(files), "file", "start", "end", "name", "kind", "own", "inline", "is_async") == [("a.ts", 1, 3, "f", "function", 2, 1, False), ("a.ts", 2, 2, "", "arrow", 2, 0, False), ("a.ts", 4, 4, "g", "arrow", 1, 0, False)]
    assert {(r.name, r.unit_id == r.fn_id) for r in function_table(files).collect()} == {("f", True), ("", False), ("g", True)}
    assert function_table(files.where("false")).count() == 0
