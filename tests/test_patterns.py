"""Structural patterns: on code whose matches are known, and on generated token rows against brute force."""

import random

import pytest

from ripplescope.config import Config, Provider
from ripplescope.sources import patterns, trees
from ripplescope.sources.patterns import Pattern, compile_pattern, match_sequences, structural_matches

from .conftest import rows

CODE = {
    "a.ts": """import fs from 'fs';
export async function one(x) {
  await Models
    .Users
    .insert(
      x,
    );
  this.fetch(1); fetch /* why */ (x); // fetch(2)
  const t = 'fetch(3)';
  return a.b(1)
    .c[2]
    .insertOne({ x });
}
function fetch(y) { return new axios(y) }
class K { got(a) { return process.env.HOME } }
""",
    "m/r.ts": "API.v1.addRoute(\n  'a.b',\n  { x: [1, 2] },\n  {}\n);\nAPI.v1.addRoute(name + 'x', {});\nAPI.v1.addRoute(`c`, {});\nAPI.v1.addRoute('lonely');\n",
    "n/r.ts": "API.v1.addRoute('elsewhere', {});\nAPI.v1.addRoute((a, b), { get() { fs.promises.readFile(() => { fs.stat(x) }) } });\n",
    "empty.ts": "",
    "null.ts": None,
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("head", f, t) for f, t in CODE.items()], "tree string, file string, text string")


def test_effects_over_lines(files):
    found = trees.effect_matches(files)
    assert rows(found.select("category", "file", "line", "end_line")) == [
        ("db", "a.ts", 10, 12), ("db", "a.ts", 3, 7), ("fs", "n/r.ts", 2, 2), ("network", "a.ts", 8, 8), ("process", "a.ts", 15, 15),
    ]
    both = trees.effect_matches(files, Config(effects={"n": ("fetch($$$)",)}, effect_lines={"w": ("why",), "n": ("why",)}))
    assert rows(both.select("category", "file", "line")) == [("n", "a.ts", 8), ("w", "a.ts", 8)]
    assert trees.effect_matches(files, Config(effects={})).count() == trees.effect_matches(files.where("false")).count() == 0


def test_providers_by_pattern_and_by_line(files):
    one = Provider("r", "API.v1.addRoute($PATH, $$$ARGS)", ("m",), "PATH")
    assert rows(trees.provided_symbols(files, Config(providers=(one,))).select("file", "line", "name")) == [("m/r.ts", 1, "a.b"), ("m/r.ts", 7, "c")]
    two = Provider("s", r"addRoute\('([^']+)'")
    both = trees.provided_symbols(files, Config(providers=(one, two))).select("provider", "file", "name")
    assert rows(both) == [("r", "m/r.ts", "a.b"), ("r", "m/r.ts", "c"), ("s", "m/r.ts", "lonely"), ("s", "n/r.ts", "elsewhere")]


def test_all_arguments_and_several(files):
    got = structural_matches(files, [Pattern("two", "API.v1.addRoute($A, $B)", "B"), Pattern("three", "API.v1.addRoute($A, $B, $C)"), Pattern("one", "API.v1.addRoute($A)", "A"), Pattern("any", "API.v1.$M($$$)", "M")])
    assert rows(got.where("key <> 'any'").select("key", "file", "line", "name")) == [
        ("one", "m/r.ts", 8, "lonely"), ("three", "m/r.ts", 1, None), ("two", "m/r.ts", 6, None), ("two", "m/r.ts", 7, None), ("two", "n/r.ts", 1, None), ("two", "n/r.ts", 2, None),
    ]
    assert rows(got.where("key = 'any'").select("name").distinct()) == [("addRoute",)] and got.where("key = 'any'").count() == 6


def test_patterns_that_cannot_be():
    for text in ("", "$A", "($$$)", "f($$$A, x)"):
        with pytest.raises(ValueError):
            compile_pattern(text)


def test_word_sequences_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = {f"f{i}": [rnd.choice("abcd") for _ in range(rnd.randrange(60))] for i in range(12)}
    data = [("t", f, i, "word", w, i + 1, None, None) for f, words in texts.items() for i, w in enumerate(words)]
    tokens = spark.createDataFrame(data, "tree string, file string, at int, kind string, text string, line int, pair int, around int")
    patterns = ["a b", "a $X b", "$X c $Y d", "b b b", "d"]
    want = []
    for n, pattern in enumerate(patterns):
        parts = [None if w.startswith("$") else w for w in pattern.split()]
        for f, words in texts.items():
            want += [(f, n, i, i + len(parts) - 1) for i in range(len(words) - len(parts) + 1) if all(p in (None, w) for p, w in zip(parts, words[i:]))]
    got = match_sequences(tokens, [Pattern("k", p) for p in patterns]).select("file", "pattern", "first", "last")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert match_sequences(tokens, []).count() == 0


def test_only_deciding_tokens_are_shuffled(spark, monkeypatch):
    """Words that no pattern names never leave their task; an unnamed word between literals is known by what bars it."""
    row = lambda file, words: [("t", file, i, kind, w, i + 1, None, None) for i, (kind, w) in enumerate(words)]
    word = lambda text: [("word", w) for w in text.split()]
    files = row("a", word("of the and x of y z and")) + row("b", [("word", "of"), ("mark", ";"), ("word", "and")]) + row("c", [("word", "of"), ("string", "x"), ("word", "and")]) + row("d", [("mark", "."), *word("of x and")]) + row("e", word("of x"))
    tokens = spark.createDataFrame(files, "tree string, file string, at int, kind string, text string, line int, pair int, around int")
    asked = []
    of = patterns._deciding
    monkeypatch.setattr(patterns, "_deciding", lambda steps: asked.append(of(steps)) or asked[-1])
    assert rows(match_sequences(tokens, [Pattern("k", "of $X and")]).select("file", "first", "last")) == [("a", 0, 2)]
    assert len(asked) == 1 and rows(tokens.where(asked[0]).select("text").distinct()) == [(".",), (";",), ("and",), ("of",), ("x",)]
    assert tokens.where(asked[0]).where("file = 'a'").count() == 4
    # a named word, and one at an end, is read itself
    assert rows(match_sequences(tokens, [Pattern("k", "of $X and", "X"), Pattern("k", "of $X")]).select("file", "pattern", "name")) == [("a", 0, "the"), ("a", 1, None), ("a", 1, None), ("e", 1, None)]
