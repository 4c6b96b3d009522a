from pyspark.sql import functions as F

from ripplescope.config import EXTENSIONS, load_config
from ripplescope.functions import paths, text


def values(spark, column, data):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_normalise_and_join(spark):
    assert values(spark, paths.normalise, ["a/./b/../c", "../x", "a/../../b", "", "a//b"]) == ["a/c", "../x", "../b", ".", "a/b"]
    assert values(spark, lambda c: paths.join(F.lit("a/b"), c), ["../x", "./y", "../../../z"]) == ["a/x", "a/b/y", "../z"]


def test_dirname_extension(spark):
    assert values(spark, paths.dirname, ["a/b/c.ts", "c.ts"]) == ["a/b", "."]
    assert values(spark, paths.extension, ["a/b.d.ts", "a.b/c", ".hidden"]) == [".ts", "", ""]


def test_deepest_module_wins(spark):
    patterns = ("apps/*", "apps/*/server/*")
    got = values(spark, lambda c: paths.module_of(c, patterns), ["apps/x/server/y/z/f.ts", "apps/x/f.ts", "lib/f.ts", "f.ts"])
    assert got == ["apps/x/server/y", "apps/x", None, None]


def test_glob_star_is_one_segment(spark):
    assert values(spark, lambda c: paths.matches_any(c, ("a/*/c",)), ["a/b/c", "a/b/b/c", "a/c"]) == [True, False, False]


def test_test_files(spark):
    marks = (".spec.ts", "/tests/")
    assert values(spark, lambda c: paths.is_test_file(c, marks), ["a/b.spec.ts", "a/tests/b.ts", "a/b.ts", "a/b.spec.tsx"]) == [True, True, False, False]


def test_source_candidates_order(spark):
    got = values(spark, paths.source_candidates, ["a/b.js"])[0]
    assert got[:2] == ["a/b.ts", "a/b.tsx"] and got[6] == "a/b.js/index.ts" and len(got) == 18


def test_source_stems_with_each_extension_are_the_candidates(spark):
    bases = ["a/b", "a/b.js", "a/.js", ".", ".js", "a/..js", "a/...js", "a.b/c.d"]
    for base, stems, named in zip(bases, values(spark, paths.source_stems, bases), values(spark, paths.source_candidates, bases)):
        assert [s + e for s in stems for e in EXTENSIONS] == named, base


def test_paths_without_special_segments_stay(spark):
    assert values(spark, paths.normalise, [None, "...", "a/.b/..c/d.", "a/", "/a", "a/.", "a/..", "..", "a\n/b"]) == [None, "...", "a/.b/..c/d.", "a", "a", "a", ".", "..", "a\n/b"]


def test_dist_to_source(spark):
    got = values(spark, paths.dist_to_source, ["p/dist/x/y.d.ts", "p/src/x.ts"])
    assert got[0][:2] == ["p/src/x/y.ts", "p/src/x/y/index.ts"] and got[1] == ["p/src/x.ts"]
    assert values(spark, paths.external_package, ["node_modules/a/node_modules/@s/b/i.js", "src/x.ts"]) == ["@s/b", None]


def test_rounding_is_half_up_in_doubles(spark):
    df = spark.range(1).select(text.half_up(F.lit(0.285)), text.half_up(F.lit(0.125)), text.confidence(F.lit(1.0), F.lit(1.0)))
    assert tuple(df.first()) == (0.28, 0.13, 0.3)


def test_text_views(spark):
    assert values(spark, lambda c: text.pad(c, 6), ["abc", "abcdef", "abcdefgh"]) == ["abc   ", "abcd ", "abcd "]
    assert values(spark, lambda c: text.one_line(c, 5), [" a \n b  cde"]) == ["a b c"]
    df = spark.createDataFrame([(1,), (-2,), (0,), (None,)], "v int")
    assert [r[0] for r in df.select(text.signed(F.col("v"))).collect()] == ["+1", "-2", "0", "  ?"]
    df = spark.createDataFrame([(0.125,), (None,)], "v double")
    assert [r[0] for r in df.select(text.percent(F.col("v"))).collect()] == ["13%", "unknown"]


def test_config_overrides_by_key():
    c = load_config('{"modules": ["m/*"], "reexportDepth": 2, "providers": [{"name": "r", "pattern": "x(y)", "nameVar": "P"}], "other": 1}')
    assert c.modules == ("m/*",) and c.reexport_depth == 2 and c.providers[0].name == "r" and "dist" in c.exclude


def test_names_in_locale_order(spark):
    names = ["b", "B", "a", "É", "e", "é", "_z", "e1", "f", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    assert [r[0] for r in df.orderBy(text.locale_order(F.col("v"))).collect()] == [None, "", "_z", "a", "b", "B", "e", "é", "É", "e1", "f"]
