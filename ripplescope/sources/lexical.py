"""A lexical adapter for imports, re-exports and exports of TypeScript and JavaScript texts.

It reads the usual statement forms with regular expressions, in the JVM. It does not type-check, does not see through comments
or strings, and writes no functions or calls: those tables need a parser's adapter. Names are rows: a side-effect import has a
null name, a default import is 'default', a namespace import '*'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_IMPORT = r"""(?m)^[ \t]*import\s+(type\s+)?(?:([\w$*][^'";]*?|\{[^}]*\}[^'";]*?)\s+from\s+)?['"]([^'"\n]+)['"]"""
_REEXPORT = r"""(?m)^[ \t]*export\s+(type\s+)?(\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s+['"]([^'"\n]+)['"]"""
_EXPORT = r"""(?m)^[ \t]*export\s+(default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|const|let|var|enum|const\s+enum|interface|type|namespace)\s+([\w$]+)"""
_LIST = r"""(?m)^[ \t]*export\s+(type\s+)?\{([^}]*)\}\s*;?[ \t]*(?://.*)?$"""


def _statements(files: DataFrame, pattern: str, groups: int) -> DataFrame:
    """(tree, file, stmt_no, g1.., line) of a pattern's matches, in order."""
    arrays = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i)) for i in range(1, groups + 1)]
    before = F.transform(F.split("text", pattern, -1), lambda s: F.size(F.split(s, "\n")) - 1)
    inside = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda s: F.size(F.split(s, "\n")) - 1)
    zipped = F.arrays_zip(*[a.alias(f"g{i + 1}") for i, a in enumerate(arrays)])
    rows = files.select("tree", "file", before.alias("b"), inside.alias("n"), F.posexplode(zipped).alias("stmt_no", "x"))
    total = lambda name, to: F.aggregate(F.slice(name, F.lit(1), to), F.lit(0), lambda a, v: a + v)
    line = total("b", F.col("stmt_no") + 1) + total("n", F.col("stmt_no")) + 1
    return rows.select("tree", "file", "stmt_no", "x.*", line.cast("int").alias("line"))


def _names(text):
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"[{}]", ""), ","), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def imports(files: DataFrame) -> DataFrame:
    rows = _statements(files, _IMPORT, 3)
    braces = F.regexp_extract("g2", r"\{([^}]*)\}", 1)
    outside = F.trim(F.regexp_replace(F.regexp_replace("g2", r"\{[^}]*\}", ""), r"^[\s,]+|[\s,]+$", ""))
    listed = F.transform(_names(braces), lambda s: F.regexp_extract(F.regexp_replace(s, r"^type\s+", ""), r"^([\w$]+)", 1))
    default = F.when(outside.rlike(r"^[\w$]+"), F.array(F.lit("default"))).otherwise(F.array())
    star = F.when(outside.rlike(r"\*\s+as\s"), F.array(F.lit("*"))).otherwise(F.array())
    names = F.concat(default.cast("array<string>"), star.cast("array<string>"), listed)
    return rows.select("tree", F.col("file").alias("from_file"), "stmt_no", F.explode_outer(names).alias("name"), F.col("g3").alias("spec"), (F.col("g1") != "").alias("type_only"), "line", F.lit(None).cast("string").alias("to_file"))


def reexports(files: DataFrame) -> DataFrame:
    rows = _statements(files, _REEXPORT, 3)
    pair = lambda s: F.struct(F.regexp_extract(s, r"^(?:type\s+)?([\w$]+)", 1).alias("source"), F.regexp_extract(s, r"([\w$]+)$", 1).alias("exported"))
    star = F.col("g2") == "*"
    listed = F.when(star | F.col("g2").startswith("*"), F.array()).otherwise(F.transform(_names(F.col("g2")), pair))
    base = ["tree", F.col("file").alias("from_file"), "stmt_no"]
    rest = [F.col("g3").alias("spec"), star.alias("star"), "x.exported", "x.source", (F.col("g1") != "").alias("type_only"), F.lit(None).cast("string").alias("to_file")]
    typed = listed.cast("array<struct<source:string,exported:string>>")
    return rows.select(*base, "g1", "g2", "g3", F.posexplode_outer(typed).alias("pos", "x")).select("tree", "from_file", "stmt_no", "pos", *rest)


def exports(files: DataFrame) -> DataFrame:
    own = _statements(files, _EXPORT, 3)
    own = own.select("tree", "file", F.when(F.col("g1") != "", "default").otherwise(F.col("g3")).alias("name"), "line", F.col("g2").isin("interface", "type").alias("type_only"))
    lists = _statements(files, _LIST, 2)
    lists = lists.select("tree", "file", F.explode(_names(F.col("g2"))).alias("name"), "line", (F.col("g1") != "").alias("type_only"))
    return own.unionByName(lists.withColumn("name", F.regexp_extract("name", r"([\w$]+)$", 1)))
