"""Path expressions; paths are relative to the tree's root and use '/'."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EXTENSIONS


def dirname(path: Column) -> Column:
    """The parent directory; '.' for a bare name."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), cut).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1)


def normalise(path: Column) -> Column:
    """Without '.', empty and resolvable '..' segments; '.' if nothing is left. A leading '..' stays.

    Only a path that has such a segment is taken apart: the steps are interpreted, and cost more than all else of a candidate.
    """

    def step(done: Column, segment: Column) -> Column:
        back = (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != "..")
        return F.when(segment.isin("", "."), done).when((segment == "..") & back, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(segment)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    special = path.rlike(r"(^|/)\.{0,2}(/|\z)")
    return F.when(special, F.when(joined == "", ".").otherwise(joined)).otherwise(path)


def join(directory: Column, rest: Column) -> Column:
    return normalise(F.concat_ws("/", directory, rest))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, shortest first."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a pattern whose * is one whole segment."""
    special = set(r"\.^$|?+()[]{}")
    plain = lambda s: "".join(f"\\{c}" if c in special or c == "*" else c for c in s)
    return "^" + "/".join("[^/]*" if s == "*" else plain(s) for s in pattern.split("/")) + "$"


def matches_any(directory: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | directory.rlike(glob_regex(pattern))
    return hit


def module_of(path: Column, patterns: Sequence[str]) -> Column:
    """The deepest ancestor directory that a pattern selects, else null. Stays inside the projection: no join, no shuffle."""
    found = F.filter(ancestors(dirname(path)), lambda d: matches_any(d, patterns))
    return F.try_element_at(found, F.lit(-1))


def is_test_file(path: Column, marks: Sequence[str]) -> Column:
    """A mark that starts with '.' is a suffix, any other a substring."""
    hit = F.lit(False)
    for mark in marks:
        hit = hit | (path.endswith(mark) if mark.startswith(".") else path.contains(mark))
    return hit


def stem(path: Column) -> Column:
    """Without .js, .jsx, .mjs or .cjs at the end."""
    return F.regexp_replace(path, r"\.(js|jsx|mjs|cjs)$", "")


def source_candidates(base: Column) -> Column:
    """Files that a specifier's base may mean, best first."""
    index = [F.concat(base, F.lit(f"/index{e}")) for e in EXTENSIONS]
    nested = [F.concat(base, F.lit(f"/src/index{e}")) for e in EXTENSIONS]
    return F.transform(F.array(*[F.concat(stem(base), F.lit(e)) for e in EXTENSIONS], *index, *nested), normalise)


def source_stems(base: Column) -> Column:
    """What source_candidates of a normalised base are before their extensions, best first: the six of one stem differ in these only."""
    inside = F.when(base == ".", "").otherwise(F.concat(base, F.lit("/")))
    return F.array(stem(base), F.concat(inside, F.lit("index")), F.concat(inside, F.lit("src/index")))


def package_root(specifier: Column) -> Column:
    """@scope/name or the first segment."""
    return F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def relative_to(root: str, path: Column) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), path.substr(F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def dist_to_source(path: Column) -> Column:
    """Candidates, best first, for the source of a built file <dir>/dist/<rest>; the path itself if it is not built."""
    head, tail = F.regexp_extract(path, r"^(.*?)/dist/(.+)$", 1), F.regexp_extract(path, r"^(.*?)/dist/(.+)$", 2)
    bare = F.regexp_replace(F.regexp_replace(tail, r"\.d\.ts$", ""), r"\.js$", "")
    built = [F.concat(head, F.lit("/src/"), bare, F.lit(s)) for e in (".ts", ".tsx", ".js") for s in (e, f"/index{e}")]
    return F.when(path.rlike(r"^.*?/dist/.+$"), F.array(*built)).otherwise(F.array(path))


def last_module_path(path: Column) -> Column:
    """What follows the last node_modules/ segment, or the path."""
    return F.element_at(F.split(path, "(?:^|/)node_modules/"), -1)


def external_package(path: Column) -> Column:
    """Package of a path under node_modules, else null."""
    return F.when(path.contains("node_modules/"), package_root(last_module_path(path)))
