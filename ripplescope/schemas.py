"""Fact tables that a language adapter writes. tree is 'base' or 'head' and the partition column on disk."""

TABLES = {
    "files": "tree string, file string, is_js boolean, is_barrel boolean, text string",
    "imports": "tree string, from_file string, stmt_no int, name string, spec string, type_only boolean, line int, to_file string",
    "reexports": "tree string, from_file string, stmt_no int, pos int, spec string, star boolean, exported string, source string, type_only boolean, to_file string",
    "exports": "tree string, file string, name string, line int, type_only boolean",
    "workspace": "tree string, pkg string, dir string",
    "functions": "tree string, fn_id string, file string, start int, end int, name string, kind string, own int, inline int, exported boolean, is_async boolean, unit_id string",
    "calls": "tree string, from_fn string, call_no int, to_fn string, line int, text string, via string",
    "call_stops": "tree string, from_fn string, call_no int, reason string, decl_file string, line int, text string",
    "decl_seeds": "tree string, file string, name string, fn_id string",
    "matches": "tree string, category string, file string, line int, end_line int",
    "provided": "tree string, provider string, file string, line int, name string",
    "coverage_lines": "tree string, file string, line int, hits long",
    "change_set": "path string, status string, renamed_from string",
}


def empty(spark, table: str):
    return spark.createDataFrame([], TABLES[table])
