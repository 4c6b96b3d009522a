"""Sinks of the two-snapshot report."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.report import Report

SYMBOLS, LISTED, DEPENDENTS = 6, 8, 20  # fixed values: rows that the text view shows

def percent(v: float | None) -> str:
    return "unknown" if v is None else f"{int(v * 100 + 0.5)}%"


def signed(v: float | None) -> str:
    return "  ?" if v is None else f"{v:+d}" if v else "0"


def write_json(modules: DataFrame, symbols: DataFrame, path: str) -> None:
    """One JSON object per module with its symbols nested; written by the executors."""
    nested = symbols.groupBy("module").agg(F.collect_list(F.struct(*[c for c in symbols.columns if c != "module"])).alias("symbols"))
    modules.join(nested, "module", "left").write.mode("overwrite").json(path)


def report_json(report: Report, refs: dict[str, str] | None = None) -> str:
    """The whole report as one indented document."""
    ordered = report.symbols.orderBy("module", F.abs(F.coalesce("complexity_delta", F.lit(0))).desc(), F.coalesce("complexity_head", F.lit(0)).desc(), "name")
    of: dict[str, list] = {}
    for r in ordered.collect():
        row = r.asDict(recursive=True)
        of.setdefault(row.pop("module"), []).append(row)
    modules = [r.asDict(recursive=True) for r in report.modules.orderBy("module").collect()]
    for m in modules:
        m["symbols"] = of.get(m["module"], [])
    return json.dumps(
        {
            **(refs or {}),
            "touched": [m["module"] for m in modules],
            "renamed": [r.asDict() for r in report.renamed.orderBy("from_module").collect()],
            "modules": modules,
            "dependentsOfTouched": [r.module for r in report.dependents_of_touched.orderBy("module").collect()],
        },
        indent=2,
        ensure_ascii=False,
    )


# The text view is a document of Markdown sections. Every table is a list of columns, each a heading and how a row fills it.

Column = tuple[str, Callable[[dict], str]]


def _trend(name: str) -> Callable[[dict], str]:
    """Head value and difference of a field that has both."""
    return lambda row: "unknown" if row[f"{name}_head"] is None else f"{row[f'{name}_head']} ({signed(row[f'{name}_delta']).strip()})"


def _effects(row: dict) -> str:
    new = {*row["effects_added"]}
    return ", ".join(f"**{e}**" if e in new else e for e in row["effects_head"])


MODULE_COLUMNS: tuple[Column, ...] = (
    ("module", lambda m: m["module"]),
    ("status", lambda m: m["status"] + (", types only" if m["type_only"] else "")),
    *[(title, _trend(name)) for title, name in (("files", "file_count"), ("surface", "boundary"), ("complexity", "total_complexity"), ("direct", "direct"), ("indirect", "indirect"))],
    ("confidence", lambda m: f"{m['confidence_head']:.2f}"),
)
SYMBOL_COLUMNS: tuple[Column, ...] = (
    ("symbol", lambda s: s["name"]),
    ("kind", lambda s: "type" if s.get("type_only") else "value"),
    ("status", lambda s: s["status"]),
    ("complexity", lambda s: ("at least " if s.get("stops") else "") + _trend("complexity")(s)),
    ("used by", _trend("used_by")),
    ("covered", lambda s: percent(s["coverage_head"])),
    ("effects, new ones bold", _effects),
)
#: Lists of a module: heading and field.
MODULE_LISTS = (("new direct dependencies", "direct_added"), ("dropped direct dependencies", "direct_removed"), ("new indirect dependencies", "indirect_added"), ("exports without an importer", "unused_exports"))


def markdown_table(columns: Sequence[Column], rows: Sequence[dict], limit: int) -> list[str]:
    body = [[fill(r).replace("|", "\\|") or "-" for _, fill in columns] for r in rows[:limit]]
    lines = ["| " + " | ".join(cells) + " |" for cells in ([title for title, _ in columns], ["---"] * len(columns), *body)]
    return [*lines, *_rest(rows, limit)]


def markdown_list(items: Sequence[str], limit: int) -> list[str]:
    return [*[f"- {x}" for x in items[:limit]], *_rest(items, limit)]


def _rest(items: Sequence, limit: int) -> list[str]:
    return ["", f"{len(items) - limit} more are in the JSON document."] if len(items) > limit else []


def module_detail(m: dict, symbols: int = SYMBOLS) -> dict[str, list[str]]:
    """Sections of one module by heading; empty ones are left out."""
    moved = [s for s in m["symbols"] if s["status"] != "same"]
    parts = {f"{len(moved)} symbols differ": markdown_table(SYMBOL_COLUMNS, moved, symbols) if moved else []}
    parts["where walks stopped, so that complexity is a least value"] = markdown_list([f"{r['reason']}: {r['count']}" for r in m.get("reasons") or []], LISTED)
    return {k: v for k, v in (parts | {f"{title}: {len(m[field])}": markdown_list(m[field], LISTED) for title, field in MODULE_LISTS}).items() if v}


def report_text(document: str, symbols: int = SYMBOLS) -> str:
    """The text view of report_json's document."""
    r = json.loads(document)
    sections = {"# Change impact": [f"- {side}: {r[side]}" for side in ("base", "head") if side in r]}
    sections["## Renamed modules, which count as removed and added"] = [f"- {x['from_module']} is now {x['to_module']}" for x in r["renamed"]]
    sections[f"## Touched modules: {len(r['modules'])}"] = markdown_table(MODULE_COLUMNS, r["modules"], len(r["modules"])) if r["modules"] else ["No changed file lies in a module of the configuration."]
    for m in r["modules"]:
        detail = module_detail(m, symbols)
        sections |= {f"## {m['module']}": [""]} if detail else {}
        sections |= {f"### {m['module']}: {title}": lines for title, lines in detail.items()}
    near = r["dependentsOfTouched"]
    sections[f"## Direct dependents of touched modules: {len(near)}"] = markdown_list(near, DEPENDENTS)
    return "\n".join(line for title, lines in sections.items() if lines or title.startswith("# ") for line in (title, "", *lines, "")).rstrip() + "\n"
