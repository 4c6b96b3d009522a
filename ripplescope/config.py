"""Configuration: which directories are modules, what counts as a test, an effect, a provider."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

# Module patterns, skipped directories, file kinds, test-file marks, effect patterns, limits and weights.
MODULE_PATTERNS = (
    "apps/meteor/server/*",
    "apps/meteor/server/services/*",
    "apps/meteor/client/*",
    "apps/meteor/app/*/*",
    "apps/meteor/ee/server/*",
    "packages/*/src",
    "packages/*/*/src",
    "ee/packages/*/src",
)
EXCLUDED = ("node_modules", "dist", "build", ".meteor", "coverage", "apps/meteor/tests")
SKIPPED_DIRECTORIES = ("node_modules", ".git", "dist", "build", ".meteor", "coverage", ".next", ".turbo")
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
ENTRY_NAMES = ("index.ts", "index.tsx", "index.js")
TEST_FILES = (".spec.ts", ".spec.tsx", ".test.ts", ".test.tsx", "/tests/", "/__tests__/")
PACKAGE_ROOTS = ("packages", "apps", "ee/packages", "ee/apps")
REEXPORT_DEPTH = 6
MAX_HOPS = 5
STOP_REASONS = ("unresolved", "dynamic", "abstract", "function-type", "interface", "javascript", "no-tsconfig", "stale-dist")
STOP_WEIGHT, JS_WEIGHT = 0.5, 0.2
#: Effect category: structural patterns.
EFFECTS = {
    "db": ("Models.$MODEL.insert($$$A)", "Models.$MODEL.update($$$A)", "Models.$MODEL.remove($$$A)", "$M.insertOne($$$A)", "$M.updateOne($$$A)", "$M.deleteOne($$$A)", "$M.findOneAndUpdate($$$A)"),
    "network": ("fetch($$$A)", "axios($$$A)", "axios.$M($$$A)", "got($$$A)"),
    "fs": ("fs.$M($$$A)", "fs.promises.$M($$$A)", "readFile($$$A)", "writeFile($$$A)"),
    "process": ("process.env", "process.exit($$$A)"),
    "timer": ("setTimeout($$$A)", "setInterval($$$A)"),
    "emit": ("api.broadcast($$$A)", "Meteor.call($$$A)", "Meteor.callAsync($$$A)"),
}


@dataclass(frozen=True)
class Provider:
    """A boundary symbol that is no export: a structural pattern with the wildcard that is its name, or without one a regular
    expression over source lines whose first group is the name."""

    name: str
    pattern: str
    roots: tuple[str, ...] = ()
    name_var: str | None = None


@dataclass(frozen=True)
class Config:
    modules: tuple[str, ...] = MODULE_PATTERNS
    exclude: tuple[str, ...] = EXCLUDED
    effects: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(EFFECTS))
    effect_lines: dict[str, tuple[str, ...]] = field(default_factory=dict)  # regular expressions over source lines
    providers: tuple[Provider, ...] = (Provider("apiRouteProbe", "API.v1.addRoute($PATH, $$$ARGS)", ("apps/meteor",), "PATH"),)
    test_files: tuple[str, ...] = TEST_FILES
    reexport_depth: int = REEXPORT_DEPTH


#: Names of the JSON form.
_JSON_NAMES = {"testFiles": "test_files", "reexportDepth": "reexport_depth", "effectLines": "effect_lines"}


def load_config(text: str | None = None) -> Config:
    """Defaults, overridden key by key by a JSON object."""
    if not text:
        return Config()
    known = {f.name for f in fields(Config)}
    given = {_JSON_NAMES.get(k, k): v for k, v in json.loads(text).items()}
    given = {k: v for k, v in given.items() if k in known}
    if "providers" in given:
        given["providers"] = tuple(Provider(p["name"], p["pattern"], tuple(p.get("roots") or ()), p.get("nameVar")) for p in given["providers"])
    for name in ("effects", "effect_lines"):
        if name in given:
            given[name] = {k: tuple(v) for k, v in given[name].items()}
    return replace(Config(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
