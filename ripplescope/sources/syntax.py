"""Functions and decision points of TypeScript and JavaScript files, found in their tokens.

A file is cut into tokens, brackets are paired, and functions are recognised by what stands around `function`, `=>` and a name
before a parameter list and a body. There is no grammar behind it, so text between JSX tags and types of unusual form may be
misread. What counts as a decision follows the engine's definition of complexity: if, for, while, do, case, catch, the
conditional operator, &&, || and ??; optional chaining, logical assignment, defaults of parameters and types do not count.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.facts import function_counts
from ..storage import materialize

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<word>\#?[A-Za-z_$\u0080-￿][\w$]*)
    |(?P<number>\d[\w.]*)
    |(?P<string>'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?)
    |(?P<mark>=>|\?\?=|&&=|\|\|=|\?\?|&&|\|\||\?\.(?!\d)|\.\.\.|[=!]==?|<=|>=|.)""",
    re.X | re.S,
)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_BEFORE_VALUE = frozenset("return typeof case in of delete void do else instanceof new throw yield await".split())
_CONTROL = frozenset("if for while switch catch with function await return typeof super new".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_STARTS = frozenset("const let var if for while do switch return throw try function class export import interface type enum break continue".split())
_DECLARES = frozenset("const let var private public protected readonly static".split())
#: After these a bracket or an object belongs to a type that goes on.
_TYPE_GOES_ON = frozenset([":", "|", "&", "<", ",", "=>", "is", "keyof", "extends", "readonly", "(", "["])


@dataclass
class Token:
    kind: str
    text: str
    at: int


def tokenize(text: str) -> list[Token]:
    """Tokens without space and comments; what a template literal computes stands in round brackets."""
    out: list[Token] = []
    depth: list[int] = []  # open braces inside each template that is being read
    heads: list[bool] = []  # of each open round bracket: whether it belongs to if, for, while or with
    headed = False  # the last closed one did
    at = 0
    while at < len(text):
        c = text[at]
        if c == "`" or c == "}" and depth and depth[-1] == 0:
            if c == "}":
                depth.pop()
                out.append(Token("mark", ")", at))
            end = at + 1
            while end < len(text) and text[end] != "`" and not text.startswith("${", end):
                end += 2 if text[end] == "\\" else 1
            out.append(Token("string", text[at:end], at))
            at = end + 1
            if text.startswith("${", end):
                out.append(Token("mark", "(", end))
                depth.append(0)
                at = end + 2
            continue
        last = out[-1] if out else None
        value = last is not None and (last.kind in ("number", "string") or last.kind == "word" and last.text not in _BEFORE_VALUE or last.text in _CLOSE and not (last.text == ")" and headed) or last.text == "<")
        if c == "/" and not value and not text.startswith(("//", "/*"), at) and (m := _PATTERN.match(text, at)):
            out.append(Token("string", m[0], at))
            at = m.end()
            continue
        m = _TOKEN.match(text, at)
        if m.lastgroup != "space":
            if c == "(":
                heads.append(last is not None and last.kind == "word" and last.text in ("if", "for", "while", "with", "await"))
            elif c == ")":
                headed = bool(heads) and heads.pop()
            out.append(Token(m.lastgroup, m[0], at))
            if depth and c in "{}":
                depth[-1] += 1 if c == "{" else -1
        at = m.end()
    return out


def paired(tokens: list[Token]) -> tuple[dict[int, int], list[int | None]]:
    """The partner of each bracket, and the bracket around each token."""
    pair: dict[int, int] = {}
    inside: list[int | None] = []
    stack: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind == "mark" and t.text in _CLOSE and stack and _OPEN[tokens[stack[-1]].text] == t.text:
            pair[i] = stack[-1]
            pair[stack.pop()] = i
        inside.append(stack[-1] if stack else None)
        if t.kind == "mark" and t.text in _OPEN:
            stack.append(i)
    return pair, inside


@dataclass
class Function:
    first: int  # its first token, parameters' defaults included
    last: int
    name: str
    kind: str
    anonymous: bool
    is_async: bool
    exported: bool
    parent: int | None = None
    decisions: list[int] = field(default_factory=list)
    parameters: int | None = None  # the bracket around them


class Source:
    """The functions of one text, in the order of their first tokens."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens = text, tokenize(text)
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.pair, self.inside = paired(self.tokens)
        self.types, self.class_bodies = self._type_tokens(), self._class_bodies()
        self.typed_arrows: set[int] = set()
        self.parameters: set[int] = set()  # opening brackets of parameter lists
        self.functions: list[Function] = []
        for i, t in enumerate(self.tokens):
            if i not in self.types:
                self._look_at(i, t)
        self.functions.sort(key=lambda f: (f.first, -f.last))
        self._nest()

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind != "string" and self.tokens[i].text in texts

    def word(self, i: int) -> str | None:
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind == "word" else None

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.tokens[i].at - 1) + 1

    def _type_tokens(self) -> set[int]:
        found: set[int] = set()
        for i in range(len(self.tokens)):
            if i in found or self.is_(i - 1, "."):
                continue
            if self.word(i) == "interface" and self.word(i + 1):
                k = i + 2
                while k < len(self.tokens) and not self.is_(k, "{"):
                    k += 1
                found.update(range(i, self.pair.get(k, k) + 1))
            elif self.word(i) == "type" and self.word(i + 1) and self.is_(i + 2, "=", "<"):
                k = i + 2
                while k < len(self.tokens) and not self.is_(k, ";") and (self.inside[k] == self.inside[i] or self.is_(k, *_OPEN)):
                    new = k > i + 2 and self.line(k) > self.line(k - 1)
                    if new and self.word(k) and not self.is_(k - 1, *_TYPE_GOES_ON, "=", "?") or self.is_(k, "}"):
                        break
                    k = self.pair.get(k, k) + 1 if self.is_(k, *_OPEN) else k + 1
                found.update(range(i, k))
        return found

    def _body(self, i: int) -> int | None:
        """The opening brace of a body whose parameter list ends before i, past a type of what is returned."""
        if self.is_(i, "{"):
            return i if i in self.pair else None
        if not self.is_(i, ":"):
            return None
        k = i + 1
        while k < len(self.tokens):
            if self.is_(k, "(", "[") or self.is_(k, "{") and self.is_(k - 1, *_TYPE_GOES_ON):
                k = self.pair.get(k, k) + 1
            elif self.is_(k, "{"):
                return k if k in self.pair else None
            elif self.is_(k, ";", "=", "}", ")") or k > i + 1 and self._next_statement(k):
                return None
            else:
                k += 1
        return None

    def _next_statement(self, k: int) -> bool:
        """Whether a type has ended with its line before k, as that of an overload without a semicolon."""
        return self.word(k) not in (None, "is", "extends") and self.line(k) > self.line(k - 1) and not self.is_(k - 1, *_TYPE_GOES_ON)

    def _past_generics(self, i: int) -> int:
        if not self.is_(i, "<"):
            return i
        depth, k = 0, i
        while k < len(self.tokens) and not self.is_(k, ";", "&&", "||", *_CLOSE):
            depth += self.is_(k, "<") - self.is_(k, ">")
            if not depth:
                return k + 1
            k = self.pair.get(k, k) + 1
        return i

    def _back(self, i: int, *stops: str) -> Iterator[int]:
        """Tokens from i towards the start of a statement, closed brackets as one, up to a stop or the bracket around them."""
        while i >= 0 and not self.is_(i, *stops) and not (self.is_(i, *_OPEN) and self.pair.get(i, i) >= i):
            yield i
            i = (self.pair[i] if self.is_(i, *_CLOSE) and i in self.pair else i) - 1

    def _bound(self, first: int) -> str | None:
        """The name of the variable, property or target that a function which starts here is given to."""
        k = first - 1 - (self.word(first - 1) == "async")
        around = self.inside[first]
        if self.is_(k, "=") and around not in self.parameters:
            j = k - 1
            while j > 0 and not self.word(j):  # past a type or an index
                j = self.pair[j] - 1 if j in self.pair and self.is_(j, *_CLOSE) else j - 1
            for m in self._back(k - 1, ";", "="):
                if self.word(m) in _DECLARES:
                    j = m + 1 if self.is_(m + 2 + self.is_(m + 2, "!", "?"), ":") else j
                    break
            return self.word(j) or "?"
        if self.is_(k, ":") and around is not None and self.is_(around, "{") and self.is_(k - 2, "{", ","):
            return self.tokens[k - 1].text.strip("'\"")
        return None

    def _exported(self, first: int) -> bool:
        for k in self._back(first - 1, ";"):
            if self.word(k) in ("const", "let", "var", "function", "class"):
                return self.word(k - 1) == "export" or self.word(k - 1) in ("default", "async", "abstract", "declare") and self.word(k - 2) == "export"
            if self.word(k) == "export":
                return True
        return False

    def _add(self, first: int, parameters: int | None, last: int, name: str, kind: str, anonymous: bool) -> None:
        is_async = any(self.word(k) == "async" for k in (first - 1, first - 2))
        if parameters is not None:
            self.parameters.add(parameters)
        self.functions.append(Function(first, last, name, kind, anonymous, is_async, self._exported(first), parameters=parameters))

    def _look_at(self, i: int, t: Token) -> None:
        if t.kind == "word" and t.text == "function" and not self.is_(i - 1, "."):
            k = i + 1 + self.is_(i + 1, "*")
            name = self.word(k)
            start = self._past_generics(k + (name is not None))
            body = self._body(self.pair[start] + 1) if self.is_(start, "(") and start in self.pair else None
            if body is None:
                return
            before = i - 1 - (self.word(i - 1) == "async")
            label = self.is_(before, ":") and any(self.word(m) in ("case", "default") for m in self._back(before - 1, ";", "}"))
            declared = name is not None and (before < 0 or label or self.is_(before, ";", "{", "}", ")") or self.word(before) in ("export", "default", "else", "declare"))
            given = None if declared else self._bound(i)
            self._add(i, start, self.pair[body], name or given or "", "function" if declared else "expression", not declared and given is None)
        elif t.kind == "mark" and t.text == "=>":
            self._look_at_arrow(i)
        elif (t.kind == "word" and t.text not in _CONTROL or t.kind == "string") and not self.is_(i - 1, ".", "?.") and self.word(i - 1) not in ("function", "new"):
            start = self._past_generics(i + 1)
            body = self._body(self.pair[start] + 1) if self.is_(start, "(") and start in self.pair else None
            if body is None or self.is_(i - 1, "*") and self.word(i - 2) == "function":
                return
            kind = "accessor" if self.word(i - 1) in ("get", "set") else "constructor" if t.text == "constructor" else "method"
            self._add(i, start, self.pair[body], t.text.strip("'\""), kind, kind != "method")

    def _look_at_arrow(self, i: int) -> None:
        k = i - 1
        if not (self.is_(k, ")") and k in self.pair) and not (self.word(k) and not self.is_(k - 1, ":")):
            k = next((m for m in self._back(k, ";", "=") if self.is_(m, ":") and self.is_(m - 1, ")")), 0) - 1
        elif self.word(k) and self.is_(k - 1, ":") and self.is_(k - 2, ")"):
            k -= 2
        parameters = self.pair.get(k) if self.is_(k, ")") else None
        first = parameters if parameters is not None else k
        if first < 0 or i + 1 >= len(self.tokens):
            return
        before = first - 1
        if self._in_type(before):
            self.typed_arrows.add(i)
            return
        if parameters is not None:
            self.parameters.add(parameters)
        end = self.pair[i + 1] if self.is_(i + 1, "{") and i + 1 in self.pair else self._expression_end(i + 1)
        given = self._bound(first)
        self._add(first, parameters, end, given or "", "arrow", given is None)

    def _in_type(self, before: int) -> bool:
        """Whether what follows is a type: it stands after a colon of a declaration, or another type leads to it."""
        if self.is_(before, "|", "&", "<", "extends") or self.word(before) in ("as", "keyof", "satisfies") or before in self.typed_arrows:
            return True
        if not self.is_(before, ":"):
            return False
        name = before - 1 - self.is_(before - 1, "?")
        around = self.inside[before]
        declared = self.word(name - 1) in ("const", "let", "var", "readonly", "public", "private", "protected", "static", "declare")
        optional = self.is_(before - 1, "?", "!")
        listed = around is not None and self.is_(around, "(") and self.is_(name - 1, "(", ",", "...") and not self.is_(around - 1, "?")
        return declared or optional or listed or self.is_(name, ")") and not self.is_(self.pair.get(name, 0) - 1, "?")

    def _expression_end(self, i: int) -> int:
        """The last token of an expression that starts at i."""
        k = i
        while k < len(self.tokens):
            if self.is_(k, ",", ";", *_CLOSE):
                return k - 1
            fresh = k > i and self.line(k) > self.line(k - 1) and (self.tokens[k - 1].kind != "mark" or self.is_(k - 1, *_CLOSE))
            if fresh and (self.word(k) in _STARTS or self.tokens[k].kind == "word" and self.is_(k + 1, "=", "(", ".")):
                return k - 1
            k = self.pair.get(k, k) + 1 if self.is_(k, *_OPEN) else k + 1
        return len(self.tokens) - 1

    def _typed_question(self, i: int) -> bool:
        """Whether a question mark belongs to a conditional type or to an optional method of a class or a type of an object."""
        if any(self.word(m) == "extends" for m in self._back(i - 1, ";", ",", "=", "=>", "?", ":", "return", "&&", "||", "??")):
            return True
        around = self.inside[i]
        if not (self.is_(i + 1, "(", "<") and around is not None and self.is_(around, "{")):
            return False
        name = self.pair[i - 1] if self.is_(i - 1, "]") and i - 1 in self.pair else i - 1
        begins = self.is_(name - 1, "{", ";", ",", "}") or self.word(name - 1) in _DECLARES or self.line(name) > self.line(name - 1)
        return begins and (around in self.class_bodies or self.is_(around - 1, ":", "|", "&", "<") or self.word(around - 1) in ("as", "extends", "satisfies"))

    def _class_bodies(self) -> set[int]:
        found: set[int] = set()
        for i in range(len(self.tokens)):
            if self.word(i) == "class" and not self.is_(i - 1, ".", "?."):
                k = i + 1
                while k < len(self.tokens) and not self.is_(k, "{", ";", *_CLOSE):
                    k = (self.pair.get(k, k) if self.is_(k, *_OPEN) else k) + 1
                if self.is_(k, "{"):
                    found.add(k)
        return found

    def decides(self, i: int) -> bool:
        t = self.tokens[i]
        if t.kind == "mark":
            return t.text in ("&&", "||", "??") or t.text == "?" and not self.is_(i + 1, ":", ",", ")", "=", ";") and not self._typed_question(i)
        if t.kind != "word" or self.is_(i - 1, ".", "?.") or self.is_(i + 1, ":", ","):
            return False
        if t.text == "while":
            block = self.pair.get(i - 1) if self.is_(i - 1, "}") else None
            return self.is_(i + 1, "(") and not (block is not None and self.word(block - 1) == "do")
        return t.text == "case" or t.text == "do" and self.is_(i + 1, "{") or t.text in ("if", "for") and (self.is_(i + 1, "(") or self.word(i + 1) == "await") or t.text == "catch" and self.is_(i + 1, "(", "{")

    def _nest(self) -> None:
        """The parent of each function and the decisions whose innermost function it is."""
        stack: list[int] = []
        follow = 0
        for i in range(len(self.tokens)):
            while follow < len(self.functions) and self.functions[follow].first == i:
                while stack and self.functions[stack[-1]].last < i:
                    stack.pop()
                self.functions[follow].parent = stack[-1] if stack else None
                stack.append(follow)
                follow += 1
            while stack and self.functions[stack[-1]].last < i:
                stack.pop()
            if stack and i not in self.types and self.decides(i):
                self.functions[stack[-1]].decisions.append(self.line(i))


_ROW = pa.schema([
    ("tree", pa.string()), ("file", pa.string()), ("fn_id", pa.string()), ("parent", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()),
    ("kind", pa.string()), ("anonymous", pa.bool_()), ("exported", pa.bool_()), ("is_async", pa.bool_()), ("decisions", pa.list_(pa.int32())),
    ("first", pa.int32()), ("last", pa.int32()), ("parameters", pa.int32()),
])
_DDL = "tree string, file string, fn_id string, parent string, start int, end int, name string, kind string, anonymous boolean, exported boolean, is_async boolean, decisions array<int>, first int, last int, parameters int"


_TOKENS = pa.schema([("tree", pa.string()), ("file", pa.string()), ("at", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("line", pa.int32()), ("pair", pa.int32()), ("around", pa.int32())])


def token_rows(files: DataFrame) -> DataFrame:
    """files(tree, file, text) to one row per token: at (its number), kind, text, line, pair (a bracket's partner), around (the
    bracket around it). Texts that are null or empty have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, file, text in zip(*[c.to_pylist() for c in batch.columns]):
                tokens = tokenize(text or "")
                lines = [m.start() for m in re.finditer("\n", text or "")]
                pair, inside = paired(tokens)
                rows = [(tree, file, i, t.kind, t.text, bisect_right(lines, t.at - 1) + 1, pair.get(i), inside[i]) for i, t in enumerate(tokens)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _TOKENS)], schema=_TOKENS)

    return files.select("tree", "file", "text").mapInArrow(run, "tree string, file string, at int, kind string, text string, line int, pair int, around int")


def scan_functions(files: DataFrame) -> DataFrame:
    """files(tree, file, text) to one row per function: its place, name, kind, the function around it, lines of its decisions;
    first, last and parameters are numbers of tokens.

    Texts that are null or empty have no functions. Each file is read by itself, so a task holds one text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, file, text in zip(*[c.to_pylist() for c in batch.columns]):
                source = Source(text or "")
                ids = [f"{file}#{f.first}" for f in source.functions]
                rows = [
                    (tree, file, ids[n], None if f.parent is None else ids[f.parent], source.line(f.first), source.line(f.last), f.name, f.kind, f.anonymous, f.exported, f.is_async, f.decisions, f.first, f.last, f.parameters)
                    for n, f in enumerate(source.functions)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _ROW)], schema=_ROW)

    return files.select("tree", "file", "text").mapInArrow(run, _DDL)


def decision_nodes(functions: DataFrame) -> DataFrame:
    """nodes(tree, owner, decision) for function_counts."""
    return functions.select("tree", F.col("fn_id").alias("owner"), F.explode("decisions")).select("tree", "owner", F.lit(True).alias("decision"))


def function_table(files: DataFrame) -> DataFrame:
    """The rows of schemas.TABLES["functions"] for files(tree, file, text)."""
    found = materialize(scan_functions(files), "functions")
    counts = function_counts(decision_nodes(found), found)
    shown = found.select("tree", "fn_id", "file", "start", "end", "name", "kind", "exported", "is_async").join(counts, ["tree", "fn_id"])
    return shown.select("tree", "fn_id", "file", "start", "end", "name", "kind", "own", "inline", "exported", "is_async", "unit_id")
