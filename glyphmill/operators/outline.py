"""Outlines: symbols and imports of source files, in one pass over each file.

A file's lines are read once, with the state of comments, docstrings, import
blocks and class bodies; each line meets its language's rules, first match
wins, and a definition's end is looked for from its own line on. Files are
independent, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.shared import spread
from glyphmill.sources.files import LANGUAGES

I = "([A-Za-z0-9_]{1,256})"  # noqa: E741
RS = "(?:pub(?:\\([a-z]+\\))? )?"
# language -> rules in order, first match wins: (pattern on the trimmed line, kind, group of the name, group of the dependency).
RULES: dict[str, list[tuple[str, str, int, int]]] = {
    "zig": [
        (f"^(?:pub )?fn {I}", "function", 1, 0), (f"^(?:pub )?const {I}.*struct \\{{", "struct_def", 1, 0), (f"^(?:pub )?const {I}.*enum \\{{", "enum_def", 1, 0),
        (f"^(?:pub )?const {I}.*union(?:\\(enum\\))? \\{{", "union_def", 1, 0), (f"^(?:pub )?const {I}[^\"]*@import[^\"]*\"([^\"]*)\"", "import", 1, 2), (f"^(?:pub )?const {I}.*@import", "import", 1, 0),
        (f"^(?:pub )?const {I}", "constant", 1, 0), ("^(test .*)$", "test_decl", 1, 0),
    ],
    "python": [(f"^def {I}", "function", 1, 0), (f"^class {I}", "struct_def", 1, 0), ("^((?:import|from) ([A-Za-z0-9_.]*).*)$", "import", 1, 2)],
    "typescript": [(f"function {I}", "function", 1, 0), (f"^(?:export )?const {I}.*function ", "function", 1, 0), (f"const {I}", "constant", 1, 0)],
    "rust": [
        (f"^{RS}(?:const |async |unsafe |extern \"C\" )*fn {I}", "function", 1, 0), (f"^{RS}struct {I}", "struct_def", 1, 0), (f"^{RS}enum {I}", "enum_def", 1, 0), (f"^{RS}(?:unsafe )?trait {I}", "trait_def", 1, 0),
        (f"^(?:unsafe )?impl(?:<[^>]*>)? {I}", "impl_block", 1, 0), (f"^{RS}type {I}", "type_alias", 1, 0), (f"^{RS}(?:const|static)(?: mut)? {I}", "constant", 1, 0), (f"^macro_rules! ?{I}", "macro_def", 1, 0),
        (f"^({RS}use .*)$", "import", 1, 1), (f"^{RS}mod {I}", "import", 1, 1),
    ],
    "go_lang": [(f"^func \\([^)]*\\) {I}", "function", 1, 0), (f"^func {I}", "function", 1, 0), (f"^type {I}", "struct_def", 1, 0), ("^(import (?:[A-Za-z0-9_.]+ )?\"([^\"]+)\".*)$", "import", 1, 2), (f"^const {I}", "constant", 1, 0), (f"^var {I}", "variable", 1, 0)],
    "php": [
        (f"^(?:abstract |final |readonly )*class {I}", "class_def", 1, 0), (f"^interface {I}", "interface_def", 1, 0), (f"^trait {I}", "trait_def", 1, 0), (f"^enum {I}", "enum_def", 1, 0),
        (f"^(?:public |private |protected |final )*const (?!class)(?:[A-Za-z0-9_]+ )?{I} *=", "constant", 1, 0), (f"function &?{I}", "function", 1, 0),
    ],
    "ruby": [("^def (?:self\\.)?([A-Za-z0-9_]+[?!=]?)", "function", 1, 0), (f"^(?:class|module) {I}", "struct_def", 1, 0), ("^(require(?:_relative)? [\"']([^\"']+)[\"'].*)$", "import", 1, 2)],
    "hcl": [
        ("^(?:resource|data) \"[^\"]*\" \"([^\"]*)\"", "struct_def", 1, 0), ("^(?:module|provider) \"([^\"]*)\"", "import", 1, 0), ("^variable \"([^\"]*)\"", "variable", 1, 0), ("^output \"([^\"]*)\"", "constant", 1, 0), ("^(locals|terraform) ?\\{", "struct_def", 1, 0),
    ],
    "r": [("^((?:library|require)\\([\"']?([A-Za-z0-9_.]+).*)$", "import", 1, 2), ("^set(?:Ref)?Class\\([\"']([^\"']+)", "class_def", 1, 0), (".*setRefClass\\([\"']([^\"']+)", "class_def", 1, 0), ("^([A-Za-z0-9_.]+) *(?:<-|=) *function\\(", "function", 1, 0)],
    "dart": [
        ("^((?:import|export|part) (?!of)[\"']([^\"']+)[\"'].*)$", "import", 1, 2), (f"^typedef {I}", "type_alias", 1, 0), (f"^(?:abstract |base |final |sealed |interface )*class {I}", "class_def", 1, 0), (f"^(?:base )?mixin (?:class )?{I}", "trait_def", 1, 0),
        (f"^extension (?!on ){I}", "impl_block", 1, 0), (f"^enum {I}", "enum_def", 1, 0), (f"^(?:static )?(?:const|final) (?:[A-Za-z0-9_<>?]+ )?{I} *=", "constant", 1, 0), (f"^(?:@override )?(?:static )?(?:Future<[^>]*>|[A-Za-z0-9_<>?]+) {I}\\([^;=]*\\)[^;]*(?:\\{{|=>)", "function", 1, 0),
    ],
}
RULES["javascript"] = RULES["typescript"]
#: Languages with ``/* */`` comments; kinds that end on their own line; braces are looked for on so many lines.
SLASH_STAR = {"typescript", "javascript", "go_lang", "c", "cpp", "rust", "zig", "hcl", "dart", "php"}
ONE_LINE = {"import", "variable", "constant", "type_alias", "macro_def"}
NEAR = 10
COMPILED = {lang: [(re.compile(p), kind, g, d) for p, kind, g, d in rules] for lang, rules in RULES.items()}
#: A line that none of a language's rules can match, told by one search.
ANY = {lang: re.compile("|".join(f"(?:{p})" for p, *_ in rules)) for lang, rules in RULES.items()}
LITERAL = re.compile("\"([^\"]*)\"|'([^']*)'")
TOKEN = re.compile(r"\\.|//|/\*|\*/|[\"'{}\n]", re.S)


def language_of(path: str) -> str:
    return next((name for name, suffixes in LANGUAGES if path.endswith(tuple(suffixes))), "unknown")


def literal(line: str) -> str | None:
    """The first string of a line; double quotes are looked for first."""
    found = re.search("\"([^\"]*)\"", line) or re.search("'([^']*)'", line)
    return found[1] if found else None


def php_path(name: str) -> str:
    """A namespaced class as a path: the first part in lower case."""
    first, *rest = name.strip().strip("\\").split("\\")
    return "/".join([first.translate({c: c + 32 for c in range(65, 91)}), *rest]) + ".php"


def php_uses(line: str) -> list[str]:
    """The paths that a ``use`` line names, one for each member of a group; aliases are dropped."""
    body = re.sub(r"^use (?:function |const )?", "", line).split(";")[0]
    before, brace, group = body.partition("{")
    names = [before.strip() + x.strip() for x in group.split("}")[0].split(",") if x.strip()] if brace else body.split(",")
    return [php_path(re.split(r"\s+as\s+", x, flags=re.I)[0]) for x in names if x.strip()]


def python_path(name: str) -> str | None:
    return None if not name or name.startswith(".") else name.replace(".", "/") + ".py"


class Braces:
    """The depth of braces in PHP, outside strings, comments and escapes."""

    def __init__(self) -> None:
        self.depth, self.classes = 0, []

    def read(self, line: str) -> None:
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*$|#(?!\[).*$", "", line)
        for c in bare:
            self.depth += (c == "{") - (c == "}")
            if c == "}":
                while self.classes and self.depth <= self.classes[-1]:
                    self.classes.pop()


def visible(lines: list[str], lang: str) -> Iterator[tuple[int, str]]:
    """(line number, trimmed text) outside block comments and docstrings; code after a comment's end counts."""
    inside = False
    for n, line in enumerate(lines, 1):
        t = line.strip(" \t")
        if lang in SLASH_STAR:
            if inside:
                if "*/" not in t:
                    continue
                t, inside = t.split("*/", 1)[1].strip(" \t"), False
            last = t.rfind("/*")
            if last >= 0 and t.find("*/", last) < 0 and "//" not in t[:last]:
                inside = True
            if t.startswith("/*"):
                t = t.split("*/", 1)[1].strip(" \t") if "*/" in t else ""
        elif lang == "python":
            odd = len(re.findall('\"\"\"|\'\'\'', t)) % 2 == 1
            if inside:
                inside = not odd
                continue
            inside = odd
        elif lang == "ruby":
            if inside or t.startswith("=begin"):
                inside = not t.startswith("=end")
                continue
        yield n, t


def brace_end(lines: list[str], start: int) -> int:
    """The line on which the first brace after the beginning of line ``start`` is closed.

    Strings may go on over lines. Without a brace within ``NEAR`` lines a
    definition ends where it starts, without a closing one at the last line.
    """
    depth, opened, mode = 0, False, ""
    for n in range(start, len(lines) + 1):
        if not opened and n > start + NEAR:
            return start
        for m in TOKEN.finditer(lines[n - 1]):
            t = m[0]
            if mode == "/*":
                mode = "" if t == "*/" else mode
            elif mode:
                mode = "" if t == mode else mode
            elif t == "//":
                break
            elif t in ("/*", '"', "'"):
                mode = t
            elif t == "{":
                depth, opened = depth + 1, True
            elif t == "}":
                depth -= 1
                if opened and depth == 0:
                    return n
    return len(lines) if opened else start


def _indent(line: str) -> int:
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return len(lead.replace("\t", "    "))


def python_end(lines: list[str], start: int) -> int:
    """The last line that is indented deeper than the definition; blank and comment lines neither end nor extend it."""
    own, n = _indent(lines[start - 1]), start
    while n <= len(lines) and ":" not in lines[n - 1]:  # a signature over several lines
        n += 1
    if n > len(lines):
        return start
    while n <= len(lines) and lines[n - 1].count("(") > lines[n - 1].count(")") and not lines[n - 1].rstrip(" \t").endswith(":"):
        n += 1
        while n <= len(lines) and not lines[n - 1].rstrip(" \t").endswith(":"):
            n += 1
    end = min(n, len(lines))
    for k in range(end + 1, len(lines) + 1):
        t = lines[k - 1].strip(" \t\r")
        if not t or t.startswith("#"):
            continue
        if _indent(lines[k - 1]) <= own:
            break
        end = k
    return end


def ruby_end(lines: list[str], start: int) -> int:
    own = _indent(lines[start - 1])
    return next((k for k in range(start + 1, len(lines) + 1) if lines[k - 1].strip(" \t\r") == "end" and _indent(lines[k - 1]) <= own), start)


ENDS = {"python": python_end, "ruby": ruby_end}


def outline(path: str, content: str) -> list[tuple[str, str, int, int, str | None, list[str]]]:
    """(name, kind, line_start, line_end, detail, deps) of a file's symbols, in order."""
    lang, out = language_of(path), []
    if lang not in COMPILED:
        return out
    lines, previous, block, braces = content.split("\n"), "", False, Braces()
    end_of = ENDS.get(lang, brace_end)

    def add(name: str, kind: str, n: int, detail: str | None = None, deps: list[str] | None = None) -> None:
        out.append((name, kind, n, n if kind in ONE_LINE else end_of(lines, n), detail, [d for d in deps or [] if d]))

    for n, t in visible(lines, lang):
        before, previous = previous, t
        if lang == "go_lang" and block:
            if t.startswith(")"):
                block = False
            elif dep := literal(t):
                add(t, "import", n, deps=[dep])
            continue
        if lang == "go_lang" and t == "import (":
            block = True
            continue
        if lang == "php":
            if t.startswith(("<?php", "//", "#")):
                continue
            if t.startswith("use ") and "\\" in t:
                add(t, "import", n, deps=php_uses(t))
                continue
        if lang == "dart" and t.startswith("@"):
            continue
        if ANY[lang].search(t):
            for pattern, kind, g, d in COMPILED[lang]:
                if not (m := pattern.search(t)):
                    continue
                dep = m[d] if d else None
                if lang == "python" and kind == "import":
                    dep = python_path(dep)
                if lang == "rust" and kind == "function" and re.match(r"#\[(?:test\]|tokio::test)", before):
                    kind = "test_decl"
                if lang == "php" and kind == "function" and braces.classes:
                    kind = "method"
                if lang == "php" and kind in ("class_def", "interface_def", "trait_def", "enum_def"):
                    braces.classes.append(braces.depth)
                add(m[g], kind, n, None if kind == "import" or lang == "zig" and kind == "test_decl" else t, [dep])
                break
        if lang in ("typescript", "javascript") and ("import " in t or "require(" in t):
            add(t, "import", n, deps=[literal(t)])
        if lang == "php":
            braces.read(t)
    return out


SCHEMA = "path string, ord int, name string, kind string, line_start int, line_end int, detail string, deps array<string>"


def outline_rows(files: DataFrame) -> DataFrame:
    """(path, ord, name, kind, line_start, line_end, detail, deps) of all files; null contents have no symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
        names = ["path", "ord", "name", "kind", "line_start", "line_end", "detail", "deps"]
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows += [(path, i, *s) for i, s in enumerate(outline(path, content.as_py()) if content.is_valid and path else [])]
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return spread(files.select("path", "content")).mapInArrow(run, SCHEMA)


def symbols(files: DataFrame) -> DataFrame:
    """(path, ord, name, kind, line_start, line_end, detail, dep) of every symbol; ``dep`` is an import's first path.

    Definitions end with the brace, indentation or ``end`` that closes them;
    imports, constants, variables, aliases and macros end on their line.
    """
    return outline_rows(files).select("path", "ord", "name", "kind", "line_start", "line_end", "detail", F.get("deps", F.lit(0)).alias("dep"))


def imports(files: DataFrame) -> DataFrame:
    """(path, ord, dep): what each file imports, in source order, repeats kept."""
    rows = outline_rows(files).where(F.size("deps") > 0).select("path", "ord", F.posexplode("deps").alias("at", "dep"))
    return rows.select("path", (F.col("ord") * 1000 + F.col("at")).alias("ord"), "dep")


def symbol_index(s: DataFrame) -> DataFrame:
    """(name, path, ord, kind, line_start): where each definition lies; imports and comments aside."""
    return s.where(~F.col("kind").isin("import", "comment_block")).select("name", "path", "ord", "kind", "line_start")
