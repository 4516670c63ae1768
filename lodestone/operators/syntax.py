"""Syntax-aware chunks and call graphs without grammars.

Python is read with the standard library's ``ast``. Rust, JavaScript,
TypeScript, Go, C, C++ and Java are scanned by a lexer that blanks strings and
comments and pairs braces; definitions are found by patterns and end where
their braces do. Ruby is scanned line by line with ``end``. A source that
cannot be read gives no chunks, and the router falls back to lines.

Deviations kept on purpose: definitions and calls are extracted once per file,
with file lines; classes and methods get definition rows in every language, and
a callee is the last name of its path, not the receiver.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.language import CONFIGURATION, PARSED

from .chunking import CHUNK_COLUMNS, CHUNK_SCHEMA, chunk_by_lines, chunk_env, chunk_json, chunk_toml, chunk_yaml

LEAST_BYTES = 50
SIGNATURE_BYTES = 200


@dataclass
class Def:
    name: str | None
    node: str  # the syntax node's kind
    start: int  # offsets in the text
    end: int
    kind: str | None = None  # of the definition row; None for nodes that define nothing
    scope: str | None = None
    body: int = 0  # where the body begins

    @property
    def is_scope(self) -> bool:
        return self.kind in ("class", "struct", "impl", "trait", "interface", "module", "namespace", "enum")


_ID = r"[A-Za-z_$][\w$]*"
#: Per language: (node, pattern, kind of the definition row); the pattern's group n is the name. A definition without braces ends at its semicolon.
_C_FUNCTION = r"^[ \t]*(?!(?:return|else|if|for|while|switch|case|do|new|delete|throw|typedef|using|goto)\b)(?:[\w:<>,*&~\[\]]+[ \t*&]+)+?(?P<n>~?[A-Za-z_]\w*(?:::~?[A-Za-z_]\w*)*)[ \t]*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)[^;{}=]*(?=\{)"
PATTERNS: dict[str, list[tuple[str, str, str | None]]] = {
    "rust": [
        ("function_item", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:const|async|unsafe|default|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*fn[ \t]+(?P<n>{_ID})", "function"),
        ("impl_item", rf"^[ \t]*(?:unsafe[ \t]+)?impl\b(?:<[^{{;]*?>)?[ \t]+(?:[^{{;]*?[ \t]for[ \t]+)?(?P<n>{_ID})", "impl"),
        ("struct_item", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?struct[ \t]+(?P<n>{_ID})", "struct"),
        ("enum_item", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?enum[ \t]+(?P<n>{_ID})", "enum"),
        ("trait_item", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:unsafe[ \t]+)?trait[ \t]+(?P<n>{_ID})", "trait"),
        ("mod_item", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(?P<n>{_ID})", None),
        ("macro_definition", rf"^[ \t]*macro_rules![ \t]*(?P<n>{_ID})", None),
        ("const_item", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?const[ \t]+(?P<n>{_ID})[ \t]*:", None),
        ("static_item", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?static[ \t]+(?:mut[ \t]+)?(?P<n>{_ID})[ \t]*:", None),
        ("type_item", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?type[ \t]+(?P<n>{_ID})", None),
    ],
    "javascript": [
        ("function_declaration", rf"^[ \t]*(?:export[ \t]+(?:default[ \t]+)?)?(?:async[ \t]+)?function\b[ \t*]*(?P<n>{_ID})", "function"),
        ("class_declaration", rf"^[ \t]*(?:export[ \t]+(?:default[ \t]+)?)?(?:abstract[ \t]+)?class[ \t]+(?P<n>{_ID})", "class"),
        ("lexical_declaration", rf"^[ \t]*(?:export[ \t]+)?(?:const|let)[ \t]+(?P<n>{_ID})[ \t]*(?::[^=;]+)?=(?!=)", None),
        ("method_definition", rf"^[ \t]+(?:(?:static|async|get|set|public|private|protected|readonly|override)[ \t]+)*(?!(?:if|for|while|switch|catch|function|return|with)\b)(?P<n>[#]?{_ID})[ \t]*(?:<[^>]*>)?\([^;{{}}]*\)[^;{{}}()]*(?=\{{)", "method"),
    ],
    "go": [
        ("function_declaration", r"^func[ \t]+(?P<n>[A-Za-z_]\w*)[ \t]*[\[(]", "function"),
        ("method_declaration", r"^func[ \t]*\([^)]*\)[ \t]*(?P<n>[A-Za-z_]\w*)[ \t]*\(", "method"),
        ("type_declaration", r"^type[ \t]+(?P<n>[A-Za-z_]\w*)", None),
    ],
    "c": [
        ("function_definition", _C_FUNCTION, "function"),
        ("struct_specifier", r"^[ \t]*(?:typedef[ \t]+)?(?:struct|union)[ \t]+(?P<n>[A-Za-z_]\w*)[^;(){}=]*(?=\{)", "struct"),
        ("class_specifier", r"^[ \t]*class[ \t]+(?P<n>[A-Za-z_]\w*)[^;(){}]*(?=\{)", "class"),
        ("enum_specifier", r"^[ \t]*(?:typedef[ \t]+)?enum(?:[ \t]+class)?[ \t]+(?P<n>[A-Za-z_]\w*)[^;(){}]*(?=\{)", None),
        ("namespace_definition", r"^[ \t]*(?:inline[ \t]+)?namespace[ \t]+(?P<n>[A-Za-z_][\w:]*)[ \t]*(?=\{)", None),
    ],
    "java": [
        ("class_declaration", r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)[ \t]+)*(?:class|record)[ \t]+(?P<n>\w+)", "class"),
        ("interface_declaration", r"^[ \t]*(?:(?:public|private|protected|static|sealed)[ \t]+)*interface[ \t]+(?P<n>\w+)", "interface"),
        ("enum_declaration", r"^[ \t]*(?:(?:public|private|protected|static)[ \t]+)*enum[ \t]+(?P<n>\w+)", None),
        ("constructor_declaration", r"^[ \t]+(?:(?:public|private|protected)[ \t]+)(?P<n>[A-Z]\w*)[ \t]*\([^;{}]*\)[^;{}]*(?=\{)", "constructor"),
        ("method_declaration", r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)[ \t]+)*(?!(?:return|new|else|throw|if|for|while|switch|catch|public|private|protected)\b)(?:<[^>]*>[ \t]*)?[\w.]+(?:<[^;{}()]*>)?(?:\[\])*[ \t]+(?P<n>\w+)[ \t]*\([^;{}]*\)[^;{}=]*(?=\{)", "method"),
    ],
}
PATTERNS["typescript"] = PATTERNS["javascript"]
PATTERNS["cpp"] = PATTERNS["c"]
_COMPILED = {lang: [(n, re.compile(p, re.M), k) for n, p, k in ps] for lang, ps in PATTERNS.items()}
_NOT_CALLS = frozenset("if for while switch catch return sizeof match loop fn func function def class struct new await typeof super elif and or not in is lambda with assert del print_ yield throw else do case unless until when".split())
_CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)[ \t]*(?:::<[^>()]*>)?\(")


def blanked(text: str, language: str) -> str:
    """The text with the insides of strings and comments replaced by blanks, same length and lines."""
    out, i, n = list(text), 0, len(text)

    def wipe(a: int, z: int) -> None:
        for k in range(a, min(z, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c, two = text[i], text[i : i + 2]
        if two == "//" and language != "ruby" or c == "#" and language == "ruby":
            z = text.find("\n", i)
            z = n if z < 0 else z
            wipe(i, z)
        elif two == "/*" and language != "ruby":
            z = text.find("*/", i + 2)
            z = n if z < 0 else z + 2
            wipe(i, z)
        elif language == "rust" and (m := re.compile(r"r(#*)\"").match(text, i)) and (i == 0 or not text[i - 1].isalnum()):
            z = text.find('"' + m[1], m.end())
            z = n if z < 0 else z + 1 + len(m[1])
            wipe(i + 1, z)
        elif c == "'" and language == "rust" and not re.compile(r"'(\\.[^']*|[^\\'])'").match(text, i):
            z = i + 1  # a lifetime
        elif c in "\"'" or c == "`" and language in ("javascript", "typescript", "go"):
            z = i + 1
            while z < n and text[z] != c and (c == "`" or text[z] != "\n"):
                z += 2 if text[z] == "\\" and not (c == "`" and language == "go") else 1
            wipe(i + 1, z)
            z += 1
        else:
            z = i + 1
        i = z
    return "".join(out)


def _close(code: str, at: int) -> int:
    """Where the brace at ``at`` is closed."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def _braced(text: str, language: str) -> list[Def]:
    code, found, seen = blanked(text, language), [], set()
    for node, pattern, kind in _COMPILED[language]:
        for m in pattern.finditer(code):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if start in seen or language not in ("rust", "go") and m["n"] in _NOT_CALLS:
                continue
            open_, semi = code.find("{", m.end() - (1 if m[0].endswith("{") else 0)), code.find(";", m.end())
            if node == "lexical_declaration":
                end = semi + 1 if semi >= 0 and (open_ < 0 or semi < open_) else _close(code, open_) if open_ >= 0 else len(code)
                line = code.find("\n", m.end())
                if line >= 0 and (open_ < 0 or open_ > line) and (semi < 0 or semi > line):
                    end = line
                arrow = re.compile(r"\s*(?:async\s*)?(?:\([^{}]*?\)[^={]*|[\w$]+\s*)=>").match(code, m.end())
                kind_here = "function" if arrow else None
                found.append(Def(m["n"], "arrow_function" if arrow else node, start, end, kind_here, body=open_))
            else:
                if semi >= 0 and (open_ < 0 or semi < open_):
                    end, body = semi + 1, semi
                else:
                    end, body = (_close(code, open_), open_) if open_ >= 0 else (len(code), len(code))
                if node in ("constructor_declaration",) and m["n"] in ("class",):
                    continue
                found.append(Def(m["n"].split("::")[-1], node, start, end, kind, body=body))
            seen.add(start)
    return sorted(found, key=lambda d: (d.start, -d.end))


_RUBY_OPEN = re.compile(r"^[ \t]*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:[ \t]*\|[^|]*\|)?[ \t]*$|=[ \t]*(?:if|unless|case|begin)\b")
_RUBY_DEF = re.compile(r"^[ \t]*(class|module|def)[ \t]+(self\.)?([A-Za-z_][\w:]*[?!=]?)")


def _ruby(text: str) -> list[Def]:
    code, found, stack, at = blanked(text, "ruby"), [], [], 0
    for line in code.splitlines(keepends=True):
        if m := _RUBY_DEF.match(line):
            node = {"class": "class", "module": "module", "def": "singleton_method" if m[2] else "method"}[m[1]]
            d = Def(m[3].split("::")[-1], node, at + len(line) - len(line.lstrip()), len(text), {"class": "class", "module": "module"}.get(m[1], "method"), body=at + len(line))
            found.append(d)
            stack.append(d)
        elif _RUBY_OPEN.search(line) and not re.search(r"\bend\b", line):
            stack.append(None)
        if re.match(r"^[ \t]*end\b", line) and stack:
            d = stack.pop()
            if d:
                d.end = at + len(line.rstrip())
        at += len(line)
    return found


def _python(text: str) -> tuple[list[Def], list[tuple[str, int, int]]]:
    """(definitions, calls as (name, line, offset)); raises SyntaxError."""
    tree = ast.parse(text)
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    encoded = text.isascii()
    rows = text.splitlines(keepends=True)

    def at(line: int, col: int) -> int:
        return starts[line - 1] + (col if encoded else len(rows[line - 1].encode()[:col].decode(errors="ignore")))

    found, calls = [], []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            end = at(node.end_lineno, node.end_col_offset)
            is_class = isinstance(node, ast.ClassDef)
            start = at(node.lineno, node.col_offset)
            if node.decorator_list:
                first = min(node.decorator_list, key=lambda d: (d.lineno, d.col_offset))
                outer = text.rfind("@", 0, at(first.lineno, first.col_offset) + 1)
                found.append(Def(node.name, "decorated_definition", outer, end))
            found.append(Def(node.name, "class_definition" if is_class else "function_definition", start, end, "class" if is_class else "function", body=at(node.body[0].lineno, node.body[0].col_offset)))
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                calls.append((name, node.lineno, at(node.lineno, node.col_offset)))
    return sorted(found, key=lambda d: (d.start, -d.end)), sorted(calls, key=lambda c: c[2])


def parse(text: str, language: str) -> tuple[list[Def], list[tuple[str, int, int]]]:
    """Definitions in document order, outer ones first, and calls. A tree-sitter parser can be put in its place."""
    if language == "python":
        found, calls = _python(text)
    else:
        found = _ruby(text) if language == "ruby" else _braced(text, language)
        code = blanked(text, language)
        names_at = {text.find(d.name, d.start, d.body or d.end) for d in found if d.name}
        calls = [(m[1], code.count("\n", 0, m.start()) + 1, m.start()) for m in _CALL.finditer(code) if m[1] not in _NOT_CALLS and m.start(1) not in names_at]
    for d in found:
        outer = [o for o in found if o.is_scope and o.kind and o.start <= d.start and o.end >= d.end and o is not d]
        d.scope = outer[-1].name if outer else None
        if language == "go" and d.node == "method_declaration" and (m := re.match(r"func\s*\(\s*\w*\s*\*?\s*(\w+)", text[d.start :])):
            d.scope = m[1]
    return found, calls


# The names of Python's top-level statements where they are not the tree's own name.
_PYTHON_KINDS = {"ImportFrom": "import_from_statement", "Expr": "expression_statement", "Assign": "expression_statement", "AugAssign": "expression_statement", "AnnAssign": "expression_statement"}


def _top_level(text: str, language: str) -> list[tuple[str, str | None, str, int, int]]:
    """The parts of a source that defines nothing: top-level statements, of LEAST_BYTES or more, without a symbol.

    Python's come from its syntax tree under its names for them. In the other
    languages a statement is a run of lines that ends where no bracket is open,
    at a semicolon, a closing brace or, in Ruby and Go, a line's end.
    """
    parts = []
    if language == "python":
        starts = [0]
        for line in text.encode().splitlines(keepends=True):
            starts.append(starts[-1] + len(line))
        raw = text.encode()
        for node in ast.parse(text).body:
            a, z = starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset
            kind = type(node).__name__
            parts.append((raw[a:z].decode(), _PYTHON_KINDS.get(kind, f"{kind.lower()}_statement"), node.lineno, node.end_lineno))
    else:
        ends = re.compile(r"[\])\w\"'`}]\s*$" if language in ("ruby", "go") else r"[;}]\s*$")
        depth, first, held = 0, 0, []
        lines, code = text.split("\n"), blanked(text, language).split("\n")
        for i, (line, bare) in enumerate(zip(lines, code)):
            if not held and not line.strip():
                continue
            first = first if held else i
            held.append(line)
            depth += sum(bare.count(c) for c in "([{") - sum(bare.count(c) for c in ")]}")
            if language == "ruby":
                depth += (bool(_RUBY_OPEN.search(bare)) and not re.search(r"\bend\b", bare)) - bool(re.match(r"\s*end\b", bare))
            if depth <= 0 and (ends.search(bare) or i + 1 == len(lines)) or i + 1 == len(lines):
                parts.append(("\n".join(held).strip(), "statement", first + 1, i + 1))
                depth, held = 0, []
    return [(c, None, kind, a, z) for c, kind, a, z in parts if c.strip() and len(c.encode("utf-8", "surrogatepass")) >= LEAST_BYTES]


def chunk_source(text: str, language: str) -> list[tuple[str, str | None, str, int, int]]:
    """(content, symbol, node kind, first line, last line) of definitions of LEAST_BYTES or more, nested ones too; if there are none, of top-level statements."""
    found, _ = parse(text, language)
    rows = []
    for d in found:
        content = text[d.start : d.end]
        exported = language in ("javascript", "typescript") and content.startswith("export")
        if content.strip() and len(content.encode("utf-8", "surrogatepass")) >= LEAST_BYTES:
            first = text.count("\n", 0, d.start) + 1
            rows.append((content, d.name, "export_statement" if exported else d.node, first, first + content.count("\n")))
    return rows or _top_level(text, language)


def call_graph(text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    """(definitions (name, kind, scope, first line, last line, signature), calls (caller, caller scope, callee, line))."""
    found, calls = parse(text, language)
    rows = []
    defined = [d for d in found if d.kind]
    for d in defined:
        head = text[d.start : d.end].split("{", 1)[0].strip() if language not in ("python", "ruby") else text[d.start : d.end].split("\n", 1)[0].strip()
        first = text.count("\n", 0, d.start) + 1
        rows.append((d.name, d.kind, d.scope, first, first + text[d.start : d.end].count("\n"), head if len(head.encode()) < SIGNATURE_BYTES else None))
    edges = []
    for name, line, at in calls:
        around = [d for d in defined if d.start <= at < d.end]
        caller = around[-1] if around else None
        edges.append((caller.name if caller else None, caller.scope if caller else None, name, line))
    return rows, edges


def chunk_syntax(files: DataFrame) -> DataFrame:
    """Definition chunks of files(file_id, content, language) in parsed languages; none where nothing is found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, content, language in zip(pdf["file_id"], pdf["content"], pdf["language"]):
                try:
                    got = chunk_source(content or "", language)
                except (SyntaxError, ValueError, RecursionError):
                    got = []
                rows += [(file_id, k, c, s, kind, a, z) for k, (c, s, kind, a, z) in enumerate(got)]
            yield pd.DataFrame(rows, columns=CHUNK_COLUMNS)

    return files.where(F.col("language").isin(*PARSED)).select(F.col("file_id").cast("long"), "content", "language").mapInPandas(run, CHUNK_SCHEMA)


def chunk_files(files: DataFrame) -> DataFrame:
    """The router: configuration files by their chunkers, parsed languages by definitions or else lines, all others by lines."""
    config = {"env": chunk_env, "toml": chunk_toml, "yaml": chunk_yaml, "json": chunk_json}
    parts = [config[c](files.where(F.col("language") == c)) for c in CONFIGURATION]
    syntax = chunk_syntax(files)
    plain = files.where(~F.col("language").isin(*CONFIGURATION)).join(syntax.select("file_id").distinct(), "file_id", "left_anti")
    out = syntax.unionByName(chunk_by_lines(plain))
    for p in parts:
        out = out.unionByName(p)
    return out


DEFINITIONS = "file_id long, name string, kind string, scope string, start_line int, end_line int, signature string"
CALLS = "file_id long, caller_name string, caller_scope string, callee_name string, line_number int"


def extract_call_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions, calls) of files(file_id, content, language), each distinct, from one pass with both as rows."""
    both = f"is_def boolean, {DEFINITIONS}, caller_name string, caller_scope string, callee_name string, line_number int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, content, language in zip(pdf["file_id"], pdf["content"], pdf["language"]):
                try:
                    d, c = call_graph(content or "", language)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [(True, file_id, *x, None, None, None, None) for x in d]
                rows += [(False, file_id, None, None, None, None, None, None, *x) for x in c]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in both.split(", ")])
            yield out.astype({c: "Int32" for c in ("start_line", "end_line", "line_number")})

    rows = files.where(F.col("language").isin(*PARSED)).select(F.col("file_id").cast("long"), "content", "language").mapInPandas(run, both)
    keys = ["file_id", "name", "scope", "start_line"]
    definitions = rows.where("is_def").select(*[x.split()[0] for x in DEFINITIONS.split(", ")]).dropDuplicates(keys)
    calls = rows.where("NOT is_def").select(*[x.split()[0] for x in CALLS.split(", ")])
    return definitions, calls
