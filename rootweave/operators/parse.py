"""Symbols, chunks and raw edges of source files: one Python function a file, run in Arrow batches.

Python is parsed with the standard library; other languages by declaration patterns and balanced blocks.
A file that can't be parsed still gets line windows, and says so.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.functions import paths as P

CONTAINERS = {"class", "struct", "interface", "trait", "impl", "enum", "record"}
BRACES = set("c cpp csharp go java javascript kotlin php rust typescript".split())
_ID = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|pub(?:\([^)]*\))?|override|virtual|sealed|open|data|suspend|inline|unsafe|const|synchronized|readonly|partial|extern)\s+)*"
#: Declarations by language: (pattern with the name as its group, kind).
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "javascript": [(rf"^\s*{_MODS}class\s+({_ID})", "class"), (rf"^\s*{_MODS}function\s*\*?\s*({_ID})\s*\(", "function"), (rf"^\s*{_MODS}(?:const|let|var)\s+({_ID})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*=>", "function"), (rf"^\s*{_MODS}(?:const|let|var)\s+({_ID})\s*=\s*(?:async\s+)?function\b", "function"), (rf"^\s+{_MODS}(?:get\s+|set\s+)?({_ID})\s*\([^;]*\)\s*(?::\s*[^{{;]+)?\{{", "method")],
    "go": [(rf"^func\s+({_ID})\s*[\(\[]", "function"), (rf"^func\s+\([^)]*\)\s*({_ID})\s*\(", "method"), (rf"^\s*(?:type\s+)?({_ID})\s+struct\b", "struct"), (rf"^\s*(?:type\s+)?({_ID})\s+interface\b", "interface"), (rf"^type\s+({_ID})\s+(?!struct\b|interface\b)", "type")],
    "java": [(rf"^\s*{_MODS}class\s+({_ID})", "class"), (rf"^\s*{_MODS}interface\s+({_ID})", "interface"), (rf"^\s*{_MODS}enum\s+({_ID})", "enum"), (rf"^\s*{_MODS}record\s+({_ID})", "record"), (rf"^\s*{_MODS}(?!return\b|new\b|else\b|throw\b)(?:<[^>]+>\s*)?[\w<>\[\],.?]+\s+({_ID})\s*\([^;]*\)\s*(?:throws\s+[\w,.\s]+)?(?:\{{|;)", "method"), (rf"^\s*(?:public|private|protected)\s+({_ID})\s*\([^;]*\)\s*(?:throws\s+[\w,.\s]+)?\{{", "method")],
    "rust": [(rf"^\s*{_MODS}fn\s+({_ID})", "function"), (rf"^\s*{_MODS}struct\s+({_ID})", "struct"), (rf"^\s*{_MODS}enum\s+({_ID})", "enum"), (rf"^\s*{_MODS}trait\s+({_ID})", "trait"), (rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?({_ID})", "impl"), (rf"^\s*{_MODS}mod\s+({_ID})", "module")],
    "c": [(rf"^(?!return\b|else\b|typedef\b)[\w*\s]+?\b({_ID})\s*\([^;]*\)\s*\{{", "function"), (rf"^\s*(?:typedef\s+)?struct\s+({_ID})\s*\{{", "struct"), (rf"^\s*enum\s+({_ID})\s*\{{", "enum")],
    "cpp": [(rf"^\s*class\s+({_ID})", "class"), (rf"^\s*struct\s+({_ID})", "struct"), (rf"^\s*namespace\s+({_ID})", "module"), (rf"^\s*enum\s+(?:class\s+)?({_ID})", "enum"), (rf"^\s*(?!return\b|else\b)[\w:<>*&~\s]+?\b({_ID})\s*\([^;]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{", "function")],
    "csharp": [(rf"^\s*{_MODS}class\s+({_ID})", "class"), (rf"^\s*{_MODS}interface\s+({_ID})", "interface"), (rf"^\s*{_MODS}struct\s+({_ID})", "struct"), (rf"^\s*{_MODS}enum\s+({_ID})", "enum"), (rf"^\s*namespace\s+([\w.]+)", "module"), (rf"^\s*{_MODS}(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.?]+\s+({_ID})\s*\([^;]*\)\s*(?:\{{|=>|$)", "method"), (rf"^\s*(?:public|private|protected|internal)\s+({_ID})\s*\([^;]*\)\s*\{{?", "method")],
    "ruby": [(r"^\s*class\s+([A-Z]\w*)", "class"), (r"^\s*module\s+([A-Z]\w*)", "module"), (r"^\s*def\s+(?:self\.)?(\w+[?!=]?)", "method")],
    "php": [(rf"^\s*{_MODS}class\s+({_ID})", "class"), (rf"^\s*interface\s+({_ID})", "interface"), (rf"^\s*trait\s+({_ID})", "trait"), (rf"^\s*{_MODS}function\s+&?({_ID})\s*\(", "function")],
    "kotlin": [(rf"^\s*{_MODS}(?:enum\s+)?class\s+({_ID})", "class"), (rf"^\s*{_MODS}object\s+({_ID})", "class"), (rf"^\s*{_MODS}interface\s+({_ID})", "class"), (rf"^\s*{_MODS}fun\s+(?:<[^>]+>\s*)?(?:{_ID}\.)?({_ID})\s*\(", "function")],
    "lua": [(rf"^\s*(?:local\s+)?function\s+(?:[\w.]+[.:])?({_ID})\s*\(", "function")],
}
DECLARATIONS["typescript"] = [*DECLARATIONS["javascript"], (rf"^\s*{_MODS}interface\s+({_ID})", "interface"), (rf"^\s*{_MODS}enum\s+({_ID})", "enum"), (rf"^\s*{_MODS}type\s+({_ID})\s*(?:<[^>]*>)?\s*=", "type")]
#: Imports by language: the module is the group.
IMPORTS = {
    "javascript": r"^\s*import\s+(?:[^'\"]*\s+from\s+)?['\"]([^'\"]+)['\"]",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;",
    "kotlin": r"^\s*import\s+([\w.]+)",
    "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$",
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:{}, *]+);",
    "c": r"^\s*#\s*include\s*([<\"][^>\"]+[>\"])",
    "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    "php": r"^\s*use\s+([\w\\]+)",
}
IMPORTS["typescript"], IMPORTS["cpp"] = IMPORTS["javascript"], IMPORTS["c"]
EXTENDS = {"java": r"\bextends\s+(\w+)", "typescript": r"class\s+\w+[^{]*\bextends\s+(\w+)", "javascript": r"class\s+\w+\s+extends\s+(\w+)", "ruby": r"class\s+\w+\s*<\s*(\w+)", "php": r"\bextends\s+(\w+)", "cpp": r"(?:class|struct)\s+\w+\s*:\s*(?:public|private|protected)?\s*(\w+)", "csharp": r"class\s+\w+\s*:\s*(\w+)"}
IMPLEMENTS = {"java": r"\bimplements\s+([\w,\s]+)", "typescript": r"\bimplements\s+([\w,\s]+)", "php": r"\bimplements\s+([\w,\s]+)"}
_NOT_CALLS = {"if", "for", "while", "switch", "return", "catch", "function", "fn", "func", "def", "sizeof", "match", "elif", "else", "do", "and", "or", "not", "in", "with", "assert", "super", "fun", "when"}
_QUOTE = "[\"']"
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "function"}
_CALL = re.compile(rf"(?<![\w$])({_ID})(!?)\s*\(")


def line_windows(rows: list[str], size: int, overlap: int, first: int = 1) -> Iterator[tuple[int, int, str]]:
    """(line_start, line_end, content) of overlapping windows; the last ends with the rows."""
    step = size - min(overlap, size - 1)
    for lo in range(0, len(rows), step):
        hi = min(lo + size, len(rows))
        yield first + lo, first + hi - 1, "\n".join(rows[lo:hi])
        if hi == len(rows):
            return


def estimate(text: str) -> int:
    """T.token_estimate() of one text."""
    quarter = len(text) / 4
    return round(quarter) or 1


def _signature(row: str) -> str:
    return row.strip().rstrip("{").rstrip()


Found = tuple[list[dict], list[dict]]


def python_symbols(text: str) -> Found:
    tree, rows = ast.parse(text), text.splitlines()
    symbols: list[dict] = []
    edges: list[dict] = []

    def visit(node: ast.AST, parent: int | None) -> None:
        for child in ast.iter_child_nodes(node):
            inside = parent
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                up = symbols[parent] if parent is not None else None
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if up and up["kind"] in CONTAINERS else "function"
                doc = ast.get_docstring(child, clean=False)
                symbols.append({"name": child.name, "qualified": f"{up['qualified']}.{child.name}" if up else child.name, "kind": kind, "line_start": child.lineno, "line_end": child.end_lineno, "signature": _signature(rows[child.lineno - 1]), "docstring": doc, "parent": parent})
                inside = len(symbols) - 1
                if isinstance(child, ast.ClassDef):
                    edges.extend({"type": "extends", "name": b.id, "line": b.lineno, "src": inside} for b in child.bases if isinstance(b, ast.Name))
            elif isinstance(child, ast.Import):
                edges.extend({"type": "import", "name": a.name, "line": child.lineno, "src": None} for a in child.names)
            elif isinstance(child, ast.ImportFrom) and child.module and not child.level:
                edges.append({"type": "import", "name": child.module, "line": child.lineno, "src": None})
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    edges.append({"type": "call", "name": name, "line": child.lineno, "src": parent})
            visit(child, inside)

    visit(tree, None)
    return symbols, edges


def _block_end(rows: list[str], at: int, lang: str) -> int:
    """The last row (0-based) of the block that the declaration at a row opens."""
    if lang in ("ruby", "lua"):
        indent = len(rows[at]) - len(rows[at].lstrip())
        for k in range(at, len(rows)):
            if (k > at and len(rows[k]) - len(rows[k].lstrip()) <= indent or k == at) and re.search(r"\bend\b", rows[k]):
                return k
        return at
    depth = 0
    for k in range(at, len(rows)):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", rows[k])
        opened = depth > 0
        for c in bare:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    return k
            elif c == ";" and not depth and not opened:
                return k
        if not depth and not opened and k - at >= 5:
            return at
    return at if not depth else len(rows) - 1


#: A definition of a language without patterns of its own: modifiers, a keyword and a name.
GENERIC = [(rf"^\s*{_MODS}(?:[a-z]+\s+)?(class|struct|enum|interface|trait|module|namespace|protocol|object|function|func|fun|fn|def|sub|proc|procedure|method)\s+(?:[\w.]+[.:])?({_ID})", 2)]


def generic_kind(word: str) -> str:
    """The kind that a definition's keyword (or a syntax node's type) names; a function where it names none."""
    low = word.lower()
    return next((k for k in ("class", "struct", "enum", "interface", "trait", "module", "namespace") if k in low), "function")


def register(lang: str, declarations: list[tuple[str, str]], imports: str | None = None, extends: str | None = None, implements: str | None = None, braces: bool = False) -> None:
    """Adds a language, or replaces its patterns: declarations as (pattern with the name as its group, kind)."""
    for table, pattern in ((IMPORTS, imports), (EXTENDS, extends), (IMPLEMENTS, implements)):
        if pattern:
            table[lang] = pattern
    DECLARATIONS[lang] = list(declarations)
    if braces:
        BRACES.add(lang)


def _declared(row: str, lang: str) -> tuple[str, str] | None:
    """(name, kind) of what a row declares."""
    if lang in DECLARATIONS:
        found = ((m.group(1), kind) for pattern, kind in DECLARATIONS[lang] if (m := re.match(pattern, row)))
    else:
        found = ((m.group(name), generic_kind(m.group(1))) for pattern, name in GENERIC if (m := re.match(pattern, row)))
    return next(((n, k) for n, k in found if n not in _NOT_NAMES), None)


def pattern_symbols(text: str, lang: str) -> Found:
    """Symbols and edges by a language's patterns; a language without any gets generic definitions and no import or inheritance edges."""
    rows = text.splitlines()
    found: list[dict] = []
    for at, row in enumerate(rows):
        if hit := _declared(row, lang):
            name, kind = hit
            found.append({"name": name, "kind": kind, "line_start": at + 1, "line_end": _block_end(rows, at, lang) + 1, "signature": _signature(row), "docstring": None})
    open_: list[int] = []
    for k, s in enumerate(found):
        while open_ and found[open_[-1]]["line_end"] < s["line_end"]:
            open_.pop()
        while open_ and found[open_[-1]]["line_end"] < s["line_start"]:
            open_.pop()
        s["parent"] = open_[-1] if open_ else None
        up = found[open_[-1]] if open_ else None
        if up and s["kind"] == "function" and up["kind"] in CONTAINERS:
            s["kind"] = "method"
        s["qualified"] = f"{up['qualified']}.{s['name']}" if up else s["name"]
        open_.append(k)
    named = {(s["line_start"], s["name"]) for s in found}
    edges: list[dict] = []
    go_block = False
    for at, row in enumerate(rows, 1):
        owner = enclosing(found, at)
        go_block = (go_block or row.startswith("import (")) and row.strip() != ")"
        if (p := IMPORTS.get(lang)) and (m := re.match(p, row)) and (lang != "go" or go_block or row.startswith("import")):
            edges.append({"type": "import", "name": m.group(1).strip("<>\"'").strip(), "line": at, "src": None})
            continue
        if (p := EXTENDS.get(lang)) and (m := re.search(p, row)):
            edges.append({"type": "extends", "name": m.group(1), "line": at, "src": owner})
        if (p := IMPLEMENTS.get(lang)) and (m := re.search(p, row)):
            edges.extend({"type": "implements", "name": n.strip(), "line": at, "src": owner} for n in m.group(1).split(",") if n.strip())
        for m in _CALL.finditer(row):
            if m.group(1) not in _NOT_CALLS and (at, m.group(1)) not in named:
                edges.append({"type": "call", "name": m.group(1), "line": at, "src": owner})
    return found, edges


def enclosing(symbols: list[dict], line: int) -> int | None:
    """The innermost symbol around a line, the first of equally narrow ones."""
    around = [(s["line_end"] - s["line_start"], k) for k, s in enumerate(symbols) if s["line_start"] <= line <= s["line_end"]]
    return min(around)[1] if around else None


def code_chunks(text: str, symbols: list[dict]) -> list[dict]:
    """Top-level symbols' bodies, windows of the gaps between them, or windows of the whole without symbols."""
    if not text.strip():
        return []
    rows = text.splitlines()
    make = lambda lo, hi, body, kind, k=None: {"line_start": lo, "line_end": hi, "content": body, "token_est": estimate(body), "kind": kind, "symbol": k}
    if not symbols:
        return [make(*w, "window") for w in line_windows(rows, 80, 10)]
    out: list[dict] = []
    free = 1

    def gap(lo: int, hi: int) -> None:
        part = rows[lo - 1 : hi]
        if "".join(part).strip():
            out.extend(make(*w, "window") for w in line_windows(part, 80, 0, lo))

    for k in sorted((k for k, s in enumerate(symbols) if s["parent"] is None), key=lambda k: symbols[k]["line_start"]):
        s = symbols[k]
        if s["line_start"] > free:
            gap(free, s["line_start"] - 1)
        out.append(make(s["line_start"], s["line_end"], "\n".join(rows[s["line_start"] - 1 : s["line_end"]]), "symbol_body", k))
        free = max(free, s["line_end"] + 1)
    if free <= len(rows):
        gap(free, len(rows))
    return out


def flatten_json(value: object, at: str = "") -> Iterator[tuple[str, object]]:
    """(path, scalar) of every scalar in a JSON value."""
    pairs = ((f"{at}.{k}" if at else k, v) for k, v in value.items()) if isinstance(value, dict) else ((f"{at}[{i}]", v) for i, v in enumerate(value)) if isinstance(value, list) else ()
    for path, v in pairs:
        if isinstance(v, (dict, list)):
            yield from flatten_json(v, path)
        else:
            yield path, v


def doc_chunks(text: str, path: str, lang: str | None) -> list[dict]:
    """Headings and sections, test names, docstrings, exception messages and config keys as chunks of kind doc."""
    out: list[dict] = []

    def add(begin: int, end: int, content: str, measured: str | None = None) -> None:
        out.append({"line_start": text.count("\n", 0, begin) + 1, "line_end": text.count("\n", 0, end) + 1, "content": content, "token_est": max(1, len(measured or content) // 4), "kind": "doc", "symbol": None})

    if lang == "markdown":
        heads = list(re.finditer(r"^#{1,6}\s+.+$", text, re.MULTILINE))
        for h in heads:
            add(h.start(), h.start(), h.group().strip())
        for h, after in zip(heads, [*(x.start() for x in heads[1:]), len(text)]):
            if body := text[h.end() : after].strip()[:200]:
                add(h.start(), h.end() + len(body), f"{h.group().strip()}: {body}")
    elif lang == "python" or path.endswith(".py"):
        for m in re.finditer(r"\bdef\s+(test_\w+)\s*[(]", text):
            add(m.start(), m.start(), f"test function: {m.group(1)}", m.group(1))
        for m in re.finditer(r"(?s)(?:class|def)\s+\w+.*?(\"{3}.*?\"{3})", text):
            if len(doc := m.group(1).strip('"').strip()) > 10:
                add(m.start(), m.end(), doc[:500], doc)
        for m in re.finditer(rf"raise\s+\w+\s*[(]\s*{_QUOTE}(.+?){_QUOTE}", text):
            add(m.start(), m.start(), f"exception: {m.group(1)}", m.group(1))
    elif lang == "json":
        try:
            for key, value in flatten_json(json.loads(text)):
                shown = str(value)
                add(0, 0, f"config key: {key} = {shown if len(shown) <= 100 else shown[:100] + '...'}")
        except ValueError:
            pass
    elif lang == "toml":
        for m in re.finditer(r"(?m)^([.\w]+)\s*=", text):
            add(m.start(), m.start(), f"config key: {m.group(1)}")
    return out


def parse_text(path: str, lang: str | None, text: str) -> dict:
    """Symbols, edges and chunks of one file; failed says that only line windows could be made."""
    symbols: list[dict] = []
    edges: list[dict] = []
    failed = False
    try:
        if lang == "python":
            symbols, edges = python_symbols(text)
        elif lang in DECLARATIONS or (lang in P.CODE):
            symbols, edges = pattern_symbols(text, lang)
    except (SyntaxError, ValueError, RecursionError):
        failed = True
    chunks = code_chunks(text, symbols) + doc_chunks(text, path, lang)
    return {"symbols": symbols, "edges": edges, "chunks": chunks, "parse_failed": failed, "zero_symbols": lang in ("python", *DECLARATIONS, *P.CODE) and not symbols and not failed}


_SYMBOL = "struct<name:string,qualified:string,kind:string,line_start:int,line_end:int,signature:string,docstring:string,parent:int>"
_EDGE = "struct<type:string,name:string,line:int,src:int>"
_CHUNK = "struct<line_start:int,line_end:int,content:string,token_est:int,kind:string,symbol:int>"


def parse(files: DataFrame) -> DataFrame:
    """files (file_id, path, lang, content) with their symbols, edges and chunks as nested arrays, one row a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parsed = [parse_text(p, lang, t or "") for p, lang, t in zip(pdf["path"], pdf["lang"], pdf["content"])]
            yield pd.DataFrame({"file_id": pdf["file_id"], "path": pdf["path"], **{k: pd.Series([x[k] for x in parsed], index=pdf.index, dtype=object if k in ("symbols", "edges", "chunks") else bool) for k in ("symbols", "edges", "chunks", "parse_failed", "zero_symbols")}})

    schema = f"file_id long, path string, symbols array<{_SYMBOL}>, edges array<{_EDGE}>, chunks array<{_CHUNK}>, parse_failed boolean, zero_symbols boolean"
    return files.select("file_id", "path", "lang", "content").mapInPandas(run, schema)


def symbol_key(s: Column) -> Column:
    return F.xxhash64("path", s["name"], s["line_start"], s["kind"])


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The symbols, chunks and edges_raw tables of parsed files, with ids that are hashes of content."""
    up = lambda s: F.when(s["parent"].isNotNull(), symbol_key(F.get("symbols", s["parent"])))
    symbols = parsed.select("file_id", "path", "symbols", F.explode("symbols").alias("s"))
    symbols = symbols.select(symbol_key(F.col("s")).alias("symbol_id"), "file_id", "path", "s.kind", "s.name", "s.qualified", "s.signature", "s.line_start", "s.line_end", up(F.col("s")).alias("parent_id"), "s.docstring")
    chunks = parsed.select("file_id", "path", "symbols", F.posexplode("chunks").alias("n", "c"))
    own = F.get("symbols", F.col("c.symbol"))
    chunks = chunks.select(
        F.xxhash64("path", "n", "c.line_start", "c.line_end", "c.kind").alias("chunk_id"), "file_id", "path", "c.line_start", "c.line_end", "c.kind",
        F.when(F.col("c.symbol").isNotNull(), symbol_key(own)).alias("symbol_id"), "c.content", "c.token_est", F.coalesce(own["name"], F.lit("")).alias("symbol_names"),
    )
    edges = parsed.select("file_id", "path", "symbols", F.explode("edges").alias("e"))
    src = F.get("symbols", F.col("e.src"))
    edges = edges.select(F.col("e.type").alias("edge_type"), F.when(F.col("e.src").isNull(), "file").otherwise("symbol").alias("src_kind"), F.when(F.col("e.src").isNull(), F.col("file_id")).otherwise(symbol_key(src)).alias("src_id"), F.col("e.name").alias("dst_name"), "file_id", F.col("e.line").alias("line"))
    return {"symbols": symbols, "chunks": chunks, "edges_raw": edges}


def build_stats(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row of totals of a build."""
    return files.join(parsed, "file_id").agg(
        F.count("*").alias("indexed"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        *[F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c) for c in ("chunks", "symbols", "edges")],
        F.count_if("parse_failed").alias("failures"), F.count_if("zero_symbols").alias("zero_symbol_files"),
    )
