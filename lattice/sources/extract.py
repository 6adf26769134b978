"""Symbols, containment and references of one source text.

Python is parsed; other languages go through one scanner that masks strings and comments, follows braces, and applies a table of patterns for each language."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

EXTENSIONS = {
    "rs": "rust", "go": "go", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "svelte": "svelte", "vue": "vue", "py": "python", "pyi": "python", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp", "php": "php", "rb": "ruby",
    "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala", "dart": "dart", "lua": "lua", "luau": "luau", "m": "objc", "mm": "objc", "pas": "pascal", "dpr": "pascal", "dpk": "pascal", "lpr": "pascal",
}
#: Languages that share a grammar with arrows, and what begins a line of comment where it isn't two slashes.
SCRIPTS = ("typescript", "javascript", "svelte", "vue")
COMMENTS = {"python": ("#",), "ruby": ("#",), "php": ("//", "#"), "lua": ("--",), "luau": ("--",)}
SIGNATURE, DOCSTRING, PREVIEW, PREVIEW_LINES = 300, 800, 1200, 24


def signature(source: str, language: str) -> str:
    """A declaration up to its body, on one line: to the first brace or semicolon; TypeScript and JavaScript also to the arrow; Rust without comments and attributes before it."""
    if language == "rust":
        lines = source.split("\n")
        while lines and (not lines[0].strip() or lines[0].strip().startswith(("///", "//!", "#["))):
            lines.pop(0)
        source = " ".join(lines)
    elif language in SCRIPTS:
        source = source.split("=>", 1)[0]
    return " ".join(source.split("{", 1)[0].split(";", 1)[0].split())[:SIGNATURE]


def _lines_above(before: str, prefixes: tuple[str, ...], passed: str | None = None) -> list[str]:
    """The unbroken lines with a prefix just above, without it; what stands before the declaration on its own line breaks them. Lines that begin with `passed` may stand between."""
    out: list[str] = []
    for line in reversed(before.splitlines()):
        line = line.strip()
        prefix = next((p for p in prefixes if line.startswith(p)), None)
        if prefix is not None:
            out.append(line.removeprefix(prefix).strip())
        elif not (passed and not out and line.startswith(passed)):
            break
    return out[::-1]


def docstring(text: str, start: int, end: int, language: str) -> str | None:
    """The comment that documents the declaration at start, by the language's own rule."""
    before = text[:start]
    if language == "rust":
        lines = _lines_above(before, ("///", "//!"), "#[")
        lines = lines[len(lines) - next((i for i, x in enumerate(reversed(lines)) if not x), len(lines)) :]  # an empty comment line ends it
        if not lines:
            for line in map(str.strip, text[start:end].split("\n")):
                if line.startswith(("///", "//!")) and line[3:].strip():
                    lines.append(line[3:].strip())
                elif line and not line.startswith("#["):
                    break
    elif language in SCRIPTS and before.rstrip().endswith("*/"):
        body = before.rstrip()[:-2].rpartition("/*")[2] if "/*" in before else ""
        lines = [x for x in (line.strip().lstrip("*").strip() for line in body.split("\n")) if x]
    else:
        lines = _lines_above(before, COMMENTS.get(language, ("//",)))
    return "\n".join(lines).strip()[:DOCSTRING] or None


def language_of(path: str) -> str | None:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None


@dataclass
class Extraction:
    status: str = "ok"
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)


class Builder:
    """Collects a file's rows; keys hold the kind, the qualified name and how often that came before, never a position."""

    def __init__(self, path: str, language: str, scope: list[str], text: str) -> None:
        self.path, self.language, self.text, self.raw = path, language, text, text.encode()
        self.out, self.seen = Extraction(), {}
        self.lines = [0]
        for line in self.raw.splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))
        self.bytes_at = None if text.isascii() else [0]
        if self.bytes_at is not None:
            for ch in text:
                self.bytes_at.append(self.bytes_at[-1] + len(ch.encode()))
        self.scope = scope
        self.file = f"file:{path}"
        self.out.nodes.append(self._row(self.file, path.rsplit("/", 1)[-1], "::".join(scope), "file", None, 0, len(text), None, None, None))

    def offset(self, at: int) -> int:
        return at if self.bytes_at is None else self.bytes_at[at]

    def span(self, start: int, end: int) -> dict:
        import bisect

        a, b = self.offset(start), self.offset(end)
        la, lb = (bisect.bisect_right(self.lines, x) - 1 for x in (a, b))
        return {"start_byte": a, "end_byte": b, "start_line": la + 1, "start_column": a - self.lines[la], "end_line": lb + 1, "end_column": b - self.lines[lb]}

    def _row(self, key, name, qualified, kind, raw_kind, start, end, signature, docstring, preview) -> dict:
        return {"stable_key": key, "name": name, "qualified_name": qualified, "kind": kind, "raw_kind": raw_kind, "language": self.language, "file_path": self.path, **self.span(start, end), "signature": signature, "docstring": docstring, "source_preview": preview}

    def symbol(self, kind: str, name: str, within: list[str], start: int, end: int, parent: str, raw_kind: str | None = None, docstring: str | None = None) -> str:
        qualified = "::".join(x for x in (*self.scope, *within, name) if x)
        n = self.seen[kind, qualified] = self.seen.get((kind, qualified), -1) + 1
        key = f"symbol:{self.path}:{kind}:{qualified}#{n}"
        source = self.text[start:end]
        lines = [line.rstrip() for line in source.split("\n")]
        while lines and not lines[0]:
            lines.pop(0)
        preview = "\n".join(lines[:PREVIEW_LINES]).strip()[:PREVIEW]
        header = signature(source, self.language)
        self.out.nodes.append(self._row(key, name, qualified, kind, raw_kind, start, end, header or None, (docstring or "").strip()[:DOCSTRING] or None, preview or None))
        self.out.edges.append({"source_key": parent, "target_key": key, "kind": "contains"})
        return key

    def reference(self, source: str, kind: str, hint: str, path: list[str], qualifier: str | None, start: int, end: int) -> None:
        path = [p for p in (x.strip().removeprefix("r#").rstrip("!;") for x in path) if p]
        if path:
            self.out.references.append({"source_key": source, "raw": "::".join(path), "path": path, "qualifier": qualifier or None, "kind_hint": hint, "kind": kind, "file_path": self.path, **self.span(start, end), "text": self.text[start:end][:SIGNATURE]})


def _python(b: Builder) -> None:
    starts, text = [0], b.text
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    raw_lines = text.splitlines(keepends=True)

    def at(line: int, column: int) -> int:
        return starts[line - 1] + len(raw_lines[line - 1].encode()[:column].decode(errors="ignore")) if line <= len(raw_lines) else len(text)

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        b.out.status = "partial"
        stack: list[tuple[int, str, str]] = []
        for m in re.finditer(r"(?m)^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)[^\n]*", text):
            depth = len(m[1].expandtabs())
            while stack and stack[-1][0] >= depth:
                stack.pop()
            key = b.symbol("class" if m[2] == "class" else "function", m[3], [s[1] for s in stack], m.start(2), m.end(), stack[-1][2] if stack else b.file)
            stack.append((depth, m[3], key))
        return

    def names(node: ast.expr) -> list[str]:
        if isinstance(node, ast.Name):
            return [node.id]
        if isinstance(node, ast.Attribute):
            head = names(node.value)
            return [*head, node.attr] if head else [node.attr]
        return []

    def visit(node: ast.AST, within: list[str], parent: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                key = b.symbol(kind, child.name, within, at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset), parent, docstring=docstring(text, at(child.lineno, child.col_offset), 0, "python"))
                visit(child, [*within, child.name], key)
                continue
            if isinstance(child, ast.Call):
                path = names(child.func)
                if path:
                    qualifier = path[-2] if len(path) > 1 else None
                    if qualifier in ("self", "cls") and within:
                        qualifier = within[-2] if len(within) > 1 else within[-1]
                    b.reference(parent, "calls", "function", path[-1:], qualifier, at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset))
            elif isinstance(child, ast.Import | ast.ImportFrom):
                base = (child.module or "").split(".") if isinstance(child, ast.ImportFrom) else []
                for a in child.names:
                    path = [x for x in (*base, *a.name.split(".")) if x and x != "*"]
                    b.reference(parent, "imports", "import_glob" if a.name == "*" else "import", path, "::".join(path[:-1]), at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset))
            visit(child, within, parent)

    visit(tree, [], b.file)


#: Marks of comments and strings: line, block open and close, string quotes.
_C = ("//", "/*", "*/", "\"'`")
MARKS = {"ruby": ("#", "=begin", "=end", "\"'"), "lua": ("--", "--[[", "]]", "\"'"), "luau": ("--", "--[[", "]]", "\"'"), "pascal": ("//", "{", "}", "'"), "rust": ("//", "/*", "*/", '"'), "php": ("//", "/*", "*/", "\"'")}


def mask(text: str, language: str) -> tuple[str, bool]:
    """The text with comments and string contents blanked, of the same length; and whether all were closed."""
    line, opens, closes, quotes = MARKS.get(language, _C)
    out, i, n, clean = [], 0, len(text), True
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    while i < n:
        if opens and text.startswith(opens, i):
            depth, j = 1, i + len(opens)
            while j < n and depth:
                if language == "rust" and text.startswith(opens, j):
                    depth, j = depth + 1, j + len(opens)
                elif text.startswith(closes, j):
                    depth, j = depth - 1, j + len(closes)
                else:
                    j += 1
            clean &= not depth
        elif text.startswith(line, i) or (language == "php" and text[i] == "#"):
            j = text.find("\n", i)
            j = n if j < 0 else j
        elif language == "rust" and (m := re.compile(r'b?r(#*)"').match(text, i)) and (not i or not (text[i - 1].isalnum() or text[i - 1] == "_")):
            j = text.find('"' + m[1], m.end())
            clean &= j >= 0
            j = n if j < 0 else j + 1 + len(m[1])
        elif language == "rust" and (m := re.compile(r"b?'(?:\\.[^']*|[^'\\])'").match(text, i)):
            j = m.end()
        elif text[i] in quotes:
            j = i + 1
            while j < n and text[j] != text[i] and (text[j] != "\n" or text[i] in '`"'):
                j += 2 if text[j] == "\\" and language != "pascal" else 1
            clean &= j < n
            j = min(n, j + 1)
        else:
            out.append(text[i])
            i += 1
            continue
        out.append(blank(text[i:j]))
        i = j
    return "".join(out), clean


NAME = r"([A-Za-z_$][\w$]*)"
#: Definitions: kind, raw kind, pattern whose first group is the name.
DEFINITIONS: dict[str, list[tuple[str, str, str]]] = {
    "rust": [("module", "mod", rf"\bmod\s+{NAME}"), ("struct", "struct", rf"\bstruct\s+{NAME}"), ("struct", "union", rf"\bunion\s+{NAME}\s*[<{{]"), ("enum", "enum", rf"\benum\s+{NAME}"), ("trait", "trait", rf"\btrait\s+{NAME}"), ("function", "fn", rf"\bfn\s+{NAME}"), ("constant", "const", rf"\bconst\s+(?!fn\b)(?:mut\s+)?{NAME}\s*:"), ("constant", "static", rf"\bstatic\s+(?:mut\s+)?{NAME}\s*:"), ("type_alias", "type", rf"\btype\s+{NAME}"), ("macro", "macro_rules", rf"\bmacro_rules!\s*{NAME}")],
    "go": [("function", "func", rf"\bfunc\s+{NAME}\s*[(\[]"), ("method", "method", rf"\bfunc\s*\([^)]*\)\s*{NAME}"), ("struct", "struct", rf"\btype\s+{NAME}(?:\[[^\]]*\])?\s+struct\b"), ("interface", "interface", rf"\btype\s+{NAME}(?:\[[^\]]*\])?\s+interface\b"), ("type_alias", "type", rf"\btype\s+{NAME}\s+(?!struct\b|interface\b)=?\s*[\w*\[(]"), ("constant", "const", rf"\bconst\s+{NAME}"), ("variable", "var", rf"\bvar\s+{NAME}")],
    "typescript": [("class", "class", rf"\bclass\s+{NAME}"), ("interface", "interface", rf"\binterface\s+{NAME}"), ("enum", "enum", rf"\benum\s+{NAME}"), ("type_alias", "type", rf"\btype\s+{NAME}\s*(?:<[^=]*>)?\s*="), ("namespace", "namespace", rf"\b(?:namespace|module)\s+{NAME}"), ("function", "function", rf"\bfunction\s*\*?\s*{NAME}"), ("function", "arrow", rf"\b(?:const|let|var)\s+{NAME}\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:\([^()]*\)(?:\s*:\s*[^=\n]+)?|[\w$]+)\s*=>"), ("variable", "variable", rf"\b(?:const|let|var)\s+{NAME}\s*(?::[^=\n]+)?=(?!\s*(?:async\s+)?(?:\([^()]*\)(?:\s*:\s*[^=\n]+)?|[\w$]+)\s*=>)"), ("method", "method", rf"(?m)^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b){NAME}\s*\([^()]*\)\s*(?::\s*[^{{;\n]+)?\s*\{{")],
    "java": [("class", "class", rf"\bclass\s+{NAME}"), ("interface", "interface", rf"\binterface\s+{NAME}"), ("enum", "enum", rf"\benum\s+{NAME}"), ("class", "record", rf"\brecord\s+{NAME}\s*\("), ("method", "method", rf"(?m)^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?!new\b|return\b|else\b|throw\b)[\w<>\[\],.?]+\s+{NAME}\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?[{{;]")],
    "c": [("struct", "struct", rf"\bstruct\s+{NAME}\s*\{{"), ("enum", "enum", rf"\benum\s+{NAME}\s*\{{"), ("type_alias", "typedef", rf"\btypedef\b[^;{{}}]*?\b{NAME}\s*;"), ("macro", "define", rf"(?m)^\s*#\s*define\s+{NAME}"), ("function", "function", rf"(?m)^(?!\s*(?:return|else|typedef)\b)[A-Za-z_][\w\s*]*?[\s*]{NAME}\s*\([^;{{}}()]*\)\s*\{{")],
    "csharp": [("namespace", "namespace", r"\bnamespace\s+([\w.]+)"), ("class", "class", rf"\bclass\s+{NAME}"), ("struct", "struct", rf"\bstruct\s+{NAME}"), ("interface", "interface", rf"\binterface\s+{NAME}"), ("enum", "enum", rf"\benum\s+{NAME}"), ("method", "method", rf"(?m)^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed)\s+)+[\w<>\[\],.?]+\s+{NAME}\s*\([^()]*\)\s*(?:=>|\{{|;)")],
    "php": [("class", "class", rf"\bclass\s+{NAME}"), ("interface", "interface", rf"\binterface\s+{NAME}"), ("trait", "trait", rf"\btrait\s+{NAME}"), ("function", "function", rf"\bfunction\s+&?{NAME}")],
    "ruby": [("class", "class", rf"\bclass\s+{NAME}"), ("module", "module", rf"\bmodule\s+{NAME}"), ("method", "def", r"\bdef\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)")],
    "swift": [("class", "class", rf"\bclass\s+(?!func\b|var\b){NAME}"), ("struct", "struct", rf"\bstruct\s+{NAME}"), ("enum", "enum", rf"\benum\s+{NAME}"), ("interface", "protocol", rf"\bprotocol\s+{NAME}"), ("function", "func", rf"\bfunc\s+{NAME}")],
    "kotlin": [("class", "class", rf"\bclass\s+{NAME}"), ("interface", "interface", rf"\binterface\s+{NAME}"), ("class", "object", rf"\bobject\s+{NAME}"), ("function", "fun", rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{NAME}")],
    "scala": [("class", "class", rf"\bclass\s+{NAME}"), ("trait", "trait", rf"\btrait\s+{NAME}"), ("class", "object", rf"\bobject\s+{NAME}"), ("function", "def", rf"\bdef\s+{NAME}")],
    "dart": [("class", "class", rf"\bclass\s+{NAME}"), ("enum", "enum", rf"\benum\s+{NAME}"), ("function", "function", rf"(?m)^\s*(?:static\s+)?[\w<>?]+\s+{NAME}\s*\([^()]*\)\s*(?:async\s*)?(?:\{{|=>)")],
    "lua": [("function", "function", r"\bfunction\s+(?:[\w.]+[.:])?([A-Za-z_]\w*)")],
    "objc": [("class", "interface", rf"@interface\s+{NAME}"), ("interface", "protocol", rf"@protocol\s+{NAME}"), ("method", "method", r"(?m)^[-+]\s*\([^)]*\)\s*([A-Za-z_]\w*)")],
    "pascal": [("function", "routine", r"(?i)\b(?:procedure|function)\s+(?:\w+\.)?([A-Za-z_]\w*)")],
}
DEFINITIONS |= {"javascript": DEFINITIONS["typescript"], "cpp": [("namespace", "namespace", rf"\bnamespace\s+{NAME}"), ("class", "class", rf"\bclass\s+{NAME}[^;{{]*\{{"), *DEFINITIONS["c"][:-1], ("function", "function", rf"(?m)^(?!\s*(?:return|else|typedef)\b)[ \t]*[A-Za-z_][\w\s*&:<>,]*?[\s*&]~?(?:\w+::)*{NAME}\s*\([^;{{}}()]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{{")], "luau": DEFINITIONS["lua"]}
NO_CALLS = ("dart", "objc", "pascal")
NOT_CALLED = set("if for while switch catch return function fn func def fun sizeof match loop else elif unless new await typeof super struct impl where in and or not class end then do mod pub use let".split())


def _end_of(masked: str, at: int, language: str) -> int:
    """Where the definition that begins before `at` ends: after its braces, or at its semicolon or line end."""
    if language in ("ruby", "lua", "luau"):
        depth = 0
        for m in re.compile(r"\b(function|def|class|module|do|if|unless|while|for|case|begin|repeat|end|until)\b").finditer(masked, masked.rfind("\n", 0, at) + 1):
            if m[1] in ("end", "until"):
                depth -= 1
                if depth <= 0:
                    return m.end()
            elif m[1] in ("while", "for") or (m[1] in ("if", "unless") and masked[masked.rfind("\n", 0, m.start()) + 1 : m.start()].strip()):
                depth += 0 if language == "ruby" and m[1] in ("if", "unless") else 0
            else:
                depth += 1
        return len(masked)
    depth = 0
    for i in range(at, len(masked)):
        c = masked[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1 if depth == 0 else i
        elif c == ";" and not depth:
            return i + 1
        elif c == "\n" and not depth and language in ("go", "kotlin", "swift", "scala", "dart", "javascript", "typescript") and masked[at:i].count("(") == masked[at:i].count(")") and not masked[i:].lstrip().startswith(("{", "=>", ".")):
            return i
    return len(masked)


def _rust_uses(body: str, prefix: list[str]) -> list[tuple[list[str], bool]]:
    """(path, glob) of each leaf of a use tree; the name before `as` counts."""
    depth, part, parts = 0, "", []
    for ch in body + ",":
        if ch == "," and not depth:
            parts.append(part.strip())
            part = ""
            continue
        depth += (ch == "{") - (ch == "}")
        part += ch
    out: list[tuple[list[str], bool]] = []
    for p in filter(None, parts):
        if "{" in p:
            head, inner = p.split("{", 1)
            out += _rust_uses(inner.rsplit("}", 1)[0], [*prefix, *(x.strip() for x in head.split("::") if x.strip())])
        else:
            path = [*prefix, *(x.strip() for x in re.split(r"\s+as\s+", p)[0].split("::") if x.strip())]
            if path and path[-1] == "*":
                out.append((path[:-1], True))
            elif path:
                out.append((path[:-1] if path[-1] == "self" else path, False))
    return out


#: Words before a declaration that belong to it.
MODIFIERS = {
    "rust": re.compile(r"(?:\b(?:pub(?:\s*\([^)]*\))?|async|unsafe|const|default|extern)\s+)*\Z"),
    "typescript": re.compile(r"(?:\b(?:abstract|async|declare)\s+)*\Z"),
    "javascript": re.compile(r"(?:\basync\s+)*\Z"),
}


def _scan(b: Builder, text: str | None = None) -> None:
    language = {"svelte": "typescript", "vue": "typescript"}.get(b.language, b.language)
    text = b.text if text is None else text
    masked, clean = mask(text, language)
    if not clean or masked.count("{") != masked.count("}") or masked.count("(") != masked.count(")"):
        b.out.status = "partial"
    defs: list[tuple[int, int, str, str, str]] = []
    taken: set[int] = set()
    for kind, raw, pattern in DEFINITIONS[language]:
        for m in re.finditer(pattern, masked):
            if m.start(1) in taken or m[1] in NOT_CALLED:
                continue
            taken.add(m.start(1))
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if language in MODIFIERS:
                start = MODIFIERS[language].search(masked, masked.rfind("\n", 0, start) + 1, start).start()
            if raw in ("const", "arrow") and language in SCRIPTS and kind != "constant":
                start = m.start(1)
            end = m.end() if kind == "macro" and language in ("c", "cpp") else max(m.end(1), _end_of(masked, m.end(1), language))
            defs.append((start, end, kind, raw, m[1]))
    if language == "rust":
        for m in re.finditer(r"\bimpl\b\s*(?:<[^{]*?>\s*)?([^{;]+?)\s*(?:\bwhere\b[^{]*)?\{", masked):
            trait, _, target = m[1].rpartition(" for ")
            defs.append((m.start(), _end_of(masked, m.end() - 1, language), "impl_block", "impl", " ".join((target or m[1]).split())))
    defs.sort(key=lambda d: (d[0], -d[1]))
    stack: list[tuple[int, list[str], str, str, str]] = []
    spans: list[tuple[int, int, str, list[str], str]] = []
    for start, end, kind, raw, name in defs:
        while stack and stack[-1][0] < end:
            stack.pop()
        within = stack[-1][1] if stack else []
        owner = stack[-1][3] if stack else ""
        local = name
        if kind == "impl_block":
            local = re.sub(r"<.*", "", name.removeprefix("dyn ").lstrip("&").strip()).split("::")[-1].strip() or "<type>"
        if language == "rust" and kind == "function" and owner in ("impl_block", "trait"):
            kind = "method"
        if language == "go" and kind == "method":
            receiver = re.search(r"func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)", masked[start:end])
            within = [receiver[1]] if receiver else within
        if language in ("typescript", "javascript") and kind == "variable" and owner in ("function", "method"):
            continue
        key = b.symbol(kind, local, within, start, end, stack[-1][2] if stack else b.file, raw, docstring(text, start, end, language))
        stack.append((end, [*within, local], key, kind, local))
        spans.append((start, end, key, [*within, local], kind))
        if kind == "impl_block":
            trait, _, target = re.sub(r"^impl\b\s*(?:<[^{]*?>\s*(?=[A-Za-z&(\[]))?", "", masked[start : masked.find("{", start)]).rpartition(" for ")
            b.reference(key, "implements_for", "type", [local], None, start, masked.find("{", start))
            if trait.strip():
                b.reference(key, "implements", "trait", re.sub(r"<.*", "", trait.strip()).split("::"), None, start, masked.find("{", start))

    def inside(at: int) -> tuple[str, list[str], str]:
        best = (b.file, [], "file")
        for s, e, key, path, kind in spans:
            if s > at:
                break
            if at < e:
                best = (key, path, kind)
        return best

    if language == "rust":
        for m in re.finditer(r"\buse\s+([^;]+);", masked):
            for path, glob in _rust_uses(m[1], []):
                b.reference(inside(m.start())[0], "imports", "import_glob" if glob else "import", path, "::".join(path[:-1]), m.start(), m.end())
    elif language == "go":
        for m in re.finditer(r"(?m)^import\s+(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"[^\"]+\")", text):
            for p in re.findall(r'"([^"]+)"', m[0]):
                b.reference(b.file, "imports", "import", p.split("/"), "::".join(p.split("/")[:-1]), m.start(), m.end())
    elif language in ("typescript", "javascript"):
        here = b.path.rsplit("/", 1)[0].split("/") if "/" in b.path else []
        for m in re.finditer(r"\b(?:import|export)\s+(?:type\s+)?([^;'\"]*?)\s*from\s*['\"](\.[^'\"]*)['\"]", text):
            base = list(here)
            for part in re.sub(r"\.(?:[mc]?[jt]sx?|svelte|vue)$", "", m[2]).split("/"):
                base = base[:-1] if part == ".." else base if part in (".", "") else [*base, part]
            base = base[:-1] if base and base[-1] == "index" else base
            for name in re.findall(r"[{,]\s*(?:type\s+)?([\w$]+)", m[1]):
                b.reference(b.file, "imports", "import", [*base, name], "::".join(base), m.start(), m.end())
            if plain := re.match(r"\s*([A-Za-z_$][\w$]*)", m[1]):
                b.reference(b.file, "imports", "import", [*base, plain[1]], "::".join(base), m.start(), m.end())
    if language in NO_CALLS:
        return
    defined = {s for s in taken}
    for m in re.finditer(r"((?:[A-Za-z_$][\w$]*(?:::<[^<>()]*>)?\s*(?:::|\.|->|\?\.)\s*)*)([A-Za-z_$][\w$]*)(!?)(?:::<[^<>()]*>)?\s*[(\[{]" if language == "rust" else r"((?:[A-Za-z_$][\w$]*\s*(?:::|\.|->|\?\.|:)\s*)*)([A-Za-z_$][\w$]*)()\s*\(", masked):
        name, macro = m[2], m[3] == "!"
        if m.start(2) in defined or name in NOT_CALLED or (language == "rust" and not macro and masked[m.end() - 1] != "("):
            continue
        key, path, kind = inside(m.start(2))
        if language == "go" and kind == "interface":  # what an interface asks for
            continue
        head = [x for x in re.split(r"::<[^<>()]*>|::|\?\.|\.|->|:|\s+", m[1]) if x]
        owner = path[-2] if len(path) > 1 else None
        qualifier = head[-1] if head else None
        if qualifier in ("self", "Self", "this") and owner:
            qualifier = owner
        static = language == "rust" and "::" in m[1] and "." not in m[1]
        whole = [*(owner if x == "Self" and owner else x for x in head), name] if static else [name]
        if language == "go" and head and kind == "method":
            bound = re.search(r"func\s*\(\s*(\w+)\s+\*?\s*(\w+)", masked[next(s for s, _, k, _, _ in spans if k == key) :])
            qualifier = bound[2] if bound and bound[1] == head[-1] else qualifier
        if language in ("go", "typescript", "javascript") and head and qualifier == head[-1]:
            whole = [head[-1], name]
        b.reference(key, "calls", "macro" if macro else "method" if head and not static else "function", whole, qualifier if not static else (head[-1] if head else None), m.start(), m.end() - 1)


def script_ranges(text: str) -> list[tuple[int, int]]:
    return [m.span(1) for m in re.finditer(r"(?is)<script\b[^>]*>(.*?)</script\s*>", text)]


def mask_to_ranges(text: str, ranges: list[tuple[int, int]]) -> str:
    out, last = "", 0
    for a, z in ranges:
        out += re.sub(r"[^\n]", " ", text[last:a]) + text[a:z]
        last = z
    return out + re.sub(r"[^\n]", " ", text[last:])


def extract(path: str, language: str, scope: list[str], text: str) -> Extraction:
    """The rows of one file. A text with faults still gives what can be read, and is marked partial."""
    b = Builder(path, language, scope, text)
    if language == "python":
        _python(b)
    elif language in ("svelte", "vue"):
        _scan(b, mask_to_ranges(text, script_ranges(text)))
    else:
        _scan(b)
    return b.out


def languages() -> list[tuple[str, str]]:
    return sorted((language, ext) for ext, language in EXTENSIONS.items())
