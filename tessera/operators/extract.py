"""Extraction: one file in, its symbols out. Python goes through its own parser, the rest through line patterns."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_exported
from tessera.runtime import ship
from tessera.schemas import SYMBOLS

LARGEST = 10 * 1024 * 1024
_ID = r"[A-Za-z_$][\w$]*"
#: A type before a name, no word that begins a statement.
_TYPE = r"(?!(?:return|new|else|throw|await|yield|case|goto|var|using|import|package)\b)[A-Za-z_][\w.]*(?:<[^()]*>)?(?:\[[\], ]*|\?)*"
#: In these a callable's body holds no members, but types of its own.
_CLOSED = ("java", "csharp", "php", "c", "cpp")
_TYPES = ("class", "interface", "struct", "enum", "trait", "namespace")
#: (kind, pattern with a group n) in order; the first that fits a line names it.
PATTERNS: dict[str, tuple[tuple[str, str], ...]] = {
    "go": (
        ("method", r"^func\s+\(\s*(?:\w+\s+)?\*?(?P<p>\w+)(?:\[[^\]]*\])?\s*\)\s+(?P<n>\w+)\s*[\[(]"), ("function", r"^func\s+(?P<n>\w+)\s*[\[(]"), ("struct", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+struct\b"),
        ("interface", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type", r"^type\s+(?P<n>\w+)\s+"), ("const", r"^const\s+(?P<n>\w+)"), ("variable", r"^var\s+(?P<n>\w+)"),
    ),
    "javascript": (
        ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>{_ID})"), ("interface", rf"^\s*(?:export\s+)?interface\s+(?P<n>{_ID})"), ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<n>{_ID})"),
        ("type", rf"^\s*(?:export\s+)?type\s+(?P<n>{_ID})\b[^=]*="), ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>{_ID})"),
        ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<n>{_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*(?::[^=]+)?=>"), ("constructor", r"^\s+(?P<n>constructor)\s*\("),
        ("method", rf"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b){_ID})\s*(?:<[^>]*>)?\([^;]*\)\s*(?::\s*[^{{]+)?\{{"), ("const", rf"^(?:export\s+)?const\s+(?P<n>{_ID})"),
    ),
    "java": (
        ("class", r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|record)\s+(?P<n>\w+)"), ("interface", r"^\s*(?:(?:public|private|protected|static|sealed)\s+)*@?interface\s+(?P<n>\w+)"), ("enum", r"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+(?P<n>\w+)"),
        ("constructor", r"^\s+(?:(?:public|private|protected)\s+)?(?P<n>[A-Z]\w*)\s*\([^;{}]*\)\s*(?:throws [\w., ]+)?(?:\{.*)?\s*$"), ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?" + _TYPE + r"\s+(?P<n>\w+)\s*\([^;=]*\)?\s*(?:throws [\w., ]+)?(?:[{;]|\{.*\})?\s*$"),
        ("field", r"^\s+(?:(?:public|private|protected|static|final|volatile)\s+)+[\w.<>\[\],? ]+?\s+(?P<n>\w+)\s*[=;]"),
    ),
    "rust": (
        ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<n>\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)"),
        ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>\w+)"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<n>\w+)"), ("const", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<n>\w+)\s*:"), ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>\w+)"),
    ),
    "csharp": (
        ("namespace", r"^\s*namespace\s+(?P<n>[\w.]+)"), ("class", r"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?:class|record)\s+(?P<n>\w+)"), ("interface", r"^\s*(?:(?:public|private|protected|internal|partial)\s+)*interface\s+(?P<n>\w+)"),
        ("struct", r"^\s*(?:(?:public|private|internal|readonly|ref|partial)\s+)*struct\s+(?P<n>\w+)"), ("enum", r"^\s*(?:(?:public|private|protected|internal)\s+)*enum\s+(?P<n>\w+)"), ("constructor", r"^\s+(?:(?:public|private|protected|internal|static)\s+)*(?P<n>[A-Z]\w*)\s*\([^;{}]*\)\s*(?::\s*(?:base|this)\s*\(.*\)\s*)?(?:\{.*)?\s*$"),
        ("method", r"^\s+(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|new|extern)\s+)*" + _TYPE + r"\s+(?P<n>\w+)\s*(?:<[^>]+>)?\([^;=]*\)?\s*(?:where .*)?(?:[{;]|\{.*\}|=>.*)?\s*$"),
    ),
    "php": (
        ("class", r"^\s*(?:(?:abstract|final|readonly)\s+)*class\s+(?P<n>\w+)"), ("interface", r"^\s*interface\s+(?P<n>\w+)"), ("trait", r"^\s*trait\s+(?P<n>\w+)"), ("enum", r"^\s*enum\s+(?P<n>\w+)"),
        ("constructor", r"^\s+(?:(?:public|private|protected)\s+)?function\s+(?P<n>__construct)\b"), ("function", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<n>\w+)"), ("const", r"^\s*(?:(?:public|private|protected)\s+)?const\s+(?:\w+\s+)?(?P<n>\w+)\s*="),
    ),
    "cpp": (
        ("namespace", r"^\s*namespace\s+(?P<n>[\w:]+)"), ("class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<n>\w+)\s*(?:final\s*)?(?::[^;]*)?\{?\s*$"), ("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<n>\w+)\s*(?::[^;]*)?\{?\s*$"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<n>\w+)"),
        ("method", r"^[\w:<>,&*\s~]*?\b(?P<p>\w+)::(?P<n>~?\w+)\s*\([^;]*$"), ("function", r"^\s*(?:(?:static|inline|virtual|extern|constexpr|explicit|const|unsigned|friend)\s+)*(?!return\b|else\b|new\b|delete\b|throw\b|case\b|typedef\b)[A-Za-z_][\w:<>,]*[\s&*]+(?P<n>[A-Za-z_]\w*)\s*\([^;={}]*\)\s*(?:const|override|noexcept|final|\s)*(?:=\s*(?:0|default|delete)\s*;|[{;]|\{.*\})?\s*$"),
        ("constructor", r"^\s+(?:(?:explicit|inline|constexpr)\s+)*(?P<n>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:noexcept\s*)?(?::[^{;]*)?(?:=\s*(?:default|delete)\s*;|[{;]|\{.*\})?\s*$"),
        ("const", r"^#define\s+(?P<n>\w+)"),
    ),
}
PATTERNS |= {"typescript": PATTERNS["javascript"], "tsx": PATTERNS["javascript"], "c": PATTERNS["cpp"]}
PATTERNS["python"] = (("class", r"^\s*class\s+(?P<n>\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(?P<n>\w+)"))
_COMPILED = {lang: [(kind, re.compile(p)) for kind, p in rules] for lang, rules in PATTERNS.items()}
IMPORTS = {
    "python": r"(?m)^\s*(?:from\s+([.\w]+)\s+import|import\s+([\w.]+))", "go": r"\"([^\"\n]+)\"", "javascript": r"(?:\bfrom\s*|\brequire\(\s*|\bimport\(?\s*)['\"]([^'\"\n]+)['\"]",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)", "rust": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+)", "csharp": r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "php": r"(?m)^\s*use\s+([\w\\]+)", "cpp": r"(?m)^\s*#\s*include\s*[<\"]([^>\"\n]+)[>\"]",
}
IMPORTS |= {"typescript": IMPORTS["javascript"], "tsx": IMPORTS["javascript"], "c": IMPORTS["cpp"]}
_CALL = re.compile(r"(?:(?<![\w$.])|(?<=\)\.)|(?<=\)\?\.))((?:[A-Za-z_$][\w$]*(?:\.|::|->|\?\.))*[A-Za-z_$][\w$]*)(\s*<[\w\s,.\[\]]+>)?\s*\(")
_CONTROL = frozenset("if for while switch catch return else match loop throw".split())
_KEYWORDS = frozenset("if for while switch catch return function new elseif sizeof typeof await defer go match loop else func fn def class lock using foreach and or not in is isset empty array list print echo throw".split())


def strip_code(text: str) -> str:
    """The text with comments and quoted parts blanked, lines kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", blank, text, flags=re.S)


def brace_end(lines: list[str], at: int, most: int = 500) -> int:
    """The last line of the braced body that starts on line ``at`` or after; that line itself where there is none."""
    depth = 0
    opened = False
    for i in range(at, min(len(lines), at + most)):
        depth += lines[i].count("{") - lines[i].count("}")
        opened |= "{" in lines[i]
        if opened and depth <= 0:
            return i
        if not opened and (lines[i].rstrip().endswith(";") or i > at + 3):
            return i if lines[i].rstrip().endswith(";") else at
    return min(len(lines), at + most) - 1 if opened else at


def indent_end(lines: list[str], at: int, most: int = 200) -> int:
    """The last line of the indented body below line ``at``."""
    base = len(lines[at]) - len(lines[at].lstrip())
    last = at
    for i in range(at + 1, min(len(lines), at + most)):
        if not lines[i].strip():
            continue
        if len(lines[i]) - len(lines[i].lstrip()) <= base:
            break
        last = i
    return last


def preceding_doc(lines: list[str], at: int) -> str:
    """The comment that ends on the line above."""
    out: list[str] = []
    i = at - 1
    while i >= 0 and re.match(r"^\s*(@|#\[|\[)", lines[i]):
        i -= 1
    if i >= 0 and lines[i].strip().endswith("*/"):
        while i >= 0:
            out.append(re.sub(r"^\s*/?\*+/?\s?|\*/\s*$", "", lines[i]).strip())
            if "/*" in lines[i]:
                break
            i -= 1
    else:
        while i >= 0 and lines[i].strip().startswith("//"):
            out.append(lines[i].strip().lstrip("/").strip())
            i -= 1
    return "\n".join(x for x in reversed(out) if x)


def marks_above(lines: list[str], at: int) -> list[str]:
    """Annotations on the lines above, without their @ or brackets."""
    out = []
    for i in range(at - 1, -1, -1):
        m = re.match(r"^\s*(?:@([\w.]+(?:\(.*\))?)|#\[(.+)\]|\[([\w.]+(?:\(.*\))?)\])\s*$", lines[i])
        if not m:
            break
        out.append(m[1] or m[2] or m[3])
    return out[::-1]


def _argument(text: str) -> str:
    text = text.strip()
    if text in ("true", "false"):
        return "#boolean"
    if re.fullmatch(r"[A-Za-z_$]\w*", text):
        return text
    if re.fullmatch(r"-?\d[\w.]*", text):
        return "#" + ("long" if text[-1] in "lL" else "float" if text[-1] in "fF" and not text.startswith("0x") else "double" if "." in text else "int")
    if text[:1] in "\"'`":
        return "#char" if re.fullmatch(r"'(?:[^'\\]|\\.)'", text) else "#String"
    cast = re.match(r"\(\s*([A-Za-z_][\w.]*(?:\[\])?)\s*\)\s*[\w(\"']", text)
    if cast:
        return "#" + cast[1]
    m = re.fullmatch(r"(?:\w+[.:>-]+)*([A-Za-z_]\w*)\s*\(.*\)", text, re.S)
    return f"call:{m[1]}" if m else ""


def _brackets(code: str) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Where each opening bracket closes, and the commas directly inside of it."""
    close: dict[int, int] = {}
    commas: dict[int, list[int]] = {}
    stack: list[int] = []
    for m in re.finditer(r"[()\[\]{},]", code):
        c, at = m[0], m.start()
        if c == ",":
            if stack:
                commas.setdefault(stack[-1], []).append(at)
        elif c in "([{":
            stack.append(at)
        elif stack:
            close[stack.pop()] = at
    return close, commas


def call_sites(body: str, first_line: int) -> list[dict]:
    """Calls in a body: callee with at most one qualifier, line, arguments; comments and strings do not count.

    The qualifier of a call on another's result is that one's name with (), as in ``make().run``.
    """
    code = strip_code(body)
    close, commas = _brackets(code)
    open_of = {b: a for a, b in close.items()}
    out = []
    line, seen = first_line, 0
    for m in _CALL.finditer(code):
        parts = re.split(r"\?\.|\.|::|->", m[1])
        line, seen = line + code.count("\n", seen, m.start()), m.start()
        before = re.search(r"\)\s*(?:\?\.|\.|->|::)\s*$", code[max(0, m.start() - 40) : m.start()])
        if (len(parts) == 1 and parts[0] in _KEYWORDS and not before) or re.search(r"\b(?:func|function|def|fn)\s+(?:\([^)]*\)\s*)?$", code[max(0, m.start() - 60) : m.start()]):
            continue
        begin = m.end()
        end = close.get(begin - 1, len(code))
        cuts = [begin, *(c + 1 for c in commas.get(begin - 1, ())), end + 1]
        args = [body[a : b - 1] for a, b in zip(cuts, cuts[1:])]
        if not args[-1].strip():
            args.pop()
        if len(parts) == 1 and before:
            at = open_of.get(max(0, m.start() - 40) + before.start())
            maker = re.search(r"([A-Za-z_$][\w$]*)\s*(?:<[\w\s,.\[\]]+>)?\s*$", code[max(0, at - 120) : at]) if at is not None else None
            parts.insert(0, f"{maker[1]}()" if maker else "?")
        callee = ".".join(parts[-2:]) if len(parts) > 1 and parts[-2] else parts[-1]
        out.append({"callee": callee, "line": line, "argc": len(args), "args": [_argument(a) for a in args], "generic": bool(m[2])})
    return out


def imports_of(text: str, language: str) -> list[str]:
    """Import strings in order, each once."""
    if language not in IMPORTS:
        return []
    if language == "go":
        text = "\n".join(re.findall(r"(?ms)^import\s*\((.*?)^\)", text) + re.findall(r"(?m)^import\s+(?:\w+\s+)?(\"[^\"]+\")", text))
    found = [x if isinstance(x, str) else next(filter(None, x), "") for x in re.findall(IMPORTS[language], text)]
    if language == "rust":  # what is exported again is marked
        found = [f"pub use {m[2]}" if m[1] else m[2] for m in re.finditer(r"(?m)^\s*(pub(?:\([^)]*\))?\s+)?use\s+([\w:]+)", text)]
    return list(dict.fromkeys(x for x in found if x))


def _symbol(path, sha, language, kind, name, parent, signature, doc, start, end, raw, imports, **more) -> dict:
    qualified = f"{parent}.{name}" if parent else name
    size = len(raw.encode("utf-8", "replace"))
    return {
        "id": f"{path}::{qualified}@{sha}", "file_path": path, "blob_sha": sha, "language": language, "kind": kind, "name": name, "qualified_name": qualified, "signature": signature.strip(), "docstring": doc,
        "span": {"start": start, "end": end}, "imports": imports, "exports": False, "raw_text": raw, "parent_symbol": parent or "", "token_estimate": size // 4 + 1 if size else 0,
        "modifiers": [], "type_parameters": [], "annotations": [], "call_sites": [], "attr_sites": [],
    } | more


def by_patterns(path: str, sha: str, language: str, text: str) -> list[dict]:
    """Symbols by the language's line patterns, in the order of lines."""
    lines = text.split("\n")
    code = lines if language == "python" else strip_code(text).split("\n")
    imports = imports_of(text, language)
    out: list[dict] = []
    owners: list[tuple[int, str, str]] = []  # (last line, name, kind)
    skip = -1
    for i, line in enumerate(code):
        impl = re.match(r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", line) if language == "rust" else None
        if impl:
            owners.append((brace_end(code, i), impl[1], "impl"))
            continue
        if i <= skip:
            continue
        block = re.match(r"^(const|var)\s*\(\s*$", line) if language == "go" else None
        if block:
            last = next((j for j in range(i + 1, len(code)) if code[j].startswith(")")), len(code))
            for j in range(i + 1, last):
                entry = re.match(r"^(?:\t| {1,8})([A-Za-z_]\w*)", code[j])
                if entry:
                    out.append(_symbol(path, sha, language, "const" if block[1] == "const" else "variable", entry[1], "", lines[j], preceding_doc(lines, j), j + 1, j + 1, lines[j], imports))
            skip = last
            continue
        owners = [o for o in owners if o[0] >= i]
        for kind, pattern in _COMPILED[language]:
            m = pattern.match(line)
            if m and (kind != "constructor" or language not in ("java", "csharp", "cpp", "c") or owners and m["n"] == owners[-1][1]):
                break
        else:
            continue
        name = m["n"]
        if name in _CONTROL:
            continue
        if language in _CLOSED and owners and owners[-1][2] in ("function", "method", "constructor") and kind not in _TYPES:
            continue  # a statement of the body
        end = indent_end(lines, i) if language == "python" else brace_end(code, i)
        parent = (m.groupdict().get("p") or "") or (owners[-1][1] if owners and owners[-1][2] not in ("namespace", "module", "function", "method", "constructor") else "")
        if parent and kind == "function":
            kind = "method"
        if parent and name == parent and kind == "method" and language in ("java", "csharp", "cpp"):
            kind = "constructor"
        if language == "rust" and parent and name == "new":
            kind = "constructor"
        if language == "python" and name == "__init__":
            kind = "constructor"
        raw = "\n".join(lines[i : end + 1])
        callable_ = kind in ("function", "method", "constructor")
        inner = re.split(r"\{|=>", raw, maxsplit=1) if callable_ and language != "python" else [raw]
        sites = call_sites(inner[1], i + 1 + inner[0].count("\n")) if len(inner) > 1 else []
        tp = re.search(re.escape(name) + r"\s*(?:<([^>()]*)>|\[([A-Z]\w* [^\]]*)\])", line)
        out.append(_symbol(path, sha, language, kind, name, parent, lines[i].split("{")[0], preceding_doc(lines, i), i + 1, end + 1, raw, imports,
            modifiers=re.findall(r"\b(public|private|protected|internal|static|final|abstract|async|override|virtual|readonly|pub|unsafe)\b", line.split("(")[0]),
            type_parameters=[x.strip().split()[0].split(":")[0] for x in (tp[1] or tp[2] or "").split(",") if x.strip()] if tp else [], annotations=marks_above(lines, i), call_sites=sites))
        if kind in ("class", "interface", "struct", "trait", "enum", "namespace", "module") and end > i:
            owners.append((end, name, kind))
        elif language == "go" and callable_:
            skip = end
        elif language in _CLOSED and callable_ and end > i:
            owners.append((end, name, kind))
    if language == "python":
        for s in out:
            s["call_sites"] = None  # not looked for; see body_words
    return out


def parses(language: str, text: str) -> bool:
    """Whether the text is well-formed: for Python by its parser, else by brackets that match outside comments and strings."""
    if language == "python":
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return False
        return True
    stack: list[str] = []
    for c in re.findall(r"[()\[\]{}]", strip_code(text)):
        if c in "([{":
            stack.append({"(": ")", "[": "]", "{": "}"}[c])
        elif not stack or stack.pop() != c:
            return False
    return not stack


def sound_part(text: str) -> ast.Module:
    """The top-level statements of a broken Python text that parse by themselves, at their lines."""
    lines = text.split("\n")
    starts = [i for i, x in enumerate(lines) if re.match(r"[^\s#)\]}]", x) and not re.match(r"(?:else|elif|except|finally)\b", x)]
    starts = [i for k, i in enumerate(starts) if not (k and lines[starts[k - 1]].startswith("@"))]
    body: list[ast.stmt] = []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        try:
            part = ast.parse("\n".join(lines[a:b]))
        except (SyntaxError, ValueError, RecursionError):
            continue
        ast.increment_lineno(part, a)
        body += part.body
    return ast.Module(body=body, type_ignores=[])


def by_python_parser(path: str, sha: str, text: str, tree: ast.Module | None = None) -> list[dict]:
    """Symbols of Python by its own parser; raises SyntaxError unless the tree is given."""
    tree = tree or ast.parse(text)
    lines = text.split("\n")
    imports: list[str] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append("." * node.level + (node.module or ""))
    imports = list(dict.fromkeys(x for x in imports if x))
    out: list[dict] = []

    def dotted(node) -> str:
        if isinstance(node, ast.Attribute):
            base = dotted(node.value)
            return f"{base}.{node.attr}" if base else node.attr
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Call):
            return f"{dotted(node.func)}()" if isinstance(node.func, ast.Name) else ""
        return ""

    def own(node):
        todo = list(ast.iter_child_nodes(node))
        while todo:
            x = todo.pop(0)
            if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield x
                todo[:0] = ast.iter_child_nodes(x)

    def argument(node) -> str:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Constant):
            return f"#{type(node.value).__name__}"
        return f"call:{dotted(node.func).split('.')[-1]}" if isinstance(node, ast.Call) else ""

    def site(name: str, node, args=()) -> dict:
        return {"callee": ".".join(name.replace("()", "").split(".")[-2:]), "line": node.lineno, "argc": len(args), "args": [argument(a) for a in args], "generic": False}

    def visit(node, parent: str):
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef):
                kind = "class"
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = ("constructor" if x.name == "__init__" else "method") if parent else "function"
            elif isinstance(x, (ast.If, ast.Try, ast.With)):
                visit(x, parent)
                continue
            else:
                if parent == "" and isinstance(node, ast.Module) and isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name):
                    n = x.targets[0].id
                    out.append(_symbol(path, sha, "python", "const" if n.isupper() else "variable", n, "", lines[x.lineno - 1], "", x.lineno, x.end_lineno, "\n".join(lines[x.lineno - 1 : x.end_lineno]), imports))
                continue
            body_at = x.body[0].lineno if x.body else x.lineno
            signature = " ".join(s.strip() for s in lines[x.lineno - 1 : max(x.lineno, body_at - 1)])
            calls = [site(dotted(c.func), c, [*c.args, *(k.value for k in c.keywords)]) for c in own(x) if isinstance(c, ast.Call) and dotted(c.func)] if kind != "class" else []
            called = {id(c.func) for c in own(x) if isinstance(c, ast.Call)}
            attrs = [site(dotted(a), a) for a in own(x) if isinstance(a, ast.Attribute) and isinstance(a.ctx, ast.Load) and id(a) not in called and dotted(a)] if kind != "class" else []
            modifiers = (["async"] if isinstance(x, ast.AsyncFunctionDef) else []) + (["protected"] if x.name.startswith("_") and not x.name.startswith("__") else [])
            out.append(_symbol(path, sha, "python", kind, x.name, parent, signature.rstrip(":"), ast.get_docstring(x) or "", x.lineno, x.end_lineno, "\n".join(lines[x.lineno - 1 : x.end_lineno]), imports,
                modifiers=modifiers, annotations=[ast.unparse(d) for d in x.decorator_list], type_parameters=[p.name for p in getattr(x, "type_params", [])], call_sites=[c for c in calls if c["callee"]], attr_sites=attrs))
            if kind == "class":
                visit(x, x.name)
            else:
                for inner in x.body:
                    if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        visit(ast.Module(body=[inner], type_ignores=[]), "")

    visit(tree, "")
    return out


def document(path: str, sha: str, text: str) -> dict:
    """A plain-text file as one symbol."""
    signature = next((re.sub(r"^[#=*\-\s]+", "", x).strip() for x in text.split("\n") if re.sub(r"^[#=*\-\s]+", "", x).strip()), "")
    clip = lambda s, n: s.encode("utf-8", "replace")[:n].decode("utf-8", "ignore")
    name = path.rsplit("/", 1)[-1]
    raw = clip(text, 1 << 20)
    return _symbol(path, sha, "plaintext", "document", name, "", clip(signature, 120), clip(text, 1 << 16), 1, text.count("\n") + 1, raw, []) | {"id": f"{path}::document@{sha}", "qualified_name": path, "token_estimate": len(raw.encode()) // 4}


def extract(path: str, language: str, content: bytes) -> list[dict]:
    """The symbols of one file; ids that clash get #2, #3 ... in order.

    Of Python that does not parse come the statements that do, and by patterns the symbols of other names.
    """
    sha = hashlib.sha1(content).hexdigest()
    text = content.decode("utf-8", "replace").replace("\r\n", "\n")
    if language == "plaintext":
        found = [document(path, sha, text)]
    elif language == "python":
        try:
            found = by_python_parser(path, sha, text)
        except (SyntaxError, ValueError, RecursionError):
            found = by_python_parser(path, sha, text, sound_part(text))
            known = {s["name"] for s in found}
            found += [s for s in by_patterns(path, sha, language, text) if s["name"] not in known]
    elif language in PATTERNS:
        found = by_patterns(path, sha, language, text)
    else:
        found = []
    seen: dict[str, int] = {}
    for s in found:
        n = seen[s["id"]] = seen.get(s["id"], 0) + 1
        if n > 1:
            s["id"] += f"#{n}"
    return found


#: A frame of symbols is handed on once the files in it have so many bytes.
PIECE = 2 * 1024 * 1024


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The symbols of the batches' files in frames of about PIECE bytes of source: what a worker holds besides its batch does not grow with the batch."""
    names = SYMBOLS.fieldNames()
    for batch in batches:
        rows: list[dict] = []
        held = 0
        for p, g, c in zip(batch.path, batch.language, batch.content):
            if c is None or len(c) > LARGEST:
                continue
            rows += extract(p, g, bytes(c))
            held += len(c)
            if held >= PIECE:
                yield pd.DataFrame(rows, columns=names)
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)


def extract_files(files: DataFrame) -> DataFrame:
    """Symbols of files (path, language, content); a file over 10 MiB or of null content has none. Exports follow each language's rule."""
    ship(files.sparkSession)
    out = files.select("path", "language", "content").mapInPandas(_frames, SYMBOLS)
    return out.withColumn("exports", F.coalesce(is_exported(F.col("language"), F.col("name"), F.col("signature")), F.lit(False)))
