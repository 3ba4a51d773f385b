"""Symbols of C++ and C# sources, by a scanner of braces and declaration heads.

Comments, strings and preprocessor lines are blanked first. Then every "{" or ";" closes a head; the head's words tell
whether it opens a namespace, a type, or a function, or declares one. Differences from a full parser: macros that hide
braces, K&R definitions and unbalanced conditional code may be misread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..schemas import SYMBOLS

#: Suffixes read as C++, and words before "(" that name no function.
CPP = {".h", ".hpp", ".hxx", ".cpp", ".cxx", ".c"}
NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "sizeof", "new", "delete", "throw", "using", "lock", "foreach", "decltype", "alignas", "static_assert", "defined", "noexcept", "else", "do", "case"}

HIDDEN = re.compile(
    r'//[^\n]*|/\*.*?\*/|R"([^()\s\\]{0,16})\(.*?\)\1"|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|^[ \t]*#(?:\\\n|[^\n])*',
    re.S | re.M,
)


@dataclass
class Symbol:
    symbol_type: str
    symbol_name: str
    parent_class: str
    namespace: str
    start_line: int
    end_line: int
    content: str = ""


def blanked(text: str) -> str:
    """The text with comments, strings and directives as blanks, line feeds kept."""
    return HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


TYPE_CPP = re.compile(r"\b(class|struct)\s+(?:\[\[.*?\]\]\s*)?(?:alignas\s*\([^)]*\)\s*)?(?:[A-Z_]+\s+)?([A-Za-z_]\w*)\s*(?:final\s*)?(?:<[^{;]*>)?\s*(?::(?!:)[^{;]*)?$", re.S)
TYPE_CS = re.compile(r"\b(class|struct|interface|record(?:\s+(?:class|struct))?)\s+([A-Za-z_]\w*)")
SPACE = re.compile(r"\bnamespace\s*([\w:.\s]*)$")
CALL = re.compile(r"((?:[A-Za-z_]\w*\s*(?:<[^<>()]*>)?\s*::\s*)*~?\s*[A-Za-z_]\w*)\s*(?:<[^<>()]*>)?\s*\(")
ENUM = re.compile(r"\benum\b")


def function_name(head: str, cpp: bool) -> str:
    """Name of the function a head declares, else ''. The part before the first parameter list decides."""
    head = re.sub(r"\[[^\]]*\]", " ", head)
    if "operator" in head and re.search(r"\boperator\b", head):
        return "unknown" if "(" in head else ""
    for m in CALL.finditer(head):
        name = re.sub(r"\s+|<[^<>]*>", "", m[1])
        before = head[: m.start()].strip()
        if name.split("::")[-1].lstrip("~") in NOT_NAMES:
            return ""
        if before.endswith(("=", ",", "(", ".", "->", "return", "&&", "||", "new")) or "=" in re.sub(r"[<>=!]=|\bdefault\b", "", before):
            return ""
        return name
    return ""


def parse(text: str, suffix: str) -> list[Symbol]:
    """Symbols in order of their start; an unknown suffix has none."""
    cpp = suffix.lower() in CPP
    if not cpp and suffix.lower() != ".cs":
        return []
    clean, lines = blanked(text), text.split("\n")
    joint = "::" if cpp else "."
    line_at = [0]
    for m in re.finditer("\n", clean):
        line_at.append(m.end())

    def line(pos: int) -> int:
        import bisect

        return bisect.bisect_right(line_at, pos)

    out: list[Symbol] = []
    # open scopes: (kind, namespace, parent, symbol); kind: space, type, or body (nothing within is looked at)
    scopes: list[tuple[str, str, str, Symbol | None]] = [("space", "", "", None)]
    head, depth, round_ = 0, 0, 0
    expression: Symbol | None = None

    def named(namespace: str, *parts: str) -> str:
        return joint.join(p for p in (namespace, *parts) if p)

    for m in re.finditer(r"[{};()]|=>|\b(?:public|private|protected)\s*:(?!:)", clean):
        c, kind = m[0], scopes[-1][0]
        if kind == "body":
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth == 0:
                    _, _, _, symbol = scopes.pop()
                    if symbol:
                        symbol.end_line = line(m.start())
                    head = m.end()
            continue
        if c in "()":
            round_ = max(0, round_ + (1 if c == "(" else -1))
            continue
        if round_:
            if c in "{};":  # braces within arguments
                continue
            continue
        if c == "=>":
            if not cpp and expression is None:
                expression = opened(out, clean, head, m.start(), line, scopes[-1], named, cpp, lines)
                head = m.end() if expression else head
            continue
        if len(c) > 1:
            head = m.end()
            continue
        words = clean[head : m.start()]
        _, namespace, parent, _ = scopes[-1]
        if c == ";":
            if expression is not None:
                expression.end_line = line(m.start())
                expression = None
            elif cpp and not ENUM.search(words):
                t = TYPE_CPP.search(words.strip())
                name = "" if t and "(" not in words else function_name(words, cpp)
                first = head + len(words) - len(words.lstrip())
                if t and "(" not in words and re.fullmatch(r"\s*(?:template\s*<[^{;]*>\s*)?(?:class|struct)\s+[A-Za-z_]\w*\s*", words):
                    out.append(Symbol(t[1], named(namespace, t[2]), parent, namespace, line(first), line(m.start())))
                elif name and not re.match(r"\s*(?:typedef|using|friend|return|goto)\b", words):
                    out.append(Symbol("method" if parent else "function", named(namespace, parent, name), parent, namespace, line(first), line(m.start())))
            elif not cpp:
                symbol = opened(out, clean, head, m.start(), line, scopes[-1], named, cpp, lines)
                if symbol:
                    symbol.end_line = line(m.start())
            head = m.end()
        elif c == "{":
            first = head + len(words) - len(words.lstrip())
            space = SPACE.search(words.strip()) if "(" not in words else None
            t = None if space or "(" in words.split(":")[0] and cpp else (TYPE_CPP if cpp else TYPE_CS).search(words.strip())
            if space or re.search(r'\bextern\s*$', words):
                inner = re.sub(r"\s+", "", space[1]) if space else ""
                name = named(namespace, inner or "unknown") if space else namespace
                scopes.append(("space", name, parent, None))
                head = m.end()
            elif t and not ENUM.search(words):
                kind = "class" if t[1].startswith("record") else t[1]
                symbol = Symbol(kind, named(namespace, t[2]), parent, namespace, line(first), line(first))
                out.append(symbol)
                scopes.append(("type", namespace, t[2], symbol))
                head = m.end()
            else:
                symbol = None if expression else opened(out, clean, head, m.start(), line, scopes[-1], named, cpp, lines)
                scopes.append(("body", namespace, parent, symbol))
                depth = 1
        else:
            if len(scopes) > 1:
                _, _, _, symbol = scopes.pop()
                if symbol:
                    symbol.end_line = line(m.start())
            head = m.end()
    for s in out:
        s.end_line = max(s.end_line, s.start_line)
        s.content = "\n".join(lines[s.start_line - 1 : s.end_line])
    return out


def opened(out, clean, head, end, line, scope, named, cpp, lines) -> Symbol | None:
    """Adds the function whose head ends before `end`, if it is one."""
    words = clean[head:end]
    _, namespace, parent, _ = scope
    if ENUM.search(words) or (not cpp and (not parent or re.search(r"\b(?:delegate|event|operator)\b", words))):
        return None
    if cpp:
        words_ = re.sub(r"\)\s*:(?!:).*$", ")", words, flags=re.S)  # member initialisers
    else:
        words_ = re.sub(r"\)\s*(?::|where\b).*$", ")", words, flags=re.S)
    name = function_name(words_, cpp)
    if not name:
        return None
    first = head + len(words) - len(words.lstrip())
    inside = parent or (name.rsplit("::", 1)[0].split("::")[-1] if "::" in name else "")
    symbol = Symbol("method" if inside or not cpp else "function", named(namespace, parent, name), inside, namespace, line(first), line(end))
    out.append(symbol)
    return symbol


def parse_symbols(files: DataFrame) -> DataFrame:
    """(file_path, language, project_name, content) -> those keys with a row for each symbol."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in SYMBOLS.split(",")]
        for part in parts:
            rows = []
            for path, language, project, content in zip(part["file_path"], part["language"], part["project_name"], part["content"], strict=True):
                dot = path.rfind(".")
                for s in parse(content or "", path[dot:] if dot >= 0 else ""):
                    rows.append((path, language, project, *[getattr(s, n) for n in names]))
            yield pd.DataFrame(rows, columns=["file_path", "language", "project_name", *names])

    schema = f"file_path string, language string, project_name string, {SYMBOLS}"
    return files.select("file_path", "language", "project_name", "content").mapInPandas(run, schema)
