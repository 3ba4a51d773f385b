"""Text and path expressions: tokens, languages, globs, scopes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Letters whose upper case upper() writes as several, by the one that stands for them: their own title case, else themselves.
WHOLE = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x110000)) if len(c.upper()) > 1} | {"ß": "ẞ"}
#: Fixed value: suffixes that are not their own language name.
LANGUAGES = {".h": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".cxx": "cpp", ".c": "cpp"}


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def upper(text: Column) -> Column:
    """Upper case, letter by letter, so that a text keeps its length: ß is ẞ, not SS."""
    kept = "[" + "".join(WHOLE) + "]"
    pieces = F.regexp_extract_all(text, F.lit(f"{kept}|[^{kept[1:]}+"), F.lit(0))
    single = F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair])
    return F.when(text.rlike(kept), F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(single, p), F.upper(p))), "")).otherwise(F.upper(text))


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot, else empty."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    s = suffix(path)
    named = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(named, s), F.ltrim(s, F.lit(".")))


def normal_path(path: Column) -> Column:
    """Forward slashes, no trailing ones."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "/+$", "")


def in_scope(path: Column, root: str) -> Column:
    """The root itself, or below it."""
    top = re.sub("/+$", "", root.replace("\\", "/"))
    p = F.translate(path, "\\", "/")
    return (p == top) | p.startswith(top + "/")


def glob_regex(glob: str) -> str:
    """A shell pattern as an anchored regular expression; * crosses slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 + glob[i + 1 : i + 2].count("!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and close > 0:
            inner = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else ("\\" + inner if inner[0] == "^" else inner)) + "]")
            i = close
        else:
            out.append(re.escape(c) if c.isascii() and not c.isalnum() else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def universal(text: Column) -> Column:
    """The text with every line end as a line feed."""
    return F.regexp_replace(text, "\r\n?", "\n")


#: Fixed value: what ends a line of a symbol.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def split_lines(text: Column) -> Column:
    """The lines without their ends; an end at the end opens no further line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def excluded(path: Column, globs: list[str], root: str = "") -> Column:
    """Whether a pattern fits the path or one of its ancestor directories; with a root, of those below it."""
    p = F.translate(path, "\\", "/")
    steps = F.split(p, "/")
    above = len(root.replace("\\", "/").rstrip("/").split("/")) if root else 0
    own = F.greatest(F.size(steps) - above, F.lit(0))
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(own, F.lit(1))), lambda i: F.array_join(F.slice(steps, F.lit(1), i + above), "/"))
    fits = lambda g: lambda a: a.rlike(glob_regex(g))
    hit = F.lit(False)
    for g in globs:
        hit = hit | F.exists(ancestors, fits(g))
    return hit
