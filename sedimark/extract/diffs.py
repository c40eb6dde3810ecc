"""Unified diffs: what they change, by hunk and by symbol; walking back from a line to its declaration."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..rows import map_rows
from .code import calls_in

#: Unindented lines that a walk back looks at, and lines below a declaration in which its brace must open.
REACH, BRACE_WITHIN = 50, 20
_C_LIKE = re.compile(r"\.(c|h|cc|cpp|cxx|hh|hpp|hxx)\b", re.I)
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$")
_FUNCTION = re.compile(r"^(?!\s*(?:if|for|while|switch|return|else|do|case|default|goto|sizeof)\b)[A-Za-z_][\w\s*]*?\b([A-Za-z_]\w*)\s*\(")
_TYPE = re.compile(r"^\s*(?:typedef\s+)?(?:static\s+|const\s+)*(struct|union|enum)\s+(\w+)\s*(?:\{|$)")
_MACRO = re.compile(r"^\s*#\s*define\s+(\w+)")
_TYPEDEF = re.compile(r"^\s*typedef\b.*?\b(\w+)\s*(?:\[[^\]]*\]\s*)*;")


def declaration(line: str) -> tuple[str, str] | None:
    """(kind, name) of what a line declares; labels and calls declare nothing."""
    if m := _MACRO.match(line):
        return "macro", m[1]
    if m := _TYPEDEF.match(line):
        return "typedef", m[1]
    if m := _TYPE.match(line):
        return m[1], m[2]
    if line[:1].isspace() or not line or line.rstrip().endswith((";", ":")) and "{" not in line:
        return None
    if m := _FUNCTION.match(line):
        before = line[: m.start(1)].strip()
        return ("function", m[1]) if before else None
    return None


def symbol(kind: str, name: str) -> str:
    return {"function": f"{name}()", "macro": f"#{name}", "typedef": f"typedef {name}"}.get(kind, f"{kind} {name}")


def named(header: str) -> tuple[str, str] | None:
    """What a hunk's header names: a line of source, or a symbol as ``symbol`` writes it."""
    if m := re.fullmatch(r"(\w+)\(\)", header):
        return "function", m[1]
    if m := re.fullmatch(r"#(\w+)|(struct|union|enum|typedef) (\w+)", header):
        return ("macro", m[1]) if m[1] else (m[2], m[3])
    return declaration(header)


def walk_back(lines: list[str], at: int) -> tuple[str, str] | None:
    """The declaration that holds line ``at``: the nearest above whose brace opens soon, or that continues to the line."""
    seen = 0
    for i in range(min(at, len(lines) - 1), -1, -1):
        line = lines[i]
        if not line.strip():
            continue
        if i < at and line.startswith("}"):
            return None
        if not line[:1].isspace():
            seen += 1
            if seen > REACH:
                return None
        found = declaration(line)
        if not found and i + 1 < len(lines) and not line[:1].isspace() and re.match(r"^[A-Za-z_][\w\s*]*$", line) and i + 1 <= at:
            found = declaration(line.rstrip() + " " + lines[i + 1].lstrip())
        if not found:
            continue
        if found[0] == "macro":
            last = i
            while last < len(lines) - 1 and lines[last].rstrip().endswith("\\"):
                last += 1
            if last >= at:
                return found
            continue
        if found[0] == "typedef":
            if i == at:
                return found
            continue
        for j in range(i, min(len(lines), i + BRACE_WITHIN)):
            if "{" in lines[j]:
                return found
            if ";" in lines[j]:
                break
    return None


@dataclass
class Hunk:
    path: str
    header: str
    lines: list[tuple[str, str]] = field(default_factory=list)


def hunks(diff: str) -> Iterator[Hunk]:
    """Hunks of C-like files, with lines as (mark, text)."""
    path, current = "", None
    for line in diff.split("\n"):
        if line.startswith("diff --git ") or line.startswith("--- "):
            if current:
                yield current
            current = None
            if line.startswith("--- a/"):
                path = line[6:].split("\t")[0]
        elif line.startswith("+++ ") and current is None:
            if line.startswith("+++ b/"):
                path = line[6:].split("\t")[0]
        elif m := _HUNK.match(line):
            if current:
                yield current
            current = Hunk(path, m[5].strip()) if _C_LIKE.search(path) else None
        elif current is not None and line[:1] in ("+", "-", " "):
            current.lines.append((line[0], line[1:]))
        elif current is not None and line == "":
            current.lines.append((" ", ""))
    if current:
        yield current


def changes(hunk: Hunk) -> list[tuple[str | None, set[str]]]:
    """(symbol changed, names called in the changed lines), in order; the header's function only for lines within it."""
    out: dict[str | None, set[str]] = {}
    texts = [t for _, t in hunk.lines]
    head = named(hunk.header) if hunk.header else None
    for i, (mark, text) in enumerate(hunk.lines):
        if mark == " " or not text.strip():
            continue
        found = walk_back(texts, i)
        closed = any(t.startswith("}") for t in texts[:i])
        if not found and head and not closed:
            found = head
        name = symbol(*found) if found else None
        called = set(calls_in(text)) - ({found[1]} if found else set())
        out.setdefault(name, set()).update(called)
    return [(k, v) for k, v in out.items() if k or v]


DIFF_HUNKS = "hunk int, file_path string, hunk_header string, modifies string, calls array<string>"


def parse_diff(diff: str) -> list[tuple]:
    """Rows of DIFF_HUNKS; a hunk that changes two symbols is two rows."""
    return [(n, h.path, h.header, name, sorted(called)) for n, h in enumerate(hunks(diff)) for name, called in changes(h)]


def symbols_of_diff(text: str) -> list[str]:
    """Sorted names that a diff within a text changes; none where no diff begins at a line's start."""
    if not re.search(r"(?m)^(diff --git |--- a/|\+\+\+ b/|@@ -)", text):
        return []
    return sorted({row[3] for row in parse_diff(text) if row[3]})


def unified(old: str | None, new: str | None, path: str, context: int = 3) -> str:
    """The diff of two texts of a file; hunks are headed by the declaration they lie in."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    if a == b:
        return ""
    names = (f"a/{path}" if old is not None else "/dev/null", f"b/{path}" if new is not None else "/dev/null")
    out = []
    for line in difflib.unified_diff(a, b, *names, n=context, lineterm=""):
        if m := _HUNK.match(line):
            at = int(m[1]) - 2
            held = walk_back(a, at) if 0 <= at < len(a) else None
            line += f" {symbol(*held)}" if held else ""
        out.append(line)
    return f"diff --git a/{path} b/{path}\n" + "\n".join(out) + "\n"


def diff_hunks(commits: DataFrame) -> DataFrame:
    """Rows of DIFF_HUNKS of every commit's diff, with its git_sha."""
    return map_rows(commits.select("git_sha", "diff"), lambda key, diff: ((key, *row) for row in parse_diff(diff or "")), "git_sha string, " + DIFF_HUNKS)


def diff_texts(pairs: DataFrame) -> DataFrame:
    """(file_path, diff) of (file_path, old, new)."""
    return map_rows(pairs.select("file_path", "old", "new"), lambda path, old, new: [(path, unified(old, new, path))], "file_path string, diff string")


def register(spark) -> None:
    """SQL names: the table function ``diff_hunks(diff)`` and the functions ``diff_symbols`` and ``snip_quotes``."""
    from pyspark.sql.functions import pandas_udf, udtf

    from ..functions.snip import snip_quotes

    class DiffHunks:
        def eval(self, diff: str):
            yield from parse_diff(diff or "")

    spark.udtf.register("diff_hunks", udtf(DiffHunks, returnType=DIFF_HUNKS))
    spark.udf.register("diff_symbols", pandas_udf(lambda s: s.map(lambda x: symbols_of_diff(x or "")), "array<string>"))
    spark.udf.register("snip_quotes", pandas_udf(lambda s: s.map(lambda x: snip_quotes(x or "")), "string"))
