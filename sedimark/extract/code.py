"""Functions, types, typedefs and macros of C, Rust and Python sources, by a hand-written scanner.

Comments and strings are blanked first, character for character, so that braces and
names are found in a text of the same length as the source, and bodies are cut from the source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import KEYWORDS, PRIMITIVES
from ..rows import map_rows

_NOT_CALLED = {*KEYWORDS, "defined", "alignof", "_Alignof", "__attribute__", "asm", "__asm__", "fn", "match", "loop", "Some", "Ok", "Err", "None", "and", "or", "not", "in", "is", "elif", "except", "with", "assert", "lambda", "yield", "raise", "del", "class", "def"}
_CALL = re.compile(r"(?<![\w])([A-Za-z_]\w*)\s*\(")
_QUALIFIERS = re.compile(r"\b(const|volatile|static|extern|inline|register|__inline__|__inline|__always_inline|restrict)\b")


@dataclass
class Found:
    kind: str  # function, macro, struct, union, enum, class, typedef
    name: str
    line_start: int
    line_end: int
    text: str
    return_type: str = ""
    parameters: list[tuple[str, str]] = field(default_factory=list)
    fields: list[tuple[str, str]] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)


def blank(source: str, language: str) -> str:
    """The source with comments and the insides of strings as spaces; lines stay where they are."""
    if language == "python":
        token = r"#[^\n]*|(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z))|(?:'''[\s\S]*?(?:'''|\Z))|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
    elif language == "rust":
        token = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|r#\"[\s\S]*?\"#|\"(?:\\[\s\S]|[^\"\\])*\"?|'(?:\\.[^']*|[^'\\\n])'"
    else:
        token = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\[\s\S]|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+'"
    return re.sub(token, lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _close(text: str, at: int, pair: str = "{}") -> int:
    """Where the bracket at ``at`` closes; the text's end where it doesn't."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.start()
    return len(text)


def _split(text: str, by: str = ",") -> list[str]:
    """At separators outside brackets of any kind."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and text[i - 1 : i] != "-"):
            depth -= 1
        elif c == by and depth <= 0:
            out.append(text[start:i])
            start = i + 1
    return [x for x in (*out, text[start:]) if x.strip()]


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _with_comments(source: str, start: int) -> int:
    """The start of the comment lines right above."""
    lines_start = source.rfind("\n", 0, start) + 1
    while lines_start > 0:
        above = source.rfind("\n", 0, lines_start - 1) + 1
        line = source[above : lines_start - 1].strip()
        if not line or not (line.startswith(("//", "/*", "*", "///", "#[")) or line.endswith("*/")):
            break
        lines_start = above
    return lines_start


def calls_in(text: str) -> list[str]:
    """Names before a parenthesis, members by their last name; sorted, each once."""
    return sorted({m[1] for m in _CALL.finditer(text) if m[1] not in _NOT_CALLED})


def _types_in(declarations: list[str]) -> list[str]:
    names = {bare_type(d) for d in declarations}
    return sorted(n for n in names if n and not all(w in PRIMITIVES for w in n.split()))


def bare_type(text: str) -> str:
    text = _QUALIFIERS.sub(" ", re.sub(r"\[[^\]]*\]", " ", text))
    text = re.sub(r"[*&]|\b(struct|union|enum|mut|dyn)\b|\b__\w+|'\w+", " ", text)
    return re.sub(r"\s+", " ", text).strip()


def c_parameters(text: str) -> list[tuple[str, str]]:
    """(name, type) of a C parameter list; unnamed ones have an empty name, ``void`` alone is none."""
    out = []
    for part in _split(text):
        part = re.sub(r"\s+", " ", part).strip()
        if part in ("void", ""):
            continue
        if part == "...":
            out.append(("...", "..."))
        elif m := re.match(r"^(.*)\(\s*\*\s*(\w*)\s*\)\s*(\(.*\))$", part):
            out.append((m[2], f"{m[1].strip()} (*){m[3]}"))
        elif (m := re.match(r"^(.*?)(\w+)\s*((?:\[[^\]]*\])*)$", part)) and m[1].strip() and (m[1].rstrip()[-1] in "*&" or bare_type(m[1])):
            out.append((m[2], (m[1].strip() + m[3]).strip()))
        else:
            out.append(("", part))
    return out


_C_FUNCTION = re.compile(r"(?m)^(?P<type>[A-Za-z_][\w\s*]*?[\s*])(?P<name>[A-Za-z_]\w*)\s*\((?P<args>[^;{}()]*(?:\([^;{}()]*\)[^;{}()]*)*)\)\s*(?:__\w+(?:\([^)]*\))?\s*)*(?P<end>[;{])")
_C_TYPE = re.compile(r"\b(struct|union|enum)\s+(\w+)\s*\{")
_C_TYPEDEF = re.compile(r"(?m)^\s*typedef\b")
_C_MACRO = re.compile(r"(?m)^[ \t]*#[ \t]*define[ \t]+(\w+)\(([^)]*)\)((?:[^\n\\]|\\[\s\S])*)")


def _members(text: str, enum: bool) -> list[tuple[str, str]]:
    if enum:
        return [(m[0], "") for part in _split(text) if (m := re.match(r"\w+", part.strip()))]
    out = []
    text = re.sub(r"\{[^{}]*\}", " ", text)
    for declaration in text.split(";"):
        declaration = re.sub(r"\s+", " ", declaration).strip()
        if not declaration or "(" in declaration:
            continue
        first, *others = _split(declaration)
        m = re.match(r"^(.*?)([*\s]+)(\w+)\s*((?:\[[^\]]*\])*)\s*(?::\s*\w+)?$", first)
        if not m or not m[1].strip():
            continue
        base = m[1].strip()
        out.append((m[3], (base + " " + m[2].strip()).strip() + m[4]))
        for other in others:
            if o := re.match(r"^\s*(\**)\s*(\w+)\s*((?:\[[^\]]*\])*)", other):
                out.append((o[2], (base + " " + o[1]).strip() + o[3]))
    return out


def extract_c(source: str) -> list[Found]:
    out: list[Found] = []
    plain = blank(source, "c")
    directives = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\[\s\S])*", lambda m: re.sub(r"[^\n]", " ", m[0]), plain)
    for m in _C_MACRO.finditer(plain):
        text = source[m.start() : m.end()].strip("\n")
        line = _line(source, m.start(1))
        out.append(Found("macro", m[1], line, line + m[0].count("\n"), text, "", [(p.strip(), "") for p in m[2].split(",") if p.strip()], calls=calls_in(m[3])))
    at = 0
    while m := _C_FUNCTION.search(directives, at):
        name, kind = m["name"], bare_type(m["type"])
        words = m["type"].split()
        if name in _NOT_CALLED or not words or words[0] in ("return", "else", "goto", "typedef", "case") or not kind and "void" not in words and "*" not in m["type"]:
            at = m.end("name")
            continue
        end = _close(directives, m.start("end")) if m["end"] == "{" else m.start("end")
        start = _with_comments(source, m.start())
        parameters = c_parameters(m["args"])
        returned = re.sub(r"\s+", " ", re.sub(r"\b(static|extern|inline|__always_inline|__inline__|__init|__exit)\b", " ", m["type"])).strip() or "void"
        body = directives[m.start("end") : end + 1] if m["end"] == "{" else ""
        found = Found("function", name, _line(source, m.start("name")), _line(source, min(end, len(source) - 1)), source[start : end + 1], returned, parameters)
        if body:
            found.calls = calls_in(body)
            locals_ = re.findall(r"(?m)^\s*((?:struct|union|enum)\s+\w+|[A-Za-z_]\w*_t)\s+\**\s*\w+\s*[;=,\[]", body)
            found.types = _types_in([*(t for _, t in parameters if t != "..."), returned, *locals_])
        out.append(found)
        at = end + 1
    for m in _C_TYPE.finditer(directives):
        end = _close(directives, m.end() - 1)
        members = _members(directives[m.end() : end], m[1] == "enum")
        out.append(Found(m[1], m[2], _line(source, m.start(2)), _line(source, min(end, len(source) - 1)), source[_with_comments(source, m.start()) : end + 1], fields=members, types=_types_in([t for _, t in members if t])))
    for m in _C_TYPEDEF.finditer(directives):
        end, depth = m.end(), 0
        while end < len(directives) and (directives[end] != ";" or depth):
            depth += (directives[end] == "{") - (directives[end] == "}")
            end += 1
        text = directives[m.end() : end]
        named = re.search(r"\(\s*\*\s*(\w+)\s*\)", text) or re.search(r"(\w+)\s*(?:\[[^\]]*\]\s*)*$", text)
        if named:
            under = re.sub(r"\s+", " ", text[: named.start(1)] if "(" not in text else text).strip()
            out.append(Found("typedef", named[1], _line(source, m.end() + named.start(1)), _line(source, min(end, len(source) - 1)), f"// Underlying type: {under}\n{source[m.start() : end + 1].strip()}", types=_types_in([under] if not set("{(") & set(under) else [])))
    return out


def extract_rust(source: str) -> list[Found]:
    out: list[Found] = []
    plain = blank(source, "rust")
    for m in re.finditer(r"\bfn\s+(\w+)\s*(?:<[^>{(]*>)?\s*\(", plain):
        close = _close(plain, m.end() - 1, "()")
        rest = re.compile(r"[;{]").search(plain, close)
        if not rest:
            continue
        end = _close(plain, rest.start()) if rest[0] == "{" else rest.start()
        arrow = re.search(r"->\s*([^{;]*?)\s*(?:\bwhere\b|$)", plain[close + 1 : rest.start()])
        parameters = []
        for part in _split(plain[m.end() : close]):
            name, colon, kind = part.partition(":")
            parameters.append((name.replace("mut ", "").strip(), re.sub(r"\s+", " ", kind).strip() if colon else "Self"))
        start = _with_comments(source, plain.rfind("\n", 0, m.start()) + 1)
        found = Found("function", m[1], _line(source, m.start(1)), _line(source, min(end, len(source) - 1)), source[start : end + 1], arrow[1].strip() if arrow else "void", parameters)
        if rest[0] == "{":
            found.calls = calls_in(plain[rest.start() : end + 1])
            found.types = _types_in([t for _, t in parameters if t != "Self"])
        out.append(found)
    for m in re.finditer(r"\b(struct|enum)\s+(\w+)\s*(?:<[^>{]*>)?\s*(?:where[^{;]*)?([{;(])", plain):
        end = _close(plain, m.end() - 1) if m[3] == "{" else plain.find(";", m.end() - 1)
        members = []
        if m[3] == "{":
            for part in _split(plain[m.end() : end]):
                name, colon, kind = part.partition(":")
                name = re.sub(r"#\[[^\]]*\]|\bpub(\([^)]*\))?", " ", name).split("(")[0].split("{")[0].strip()
                members.append((name, re.sub(r"\s+", " ", kind).strip() if colon and m[1] == "struct" else ""))
        out.append(Found(m[1], m[2], _line(source, m.start(2)), _line(source, end), source[_with_comments(source, plain.rfind("\n", 0, m.start()) + 1) : end + 1], fields=[x for x in members if x[0]], types=_types_in([t for _, t in members if t])))
    return out


def extract_python(source: str) -> list[Found]:
    out: list[Found] = []
    plain = blank(source, "python")
    lines, plain_lines = source.split("\n"), plain.split("\n")
    for m in re.finditer(r"(?m)^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", plain):
        first = _line(plain, m.start(3))
        header = plain.find(":", _close(plain, m.end(), "()")) if plain[m.end() : m.end() + 200].lstrip()[:1] == "(" else plain.find(":", m.end())
        last = _line(plain, max(header, m.end()))
        indent = len(m[1].expandtabs())
        for i in range(last, len(lines)):
            own = plain_lines[i]
            if lines[i].strip() and own.strip() and len(own.expandtabs()) - len(own.expandtabs().lstrip()) <= indent:
                break
            if lines[i].strip():
                last = i + 1
        text = "\n".join(lines[first - 1 : last])
        body = "\n".join(plain_lines[first:last]) + plain[max(header, m.end()) : plain.find("\n", max(header, m.end()))]
        if m[2] == "class":
            out.append(Found("class", m[3], first, last, text))
            continue
        parameters = []
        arguments = plain[m.end() : max(header, m.end())]
        if (a := arguments.find("(")) >= 0:
            for part in _split(arguments[a + 1 : _close(arguments, a, "()")]):
                name, colon, kind = part.split("=")[0].partition(":")
                if name.strip() not in ("*", "/"):
                    parameters.append((name.strip(), kind.strip() if colon else ""))
        arrow = re.search(r"->\s*(.+)$", arguments.strip(), re.S)
        out.append(Found("function", m[3], first, last, text, arrow[1].strip() if arrow else "void", parameters, calls=calls_in(body), types=_types_in([k for _, k in parameters if k])))
    return out


def extract(source: str, path: str) -> list[Found]:
    """By the file's extension; nothing for others.  Per file one row a name and kind: that with a body, then the longest."""
    ending = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    by = extract_rust if ending == "rs" else extract_python if ending == "py" else extract_c if ending in ("c", "h", "cc", "cpp", "cxx", "c++", "hh", "hpp", "hxx", "h++") else None
    best: dict[tuple[str, str], Found] = {}
    for f in by(source) if by else ():
        key = (f.name, f.kind)
        rank = lambda x: (bool(x.calls or "{" in x.text) and bool(x.parameters), x.line_end - x.line_start, len(x.text), len(x.parameters) + len(x.fields))
        if key not in best or rank(f) > rank(best[key]):
            best[key] = f
    return list(best.values())


_PAIR = "array<struct<name:string,type_name:string>>"
EXTRACTED = f"kind string, name string, file_path string, git_file_hash string, line_start bigint, line_end bigint, return_type string, parameters {_PAIR}, fields {_PAIR}, body string, calls array<string>, types array<string>"


def _extracted(path: str | None, sha: str | None, content: str | None) -> Iterator[tuple]:
    pairs = lambda x: [{"name": a, "type_name": b} for a, b in x]
    for f in extract(content or "", path or ""):
        yield f.kind, f.name, path, sha, f.line_start, f.line_end, f.return_type, pairs(f.parameters), pairs(f.fields), f.text, f.calls or None, f.types or None


def extract_sources(sources: DataFrame) -> DataFrame:
    """One row per function, macro and type of (file_path, git_file_hash, content); a narrow pass over whole files."""
    return map_rows(sources.select("file_path", "git_file_hash", "content"), _extracted, EXTRACTED)


def functions_of(extracted: DataFrame) -> DataFrame:
    """Rows of the functions table and their bodies."""
    hash_ = F.when(F.col("body") != "", F.sha2(F.col("body").cast("binary"), 256))
    return extracted.where("kind IN ('function', 'macro')").select("name", "file_path", "git_file_hash", "line_start", "line_end", F.when(F.col("kind") == "macro", "").otherwise(F.col("return_type")).alias("return_type"), "parameters", hash_.alias("body_hash"), "calls", "types", "body")


def types_of(extracted: DataFrame) -> DataFrame:
    """Rows of the types table and their definitions."""
    return extracted.where("kind NOT IN ('function', 'macro')").select("name", "file_path", "git_file_hash", F.col("line_start").alias("line"), "kind", F.lit(None).cast("bigint").alias("size"), "fields", F.sha2(F.col("body").cast("binary"), 256).alias("definition_hash"), "types", F.col("body").alias("definition"))


def resolve_parameter_types(functions: DataFrame, types: DataFrame) -> DataFrame:
    """(name, file_path, git_file_hash, position, parameter, type_name, type_file_path, type_git_file_hash): by bare type name, same file first."""
    from pyspark.sql import Window

    from ..functions.text import clean_type

    params = functions.select("name", "file_path", "git_file_hash", F.posexplode("parameters").alias("position", "p"))
    params = params.select("name", "file_path", "git_file_hash", "position", F.col("p.name").alias("parameter"), F.col("p.type_name").alias("type_name"), clean_type(F.col("p.type_name")).alias("bare"))
    known = types.select(F.col("name").alias("bare"), F.col("file_path").alias("type_file_path"), F.col("git_file_hash").alias("type_git_file_hash")).distinct()
    w = Window.partitionBy("name", "file_path", "git_file_hash", "position").orderBy((F.col("type_file_path") == F.col("file_path")).desc_nulls_last(), "type_file_path", "type_git_file_hash")
    return params.join(known, "bare", "left").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "bare")
