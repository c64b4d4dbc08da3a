"""Definitions, calls, imports and top-level pieces of source code: Python by its own parser, Ruby by its keywords, languages with braces by
one scan of the text without strings and comments.

A scan is linear: brackets are matched once, and what stands before each opening brace tells what it opens. Null and empty files have
no rows; broken files give what can be read.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.urls import SUFFIXES
from tessera.operators.call_graph import resolved_modules

#: Grammar names by suffix.
LANGUAGES = {"js": "javascript", "py": "python", "ts": "typescript", "cs": "c_sharp", "rb": "ruby"}
SCRIPTS = ("javascript", "typescript", "jsx", "tsx")
BRACES = (*SCRIPTS, "java", "c_sharp", "cpp", "go", "php")
#: Strings and comments, by language; the first group holds a comment.
_SLASHES, _DOUBLE, _SINGLE, _BACK = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r"`(?:\\.|[^`\\])*`?"
_PATTERN = r"(?:(?<=[=(,:!&|?;\[{}])|(?<=[=(,:!&|?;\[{}] )|(?<=return ))/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_PREPROCESSOR = r"^[ \t]*#(?:[^\n\\]|\\.)*"
_COMMENTS = {"php": rf"{_SLASHES}|#(?!\[)[^\n]*|<\?(?:php\b|=)?|\?>", "cpp": f"{_SLASHES}|{_PREPROCESSOR}", "c_sharp": f"{_SLASHES}|{_PREPROCESSOR}"}
_QUOTES = {
    "go": f"`[^`]*`?|{_DOUBLE}|{_SINGLE}", "c_sharp": rf'@"(?:""|[^"])*"?|{_DOUBLE}|{_SINGLE}', "cpp": f"{_DOUBLE}|{_SINGLE}", "java": rf'""".*?(?:"""|\Z)|{_DOUBLE}|{_SINGLE}', "php": r'"(?:\\.|[^"\\])*"?' + r"|'(?:\\.|[^'\\])*'?",
}
OPAQUE = {lang: re.compile(f"({_COMMENTS.get(lang, _SLASHES)})|{_QUOTES.get(lang, f'{_DOUBLE}|{_SINGLE}|{_BACK}|{_PATTERN}')}", re.S | re.M) for lang in BRACES}
OPAQUE["ruby"] = re.compile(r"(#[^\n]*|^=begin\b.*?(?:^=end\b[^\n]*|\Z))|" + _DOUBLE + "|" + _SINGLE, re.S | re.M)
#: What stands before a brace that opens a class, or a function.
CLASS = re.compile(r"\b(?:class|interface|enum|record|struct|trait|union)\s+(?!struct\b|class\b)(?P<name>[\w$]+)(?![^(]*\)\s*:)")
GO_TYPE = re.compile(r"\btype\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\s*$")
GO_FUNCTION = re.compile(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?\s*(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)")
NAMED_FUNCTION = re.compile(r"\bfunction\s*[*&]?\s*(?P<name>[\w$]+)\s*$")
BOUND_FUNCTION = re.compile(r"(?P<static>\bstatic\s+)?(?:[\w$]+\.)*(?P<name>[#\w$]+)\s*(?::[^=()]+)?(?P<by>=|:)\s*(?:async\s*)?(?:function\s*[*]?\s*[\w$]*\s*)?$")
PLAIN_ARROW = re.compile(r"(?P<static>\bstatic\s+)?(?P<name>[#\w$]+)\s*(?::[^=()]+)?(?P<by>=|:)\s*(?:async\s+)?[\w$]+\s*$")
METHOD = re.compile(r"(?P<owner>(?:\w+::)+)?(?P<name>[~#]?[\w$]+)\s*(?:<[^<>()]*>)?\s*$")
#: What may stand between a function's arguments and its body.
INITIALISERS = re.compile(r"\)\s*:(?!:)\s*[\w.:<>]+\s*[({]")
TAIL = re.compile(r"\s*(?:=>|->\s*[\w\s:<>,*&?|\[\]]+|:\s*(?!:)[^;]*|(?:\s*(?:const|override|noexcept|final|mutable|async|throws\s+[\w.,\s]+|where\s+[\w\s:,<>]+))*|[\w\s.*\[\]{}]*)\s*$")
ARROW = re.compile(r"(?P<static>\bstatic\s+)?(?P<name>[\w$]+)\s*(?::[^=;(){}]+)?(?P<by>=|:)\s*(?:async\s*)?(?:\((?P<args>[^()]*)\)\s*(?::[^={;]+)?|[\w$]+\s*)=>(?!\s*\{)")
CALL = re.compile(r"(?<![\w$.])(?:(?P<on>this|self|[\w$]+)(?:\.|->|::))?(?P<name>[\w$]+)\s*\(")
#: Words before an opening parenthesis that are no names.
WORDS = frozenset("if for foreach while switch catch using lock synchronized fixed return sizeof await typeof new super constructor do else with elseif match unless until and or not in defined function func fn def class yield throw case".split())
RUBY_OPEN = re.compile(r"(?P<def>^[ \t]*def\s+(?:self\.)?(?P<method>[\w?!=.]+))|(?P<class>^[ \t]*(?:class|module)\s+(?P<name>[\w:]+))|(?P<block>^[ \t]*(?:if|unless|while|until|case|begin|for)\b|=\s*(?:if|unless|case|begin)\b|\bdo\b(?=\s*(?:\|[^|\n]*\|)?\s*$))|(?P<end>(?:^|[;\s])end\b)", re.M)
IMPORT = re.compile(r"import\s+(?:type\s+)?(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\{(?P<names>[^}]*)\}|\*\s*as\s+(?P<space>[\w$]+))?\s*from\s*$|(?:const|let|var)\s+(?:\{(?P<picked>[^}]*)\}|(?P<whole>[\w$]+))\s*=\s*require\s*\(\s*$")


def language(suffix: str) -> str:
    name = suffix.lstrip(".")
    return LANGUAGES.get(name, name)


class Place:
    """Line and column, from 1, of offsets in a text."""

    def __init__(self, code: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", code))]

    def __call__(self, at: int) -> dict:
        line = bisect.bisect_right(self.starts, at)
        return {"line": line, "column": at - self.starts[line - 1] + 1}

    def offset(self, code: str, row: int, column: int) -> int:
        """The offset of a line from 1 and a column in UTF-8 bytes."""
        if row > len(self.starts):
            return len(code)
        start = self.starts[row - 1]
        line = code[start : self.starts[row] if row < len(self.starts) else len(code)]
        return start + (column if line.isascii() else len(line.encode()[:column].decode(errors="ignore")))


def blanked(code: str, lang: str) -> tuple[str, list[tuple[int, int]]]:
    """The code with spaces in place of strings and comments, and the comments' spans."""
    comments = []

    def blank(m: re.Match) -> str:
        if m[1] is not None:
            comments.append(m.span())
        return "".join("\n" if c == "\n" else " " for c in m[0])

    return (OPAQUE[lang].sub(blank, code) if lang in OPAQUE else code), comments


def brackets(blank: str) -> dict[int, int]:
    """The closing bracket of each opening one, and the other way round; what is never closed ends with the text."""
    pairs, stack, closes, opened = {}, [], {")": "(", "]": "[", "}": "{"}, {"(": 0, "[": 0, "{": 0}
    for m in re.finditer(r"[][(){}]", blank):
        if m[0] in "([{":
            stack.append((m[0], m.start()))
            opened[m[0]] += 1
        elif opened[closes[m[0]]]:  # those left open before it end with it
            while stack:
                kind, at = stack.pop()
                opened[kind] -= 1
                pairs[at] = m.start()
                if kind == closes[m[0]]:
                    pairs[m.start()] = at
                    break
    return pairs | {at: len(blank) for _, at in stack}


def python_definitions(code: str) -> list[dict]:
    """One row for each function, class and method, with its qualified name, in the order of the source."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return []
    place = Place(code)
    offset = lambda row, column: place.offset(code, row, column)
    out = []
    todo = [(tree, "", False)]
    while todo:
        node, owner, in_class = todo.pop()
        inner = []
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                name = f"{owner}.{child.name}" if in_class else child.name
                kind = "Class" if is_class else "Constructor" if in_class and child.name == "__init__" else "Method" if in_class else "Function"
                out.append({"type": kind, "name": name, "from": offset(child.lineno, child.col_offset), "to": offset(child.end_lineno, child.end_col_offset)})
                inner.append((child, name, is_class))
            else:
                inner.append((child, owner, in_class))
        todo += reversed(inner)
    return sorted(out, key=lambda d: d["from"])


def opened_by(header: str, lang: str, inside: str, pairs: dict[int, int], begin: int) -> tuple[str, str, int] | None:
    """(kind, name, place of the name) of what a header opens: kind is Class, Function or Method; None for a block, an object, a callback.
    ``inside`` is the kind of what encloses it."""
    if lang == "go":
        if m := GO_FUNCTION.search(header):
            return ("Method" if m["owner"] else "Function"), f"{m['owner']}.{m['name']}" if m["owner"] else m["name"], m.start("name")
        return ("Class", m["name"], m.start("name")) if (m := GO_TYPE.search(header)) else None
    if m := CLASS.search(header):
        return "Class", m["name"], m.start("name")
    if lang in ("cpp", "c_sharp") and (m := INITIALISERS.search(header)):
        header = header[: m.start() + 1]
    arrow = header.rstrip().endswith("=>")
    last = header.rfind(")")
    first = pairs.get(begin + last, -1) - begin if last >= 0 else -1
    if first < 0:
        m = arrow and lang in SCRIPTS and PLAIN_ARROW.search(header.rstrip()[:-2])
        return bound(m, inside) if m else None
    if not TAIL.match(header, last + 1):
        return None
    before = header[:first]
    if m := NAMED_FUNCTION.search(before):
        if lang in SCRIPTS and re.search(r"[=(,:]\s*(?:async\s+)?function\s*[*]?\s*[\w$]+\s*$", before):
            return bound(b, inside) if (b := BOUND_FUNCTION.search(before)) else None
        return ("Method" if inside == "Class" else "Function"), m["name"], m.start("name")
    if lang in SCRIPTS and (arrow or re.search(r"\bfunction\s*[*]?\s*$", before)):
        return bound(m, inside) if (m := BOUND_FUNCTION.search(before)) else None
    m = METHOD.search(before)
    if not m or m["name"] in WORDS - {"constructor"} or lang in SCRIPTS and inside not in ("Class", "Object") or lang == "php":
        return None
    if lang not in SCRIPTS and inside not in ("Class", "", "Space") or re.search(r"(?:\bnew|[=.,(])\s*$", before[: m.start()]):
        return None
    owner = (m["owner"] or "").replace("::", ".")
    kind = "Method" if inside == "Class" or owner else "Function"
    return kind, ("static." if lang in SCRIPTS and re.search(r"\bstatic\s+(?:async\s+)?[*]?\s*$", before[: m.start()]) else "") + owner + m["name"], m.start("name")


def bound(m: re.Match, inside: str) -> tuple[str, str, int] | None:
    """A function that is a variable's, a property's or a field's value."""
    if m["name"] in WORDS or m["by"] == ":" and inside != "Object":
        return None
    return ("Method" if inside == "Class" else "Function"), ("static." if m["static"] else "") + m["name"], m.start("name")


def brace_definitions(code: str, lang: str) -> list[dict]:
    """Classes, functions and methods of a language with braces. Methods have their class's name before theirs."""
    blank, _ = blanked(code, lang)
    pairs = brackets(blank)
    out, around, begin = [], [], 0  # around: (end, kind, name, where the header goes on) of open braces
    parens: list[bool] = []  # open parentheses, and braces between them
    for m in re.finditer(r"[;{}(),]", blank):
        at, mark = m.start(), m[0]
        resume = None
        while around and at >= around[-1][0] - (mark == "}"):
            resume = around.pop()[3]
        if mark in "()":
            if mark == "(":
                parens.append(True)
            elif parens and parens[-1]:
                parens.pop()
            continue
        in_parens = bool(parens) and parens[-1]
        if mark == "{":
            if lang == "go" and (own := list(re.finditer(r"^(?:func|type)\b", blank[begin:at], re.M))):
                begin += own[-1].start()
            start = begin
            if in_parens:  # the body of an argument: its header begins behind the last opening or comma
                start = max(blank.rfind("(", begin, at), blank.rfind(",", begin, at)) + 1
                close = blank.rfind(")", start, at)
                start = max(blank.rfind(x, begin, pairs.get(close, start)) for x in "(,") + 1 if close >= 0 and pairs.get(close, at) < start else start
            header = blank[start:at]
            skipped = len(header) - len(header.lstrip())
            inside = around[-1][1] if around else ""
            found = None if in_parens else opened_by(header.lstrip(), lang, inside, pairs, start + skipped)
            stop = min(pairs.get(at, len(blank)) + 1, len(blank))
            later = begin if in_parens else None
            if found:
                kind, name, place = found
                owner = next((a[2] for a in reversed(around) if a[1] == "Class"), "") if inside == "Class" else ""
                simple = name.rsplit(".", 1)[-1]
                constructor = kind == "Method" and simple in ("constructor", "__construct", owner.rsplit(".", 1)[-1] if owner else None)
                name = f"{owner}.{name}" if owner else name
                out.append({"type": "Constructor" if constructor else kind, "name": name, "from": start + skipped, "to": stop, "at": start + skipped + place})
                around.append((stop, kind, name, later))
            elif re.search(r"\bnamespace\b[\s\w.:\\]*$|\bextern\s*$", header):
                around.append((stop, "Space", "", later))
            else:
                is_object = lang in SCRIPTS and re.search(r"(?:[=(:,?\[]|\breturn|=>)\s*$|^\s*$", header) and (in_parens or header.strip())
                around.append((stop, "Object" if is_object else "Block", "", later))
            parens.append(False)
            begin = at + 1
        elif mark == "}":
            while parens and parens.pop():
                pass
            begin = at + 1 if resume is None else resume
        elif mark == ";" and not in_parens or mark == "," and around and around[-1][1] == "Object" and not in_parens:
            begin = at + 1
    if lang in SCRIPTS:  # functions of one expression
        holders = sorted((d["from"], d["to"], d["type"], d["name"]) for d in out)
        over, known = [], 0  # definitions over the place, outermost first
        for m in ARROW.finditer(blank):
            while known < len(holders) and holders[known][0] <= m.start():
                over = [*(h for h in over if h[1] > holders[known][0]), holders[known]]
                known += 1
            over = [h for h in over if h[1] > m.start()]
            opening = max((i for i in (blank.rfind("(", 0, m.start()),) if i >= 0), default=-1)
            if m["name"] in WORDS or opening >= 0 and pairs.get(opening, -1) > m.start() and m["by"] == ":":
                continue
            owner = next((h for h in reversed(over) if h[2] == "Class"), None)
            direct = owner and over[-1] is owner
            end = next((x.start() for x in re.compile(r"[;\n]").finditer(blank, m.end()) if not open_at(pairs, blank, m.end(), x.start())), len(blank))
            name = ("static." if m["static"] else "") + m["name"]
            line = blank.rfind("\n", 0, m.start()) + 1
            start = max(line, blank.rfind(";", line, m.start()) + 1, blank.rfind("{", line, m.start()) + 1)
            start += len(blank[start : m.start()]) - len(blank[start : m.start()].lstrip())
            out.append({"type": "Method" if direct else "Function", "name": f"{owner[3]}.{name}" if direct else name, "from": start, "to": end, "at": m.start("name")})
    return sorted(out, key=lambda d: (d["from"], -d["to"]))


def open_at(pairs: dict[int, int], blank: str, begin: int, at: int) -> bool:
    """Whether a bracket that opens in [begin, at) is still open at ``at``."""
    m = re.compile(r"[\[({]").search(blank, begin, at)
    while m:
        if pairs.get(m.start(), len(blank)) > at:
            return True
        m = re.compile(r"[\[({]").search(blank, pairs[m.start()], at)
    return False


def ruby_definitions(code: str) -> list[dict]:
    """Classes, modules and methods of Ruby, which end at their ``end``."""
    blank, _ = blanked(code, "ruby")
    out, around = [], []
    for m in RUBY_OPEN.finditer(blank):
        if m["end"]:
            if around and (d := around.pop()):
                d["to"] = m.end()
            continue
        owner = next((d["name"] for d in reversed(around) if d and d["type"] == "Class"), "")
        if m["block"]:
            around.append(None)
            continue
        name, start = m["method"] or m["name"], m.start() + len(m[0]) - len(m[0].lstrip())
        kind = "Class" if m["class"] else "Constructor" if owner and name == "initialize" else "Method" if owner else "Function"
        one_line = m["method"] and re.match(r"[^\n]*?(?:;\s*end\b|\)\s*=\s)", blank[m.end() :])
        d = {"type": kind, "name": f"{owner}.{name}" if owner else name, "from": start, "to": len(blank), "at": m.start("method" if m["method"] else "name")}
        out.append(d)
        if one_line and "=" in one_line[0] and ";" not in one_line[0]:  # a method of one expression has no end
            d["to"] = blank.find("\n", m.end()) if "\n" in blank[m.end() :] else len(blank)
        else:
            around.append(d)
    return out


def definitions_in(code: str, suffix: str) -> list[dict]:
    lang = language(suffix)
    found = python_definitions(code) if lang == "python" else ruby_definitions(code) if lang == "ruby" else brace_definitions(code, lang) if lang in BRACES else []
    place = Place(code)
    return [d | {"start": place(d["from"]), "stop": place(d["to"]), "code": code[d["from"] : d["to"]]} for d in found]


def call_sites(code: str, suffix: str, defs: list[dict] | None = None) -> list[dict]:
    """Calls inside a definition that is no class: rows (head, on, name, at), ``on`` what the name stands behind."""
    lang = language(suffix)
    defs = [d for d in (definitions_in(code, suffix) if defs is None else defs) if d["type"] != "Class"]
    blank = blanked(code, lang)[0]
    names = {d.get("at", -1) for d in defs}
    starts = sorted(range(len(defs)), key=lambda k: (defs[k]["from"], -defs[k]["to"]))
    out, stack, at = [], [], 0
    for m in CALL.finditer(blank):
        pos = m.start("name")
        while at < len(starts) and defs[starts[at]]["from"] < pos:
            stack.append(defs[starts[at]])
            at += 1
        while stack and stack[-1]["to"] <= pos:
            stack.pop()
        if not stack or m["name"] in WORDS or pos in names or re.search(r"\b(?:def|func|function|class|new)\s+$", blank[max(0, pos - 12) : pos]):
            continue
        out.append({"head": stack[-1], "on": m["on"] or "", "name": m["name"], "at": pos})
    return out


def calls_in(code: str, suffix: str) -> list[dict]:
    """Calls from one definition of the file to another: caller and callee are rows of definitions_in()."""
    defs, imported = definitions_in(code, suffix), {i["local"] for i in imports_in(code, suffix)}
    by_name: dict[str, dict] = {}
    for d in defs:
        if d["type"] != "Class":
            by_name.setdefault(d["name"].rsplit(".", 1)[-1], d)
    return [{"head": c["head"], "tail": by_name[c["name"]], "at": c["at"]} for c in call_sites(code, suffix, defs) if c["name"] in by_name and c["on"] not in imported]


def imports_in(code: str, suffix: str) -> list[dict]:
    """Imports of a JavaScript or TypeScript file: rows (local, module, name); a whole module has the name ``*``."""
    lang = language(suffix)
    if lang not in SCRIPTS:
        return []
    blank, _ = blanked(code, lang)
    out = []
    for q in re.finditer(r"\bfrom\s*(?=['\"])|\brequire\s*\(\s*(?=['\"])", code):
        if blank[q.start() : q.end()] != q[0] or not (path := re.compile(r"(['\"])([^'\"\n]*)\1").match(code, q.end())):
            continue
        line = max(blank.rfind(";", 0, q.start()), max((blank.rfind(w, 0, q.start()) for w in ("import", "const", "let", "var")), default=0) - 1) + 1
        m = IMPORT.search(blank[line : q.end()])
        if not m:
            continue
        for part in (m["names"] or m["picked"] or "").split(","):
            if part.strip():
                name, _, local = re.sub(r"^type\s+", "", part.strip()).replace(":", " as ").partition(" as ")
                out.append({"local": (local or name).strip(), "module": path[2], "name": name.strip()})
        out += [{"local": m[k], "module": path[2], "name": n} for k, n in (("default", "default"), ("space", "*"), ("whole", "*")) if m[k]]
    return out


def python_parts(code: str) -> list[str]:
    """Top-level statements with their decorators, and the comments between them."""
    try:
        body = ast.parse(code).body
    except (SyntaxError, ValueError):
        return [code] if code.strip() else []
    place = Place(code)
    spans = []
    for n in body:
        first = min([n, *getattr(n, "decorator_list", [])], key=lambda x: (x.lineno, x.col_offset))
        start = place.offset(code, first.lineno, first.col_offset)
        spans.append((code.rfind("@", 0, start) if first is not n else start, place.offset(code, n.end_lineno, n.end_col_offset)))
    starts = [a for a, _ in spans]
    try:
        for t in tokenize.generate_tokens(io.StringIO(code).readline):
            if t.type == tokenize.COMMENT:
                at = place.starts[t.start[0] - 1] + t.start[1]
                k = bisect.bisect_right(starts, at) - 1
                if k < 0 or at >= spans[k][1]:
                    spans.append((at, at + len(t.string)))
    except (tokenize.TokenError, IndentationError):
        pass
    return [code[a:b] for a, b in sorted(spans)]


def brace_parts(code: str, lang: str) -> list[str]:
    """Top-level statements, declarations and comments of a language with braces: a piece ends at a semicolon, at a closing brace that
    ends its line, or (scripts and Go) at a line end, outside of all brackets."""
    blank, comments = blanked(code, lang)
    pairs = brackets(blank)
    cuts, at, begin = [], 0, 0
    comment_starts = dict(comments)
    marks = re.compile(r"[;\n({\[]|" + (r"//|/\*|#" if comments else r"(?!)"))
    stops_line = lang in (*SCRIPTS, "go")
    ends, goes_on = re.compile(r"[ \t]*(?:\n|\Z)"), re.compile(r"\s*(?:[.?:+*/%&|]|=>|else\b|catch\b|finally\b)")
    while at < len(blank):
        if at in comment_starts and not blank[begin:at].strip():
            cuts.append((at, comment_starts[at]))
            at = begin = comment_starts[at]
            continue
        c = blank[at]
        if c in "({[":
            at = min(pairs.get(at, len(blank)), len(blank) - 1) + 1
            if c == "{" and ends.match(blank, at):
                cuts.append((begin, at))
                begin = at
            continue
        if c == ";" or c == "\n" and stops_line and blank[begin:at].strip() and blank[begin:at].rstrip()[-1] not in "=+-*/%&|<>?:,." and not goes_on.match(blank, at):
            cuts.append((begin, at + (c == ";")))
            begin = at + 1
        at += 1
    cuts.append((begin, len(code)))
    return [p for a, b in cuts if (p := code[a:b].strip())]


def top_level_parts(code: str, suffix: str) -> list[str] | None:
    """Top-level pieces of a file, in order, comments included; None for an unsupported language. White space between them is left out."""
    if suffix not in SUFFIXES:
        return None
    lang = language(suffix)
    if lang == "python":
        return python_parts(code)
    if lang in BRACES:
        return brace_parts(code, lang)
    return [p.strip() for p in re.split(r"\n(?=\S)(?!end\b)", code) if p.strip()]


POSITION = "struct<line:int,column:int>"


def code_definitions(files: DataFrame) -> DataFrame:
    """Rows (filepath, type, name, start, stop, code) of files (source, suffix, content)."""
    position = pa.struct([("line", pa.int32()), ("column", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, d) for s, x, c in zip(*(batch.column(i).to_pylist() for i in range(3))) for d in definitions_in(c or "", x or "")]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.string()), *(pa.array([d[k] for _, d in rows], position if k in ("start", "stop") else pa.string()) for k in ("type", "name", "start", "stop", "code"))], ["filepath", "type", "name", "start", "stop", "code"])

    return files.select("source", "suffix", "content").mapInArrow(run, f"filepath string, type string, name string, start {POSITION}, stop {POSITION}, code string")


def node_id(source: str, d: dict) -> str:
    from urllib.parse import quote

    return "/".join(quote(x, safe="!~*'()") for x in (source, d["name"], str(d["start"]["line"]), str(d["start"]["column"])))


def _rows(files: DataFrame, make, columns: dict[str, str]) -> DataFrame:
    """Rows that a function makes of each file, as columns of long or string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for file in zip(*(batch.column(i).to_pylist() for i in range(3))) for r in make(file[0], file[1] or "", file[2] or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if kind == "long" else pa.string()) for i, kind in enumerate(columns.values())], list(columns))

    return files.select("source", "suffix", "content").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in columns.items()))


EDGE = {"filepath": "string", "ord": "long", "head_id": "string", "head_label": "string", "tail_id": "string", "tail_label": "string"}


def code_calls(files: DataFrame) -> DataFrame:
    """Edges (filepath, ord, head_id, head_label, tail_id, tail_label) of calls inside each file."""

    def made(source: str, suffix: str, code: str) -> list[tuple]:
        return [(source, k, node_id(source, e["head"]), e["head"]["name"], node_id(source, e["tail"]), e["tail"]["name"]) for k, e in enumerate(calls_in(code, suffix))]

    return _rows(files, made, EDGE)


def node_places(files: DataFrame) -> DataFrame:
    """Rows (id, label, filepath, line, column, code): where each node of a call graph stands."""

    def made(source: str, suffix: str, code: str) -> list[tuple]:
        return [(node_id(source, d), d["name"], source, d["start"]["line"], d["start"]["column"], d["code"]) for d in definitions_in(code, suffix) if d["type"] != "Class"]

    return _rows(files, made, {"id": "string", "label": "string", "filepath": "string", "line": "long", "column": "long", "code": "string"})


def cross_file_calls(files: DataFrame) -> DataFrame:
    """Edges like code_calls() from a definition to one of another file that is imported from there: by its name, or behind the name
    of an imported module. Imports meet the files by path, calls the imports by (file, local name), and these the definitions by (file, name)."""

    def sites(source: str, suffix: str, code: str) -> list[tuple]:
        return [(source, k, node_id(source, c["head"]), c["head"]["name"], c["on"], c["name"]) for k, c in enumerate(call_sites(code, suffix))]

    def imports(source: str, suffix: str, code: str) -> list[tuple]:
        return [(source, i["local"], i["module"], i["name"]) for i in imports_in(code, suffix)]

    def exported(source: str, suffix: str, code: str) -> list[tuple]:
        return [(source, d["name"], node_id(source, d)) for d in definitions_in(code, suffix) if d["type"] == "Function"]

    calls = _rows(files, sites, {"filepath": "string", "ord": "long", "head_id": "string", "head_label": "string", "on": "string", "callee": "string"})
    found = _rows(files, imports, {"file": "string", "local": "string", "module": "string", "name": "string"}).distinct()
    targets = resolved_modules(found, files.select(F.col("source").alias("path"))).where("resolved is not null")
    nodes = _rows(files, exported, {"t_file": "string", "tail_label": "string", "tail_id": "string"}).groupBy("t_file", "tail_label").agg(F.min("tail_id").alias("tail_id"))
    behind = F.col("name") == "*"
    key = F.when(behind, F.col("on")).otherwise(F.when(F.col("on") == "", F.col("callee")))
    met = calls.join(targets, (calls["filepath"] == targets["file"]) & (F.when(F.col("on") == "", F.col("callee")).otherwise(F.col("on")) == targets["local"])).where(key == F.col("local"))
    wanted = met.withColumn("wanted", F.when(behind, F.col("callee")).otherwise(F.col("name")))
    return wanted.join(nodes, (wanted["resolved"] == nodes["t_file"]) & (wanted["wanted"] == nodes["tail_label"])).select(*EDGE)
