"""Facts of source files: functions, classes, imports, exports, calls and flows, from one scope stack.

A file is read once, in an Arrow batch: comments and strings are blanked (templates keep what they
interpolate), brackets are matched by one stack, and scopes are intervals that nest. All steps are
linear in the file: patterns are possessive, counts of a span come from sorted positions, and tokens belong
to the innermost function only. What the facts mean together (which import names which file, who calls
whom, what input reaches) is worked out by joins in ``modules`` and ``callgraph``.

Defined results: a null or empty text has no facts. Unclosed brackets close at the end of the text; a
closing one without an opening one is passed over. Words in comments, strings or prose without brackets
are no functions. Of equal names in a file each stands for itself, by its line.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.batches import small_batches

JS = ("typescript", "javascript")
_STRING = r""""(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?"""
#: What is blanked, by the character it begins with; a slash alone may begin a regular expression.
_BLANKED = {
    "python": re.compile(rf'"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\Z)|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*+(?:\'\'\'|\Z)|{_STRING}|#[^\n]*+', re.S),
    "": re.compile(rf"{_STRING}|`(?:[^`\\]|\\.)*+`|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|/", re.S),
}
_PREFIX = re.compile(r"\b[rbfuRBFU]{1,2}\Z")
_REGEX = re.compile(r"/(?![/*\s])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+", re.S)
_KEPT, _KEPT_PYTHON = re.compile(r"\$\{[^{}]*+\}"), re.compile(r"\{[^{}]*+\}")
_BRACKETS = re.compile(r"[(){}\[\],]")
_OPENING = re.compile(r"[({\[]")
_OPENS = {")": "(", "]": "[", "}": "{"}
_NAME = re.compile(r"[A-Za-z_$][\w$]*+")
# How functions and classes begin; the groups are export, async, name (or name, async).
_FUNCTIONS = {
    "python": re.compile(r"(?m)^[ \t]*+(?P<async>async[ \t]++)?def[ \t]++(?P<name>\w++)[ \t]*+\("),
    "golang": re.compile(r"(?m)^func(?:[ \t]*+\([^()\n]*+\))?[ \t]*+(?P<name>\w++)[ \t]*+\("),
    "": re.compile(
        r"(?m)(?:^|(?<=[\s;{}]))(?P<export>export[ \t]++)?(?:default[ \t]++)?(?:(?P<async>async[ \t]++)?function[ \t]*+\*?[ \t]*+(?P<name>[\w$]++)[ \t]*+(?:<[^<>()\n]*+>)?\("
        r"|(?:const|let|var)[ \t]++(?P<bound>[\w$]++)[ \t]*+(?::[^=\n]*+)?=[ \t]*+(?P<async2>async\b[ \t]*+)?(?:function[ \t]*+\*?[ \t]*+\(|(?P<arrow>(?=\()\(|[\w$]++[ \t]*+=>)))"
        r"|^[ \t]++(?:(?:public|private|protected|static|override|final|get|set)[ \t]++)*+(?P<async3>async[ \t]++)?(?:[\w$<>\[\],.]++[ \t]++)?(?P<method>[\w$]++)[ \t]*+\("
    ),
}
_NO_METHOD = frozenset("if for while switch catch else do return function new throw await typeof with super".split())
_CLASSES = {"python": re.compile(r"(?m)^(?P<indent>[ \t]*+)class[ \t]++(?P<name>\w++)[ \t]*+(?:\((?P<base>[^()\n]*+)\))?[ \t]*+:"), "": re.compile(r"(?m)^[ \t]*+(?P<export>export[ \t]++)?(?:default[ \t]++)?(?:(?:public|abstract|final)[ \t]++)*+class[ \t]++(?P<name>[\w$]++)(?:[ \t]*+<[^<>\n]*+>)?(?:[ \t]++extends[ \t]++(?P<base>[\w$.]++))?")}
_BRANCH = re.compile(r"\b(?:if|for|while|do|catch|case|elif|except)\b|&&|\|\||(?<!\?)\?(?![?:.])")
_OPERATOR = re.compile(r"[+\-*/%&|^~<>=!]{1,3}")
_CALL = re.compile(r"\b([A-Za-z_$][\w$]*+(?:\.[\w$]++)*+)[ \t]*+\(")
# Callees that are no functions of a program.
BUILTINS = frozenset("console Math JSON Object Array String Number Boolean Promise parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent setTimeout setInterval clearTimeout clearInterval require import if while for switch return throw new typeof instanceof catch function def func elif except".split())
# What makes a function an entry point: the line it begins on, its name, or a later export.
_ENTRY_LINE = re.compile(r"export\s+(?:default\s+)?(?:async\s+)?function|export\s+(?:const|let)\s+\w+\s*=\s*(?:async\s+)?\(?|(?:app|router)\.(?:get|post|put|delete|patch|use|all)\s*\(|addEventListener\s*\(|exports\.\w+\s*=|module\.exports\s*=|handler\s*=\s*(?:async\s+)?function")
_ENTRY_NAME = re.compile(r"(?:main|handler|index|server|app|init|start|bootstrap|run)\Z", re.I)
_EXPORTED_AS = re.compile(r"exports\.\w++\s*+=\s*+(\w++)")
# Where input comes from, by kind, and what it must not reach.
SOURCES = [
    ("user-input", r"\b(?:req|request)\.(?:body|params|query|headers|cookies|files|args|form)\b|JSON\.parse\s*\(|decodeURIComponent\s*\(|document\.(?:getElementById|querySelector|cookie|location)|window\.location\.(?:search|hash|href|pathname)|event\.(?:data|target\.value|detail)|\b(?:userInput|userData|inputData)\b|\bsearchParams\.get\b|\bformData\.get\b|\bprocess\.argv\b"),
    ("env", r"process\.env\.\w+"),
    ("network", r"\b(?:fetch|axios|https?|got)\s*\("),
    ("file", r"fs\.(?:readFile|readFileSync|createReadStream)\s*\("),
    ("database", r"(?:db|pool|client|connection)\.(?:query|execute|find|findOne)\s*\("),
]
SINKS = [
    ("sql", r"(?:db|pool|client|conn|connection)\.(?:query|execute|raw)\s*\("),
    ("http-response", r"\bres\.(?:send|json|write|end)\s*\("),
    ("eval", r"\beval\s*\("),
    ("exec", r"\bexec(?:Sync)?\s*\(|\bspawn\s*\("),
    ("dom", r"\.innerHTML\s*[+]?=|document\.write\s*\("),
    ("file-write", r"fs\.(?:writeFile|appendFile|createWriteStream)\s*\("),
    ("network", r"\b(?:fetch|axios\.(?:get|post|put))\s*\("),
    ("redirect", r"res\.redirect\s*\("),
    ("log", r"logger\.(?:info|warn|error|debug|log)\s*\("),
]
_SOURCE = re.compile("|".join(f"(?P<s{k}>{p})" for k, (_, p) in enumerate(SOURCES)))
_SINK = re.compile("|".join(f"(?P<s{k}>{p})" for k, (_, p) in enumerate(SINKS)))
#: Words that every match of the two begins with; searched first, as alternatives behind borders are slow.
_SOURCE_STARTS = re.compile(r"req(?=\.|uest\.)|JSON(?=\.parse)|decodeURIComponent|document(?=\.)|window(?=\.location)|event(?=\.)|user(?=Input|Data)|inputData|searchParams|formData|process(?=\.)|fetch|axios|http|got|fs(?=\.)|db(?=\.)|pool(?=\.)|client(?=\.)|connection(?=\.)")
_SINK_STARTS = re.compile(r"db(?=\.)|pool(?=\.)|client(?=\.)|conn(?=\.|ection\.)|res(?=\.)|eval|exec|spawn|\.innerHTML|document(?=\.write)|fs(?=\.)|fetch|axios(?=\.)|logger(?=\.)")
_ASSIGNED = re.compile(r"\s*+(?:(?:const|let|var)\s++)?(?:\{(?P<many>[^{}=]*+)\}|(?P<one>[A-Za-z_$][\w$]*+)(?:\s*+:[^=\n;]*+)?)\s*+(?::=|[-+*/]?=(?![=>]))\s*+(?P<value>.*+)", re.S)
#: Trust in a path that follows assignments and calls by name.
CONFIDENCE = 0.85


@dataclass
class Scope:
    """A function or class: its header's offset and its body, as offsets of the text."""

    kind: str
    name: str
    start: int
    body: int
    end: int
    exported: bool = False
    is_async: bool = False
    base: str | None = None
    params: list[str] = field(default_factory=list)
    parent: Scope | None = None


def _beginning(pattern: re.Pattern, starts: re.Pattern, code: str, begin: int, end: int):
    """Matches of a pattern between two places, tried where one of the words that they begin with stands."""
    start = starts.search(code, begin, end)
    while start:
        at = start.start()
        m = pattern.match(code, at, end)
        if m:
            yield m
            at = m.end() - 1
        start = starts.search(code, at + 1, end)


def blanked(text: str, lang: str) -> str:
    """The text with comments, strings and regular expressions as blanks; line breaks and interpolated code stay."""

    def blank(part: str) -> str:
        shown = _KEPT if part[0] == "`" else _KEPT_PYTHON if part[0] in "fFrR" and "f" in part[:2].lower() else None
        if shown is None:
            return _spaces(part)
        out, at = [], 0
        for kept in shown.finditer(part):
            out += [_spaces(part[at : kept.start()]), kept[0].replace("${", "  ").replace("{", " ").replace("}", " ")]
            at = kept.end()
        return "".join([*out, _spaces(part[at:])])

    pattern, out, at = _BLANKED.get(lang, _BLANKED[""]), [], 0
    found = pattern.search(text)
    while found:
        start, end = found.span()
        if lang == "python":
            lead = _PREFIX.search(text, max(at, start - 2), start) if text[start] != "#" else None
            start = lead.start() if lead else start
        elif end == start + 1 and text[start] == "/":
            begin = start
            while begin > at and text[begin - 1] in " \t":
                begin -= 1
            whole = _REGEX.match(text, start) if begin and text[begin - 1] in "=(,:!&|?;[{}\n" else None
            if whole is None:
                found = pattern.search(text, end)
                continue
            start, end = begin, whole.end()
        out += [text[at:start], blank(text[start:end])]
        at = end
        found = pattern.search(text, end)
    return "".join([*out, text[at:]])


def _spaces(part: str) -> str:
    return "\n".join(" " * len(x) for x in part.split("\n")) if "\n" in part else " " * len(part)


def matched(code: str, begin: int = 0) -> tuple[dict[int, int], dict[int, list[int]], dict[int, int]]:
    """Closing place of each bracket, commas of each round one, and braces nested in each brace."""
    stack: list[int] = []
    open_of = {"(": 0, "[": 0, "{": 0}
    close, commas, deep = {}, {}, {}

    def pop(at: int):
        top = stack.pop()
        open_of[code[top]] -= 1
        close[top] = at
        if code[top] == "{":
            up = next_brace.pop()
            if up is not None:
                deep[up] = max(deep[up], deep[top] + 1)

    next_brace: list[int | None] = []
    braces: list[int] = []
    # Before the first opening bracket, commas and closing ones tell nothing.
    first = _OPENING.search(code, begin)
    for m in _BRACKETS.finditer(code, first.start()) if first else ():
        c, at = m[0], m.start()
        if c == ",":
            if stack and code[stack[-1]] == "(":
                commas.setdefault(stack[-1], []).append(at)
        elif c in "([{":
            if c == "{":
                deep[at] = 0
                next_brace.append(braces[-1] if braces else None)
                braces.append(at)
            stack.append(at)
            open_of[c] += 1
        elif open_of[_OPENS[c]]:
            while True:
                top = code[stack[-1]]
                if top == "{":
                    braces.pop()
                pop(at)
                if top == _OPENS[c]:
                    break
    while stack:
        if code[stack[-1]] == "{":
            braces.pop()
        pop(len(code))
    return close, commas, deep


def _params(code: str, start: int, end: int, commas: list[int], lang: str) -> list[str]:
    out = []
    for s, e in zip([start, *(c + 1 for c in commas)], [*commas, end], strict=True):
        part = code[s:e].strip().lstrip("*.")
        if part and (m := _NAME.match(part)):
            out.append(_NAME.findall(part)[-1] if lang == "java" else m[0])
    return out


def _line_blocks(code: str) -> dict[int, int]:
    """For each line that is not blank, where the block below it ends: the next line of no deeper indent."""
    stack, out = [], {}
    for m in re.finditer(r"(?m)^([ \t]*+)(?=\S)", code):
        width = len(m[1].expandtabs())
        while stack and stack[-1][1] >= width:
            out[stack.pop()[0]] = m.start()
        stack.append((m.start(), width))
    return out | dict.fromkeys((s for s, _ in stack), len(code))


#: What a line holds that a class or a function begins on; no header leaves its line.
_CLASS_LINE, _FUNCTION_LINE = re.compile("class"), re.compile(r"\(|=>")


def _headers(pattern: re.Pattern, line: re.Pattern, code: str, begin: int):
    """Matches of a header's pattern, which is slow on prose, in the lines that hold what one must hold."""
    mark = line.search(code, begin)
    while mark:
        end = code.find("\n", mark.start())
        end = len(code) if end < 0 else end
        yield from pattern.finditer(code, max(begin, code.rfind("\n", begin, mark.start()) + 1), end)
        mark = line.search(code, end)


def scopes(code: str, text: str, lang: str, close: dict[int, int], commas: dict[int, list[int]], begin: int = 0) -> list[Scope]:
    """Functions and classes in the order of their headers, each with the scope around it."""
    out = []
    braces = sorted(k for k in close if code[k] == "{")
    python = _line_blocks(code) if lang == "python" else {}
    line_start = lambda at: code.rfind("\n", 0, at) + 1

    def body_after(at: int, limit: int) -> int | None:
        """The next opening brace before ``limit``."""
        k = bisect_left(braces, at)
        return braces[k] if k < len(braces) and braces[k] < limit else None

    for m in _headers(_CLASSES.get(lang, _CLASSES[""]), _CLASS_LINE, code, begin):
        if lang == "python":
            end = python[line_start(m.start("name"))]
            out.append(Scope("class", m["name"], m.start("name"), m.end(), end, not m["name"].startswith("_"), base=(m["base"] or "").strip() or None))
        elif (at := body_after(m.end(), len(code))) is not None and ";" not in code[m.end() : at]:
            out.append(Scope("class", m["name"], m.start("name"), at, close[at], bool(m["export"]), base=m["base"]))
    for m in _headers(_FUNCTIONS.get(lang, _FUNCTIONS[""]), _FUNCTION_LINE, code, begin):
        found = m.groupdict()
        name = found.get("name") or found.get("bound") or found.get("method")
        if found.get("method") and name in _NO_METHOD:
            continue
        kind = "method" if found.get("method") else "arrow" if found.get("arrow") else "function"
        at = m.end() - 1
        if code[at] == "(":
            last, params = close[at], _params(code, at + 1, close[at], commas.get(at, []), lang)
            rest = last + 1
        else:
            params, rest = [found["arrow"].rstrip("=> \t").strip()], m.end()
        line_end = code.find("\n", min(rest, len(code)))
        line_end = len(code) if line_end < 0 else line_end
        if lang == "python":
            first = line_start(m.start("name"))
            start, body, end = first, min(rest, len(code)), python[first]
            exported = not name.startswith("_")
        else:
            start = m.start("name") if found.get("name") else m.start("bound") if found.get("bound") else m.start("method")
            if kind == "arrow" and code[at] == "(" and "=>" not in code[rest : line_end]:
                continue
            body = body_after(rest, line_end)
            if body is None and kind != "arrow":
                continue
            if body is not None and kind == "method" and code[rest:body].strip(" \t\n") and not re.match(r"\s*+(?::|throws\b|const\b)", code[rest:body]):
                continue
            end = close[body] if body is not None else line_end
            body = rest if body is None else body
            exported = bool(found.get("export")) or lang == "golang" and name[:1].isupper()
        out.append(Scope(kind, name, start, body, min(end, len(code)), exported, bool(found.get("async") or found.get("async2") or found.get("async3")), params=params))
    out.sort(key=lambda s: (s.start, -s.end))
    around: list[Scope] = []
    for s in out:
        while around and around[-1].end <= s.start:
            around.pop()
        s.parent = around[-1] if around else None
        if s.kind == "function" and s.parent is not None and s.parent.kind == "class" and lang == "python":
            s.kind = "method"
        around.append(s)
    return out


_IMPORTS = {
    "python": re.compile(r"(?m)^from[ \t]++(?P<of>[^\s#]++)[ \t]++import[ \t]++(?P<names>\([^)]*+\)|[^\n#]++)|^import[ \t]++(?P<module>[\w.]++)(?:[ \t]++as[ \t]++(?P<alias>\w++))?"),
    "golang": re.compile(r"(?m)^(?:import[ \t]++|[ \t]++)(?:(?P<alias>[\w.]++)[ \t]++)?\"(?P<module>[\w./-]++)\"[ \t]*+$"),
    "": re.compile(r"""(?m)^[ \t]*+import[ \t]++(?:type[ \t]++)?(?:\*[ \t]++as[ \t]++(?P<all>[\w$]++)|(?P<default>[\w$]++)(?:[ \t]*+,[ \t]*+\{(?P<more>[^{}]*+)\})?|\{(?P<names>[^{}]*+)\})\s*+from[ \t]*+['"](?P<of>[^'"\n]++)['"]|^[ \t]*+export[ \t]++\{(?P<again>[^{}]*+)\}[ \t]*+from[ \t]*+['"](?P<of2>[^'"\n]++)['"]|\bimport[ \t]*+\([ \t]*+['"`](?P<dynamic>[^'"`\n]++)['"`][ \t]*+\)|(?:\b(?:const|let|var)[ \t]++(?:(?P<bound>[\w$]++)|\{(?P<parts>[^{}]*+)\})[ \t]*+=[ \t]*+)?\brequire[ \t]*+\([ \t]*+['"`](?P<required>[^'"`\n]++)['"`][ \t]*+\)"""),
}
_EXPORTS = {
    "python": re.compile(r"(?m)^__all__[ \t]*+=[ \t]*+\[(?P<names>[^\]]*+)\]"),
    "": re.compile(r"(?m)^[ \t]*+export[ \t]++(?:(?P<kind>(?:async[ \t]++)?function|(?:abstract[ \t]++)?class|const|let|type|interface|enum)[ \t]*+\*?[ \t]*+(?P<name>[\w$]++)|(?P<default>default\b)|\{(?P<names>[^{}]*+)\}(?P<again>[ \t]*+from[ \t]*+['\"])?)"),
}
_KIND = {"interface": "type", "enum": "type"}


def _named(part: str | None, sep: str = " as ") -> list[tuple[str, str]]:
    """(name, name here) of a list in braces."""
    out = []
    for x in (part or "").replace("(", " ").replace(")", " ").split(","):
        words = x.replace(":", sep).split()
        if words and words[0] == "type" and len(words) > 1 and words[1] != "as":
            words = words[1:]
        if words and _NAME.fullmatch(words[0]) or words[:1] == ["*"]:
            out.append((words[0], words[-1]))
    return out


def imports(text: str, code: str, lang: str, lines: list[int], begin: int = 0) -> list[tuple]:
    """(specifier, name, name here, kind, line): one row for each imported name, or one without name."""
    out = []
    for m in _IMPORTS.get(lang, _IMPORTS[""]).finditer(text, begin):
        if not code[m.start() : m.end()].strip():
            continue
        line, g = bisect_right(lines, m.end() - 1), m.groupdict()
        if lang == "golang":
            out.append((g["module"], g["module"].rpartition("/")[2], g["alias"] or g["module"].rpartition("/")[2], "module", line))
        elif lang == "python":
            rows = _named(g["names"]) if g["of"] else [(g["module"], g["alias"] or g["module"])]
            out += [(g["of"] or g["module"], n, here, "name" if g["of"] else "module", line) for n, here in rows]
        elif g["of"]:
            rows = [("*", g["all"], "module")] if g["all"] else []
            rows += [("default", g["default"], "default")] if g["default"] else []
            rows += [(n, here, "name") for n, here in _named(g["names"] or g["more"])]
            out += [(g["of"], *r, line) for r in rows] or [(g["of"], None, None, "none", line)]
        elif g["of2"]:
            out += [(g["of2"], n, here, "re-export", line) for n, here in _named(g["again"])]
        elif g["dynamic"]:
            out.append((g["dynamic"], None, None, "dynamic", line))
        else:
            rows = [(n, here, "name") for n, here in _named(g["parts"])] or ([("*", g["bound"], "module")] if g["bound"] else [(None, None, "none")])
            out += [(g["required"], *r, line) for r in rows]
    return out


def exports(text: str, code: str, lang: str, lines: list[int], found: list[Scope], begin: int = 0) -> list[tuple]:
    """(name, local name, kind, line) of each exported symbol."""
    out = []
    if lang == "golang":
        return [(s.name, s.name, "function", bisect_right(lines, s.start)) for s in found if s.kind == "function" and s.exported]
    for m in _EXPORTS.get(lang, _EXPORTS[""]).finditer(text, begin):
        if not code[m.start() : m.end()].strip():
            continue
        line, g = bisect_right(lines, m.end() - 1), m.groupdict()
        if lang == "python":
            out += [(n, n, "const", line) for n in re.findall(r"['\"](\w+)['\"]", g["names"])]
        elif g["kind"]:
            kind = g["kind"].split()[-1]
            out.append((g["name"], g["name"], _KIND.get(kind, kind), line))
        elif g["default"]:
            own = re.compile(r"[ \t]*+(?:async[ \t]++)?(?:function\b|class\b)?[ \t]*+\*?[ \t]*+([A-Za-z_$][\w$]*+)?").match(code, m.end())
            out.append(("default", own[1] or "default", "default", line))
        else:
            out += [(here, n, "re-export" if g["again"] else "const", line) for n, here in _named(g["names"])]
    return out


def _own(found: list[Scope], places: list[int]) -> list[list[int]]:
    """For each scope the indices of those sorted places in its body that no function within it holds."""
    out: list[list[int]] = [[] for _ in found]
    number = {id(s): k for k, s in enumerate(found)}
    stack: list[Scope] = []
    at = 0
    for s in [*found, None]:
        limit = s.start if s is not None else None
        while at < len(places) and (limit is None or places[at] < limit):
            while stack and stack[-1].end <= places[at]:
                stack.pop()
            if not stack:
                if limit is None:
                    return out
                at = bisect_left(places, limit, at)
                break
            if places[at] >= stack[-1].body:
                out[number[id(stack[-1])]].append(at)
            at += 1
        if s is not None:
            while stack and stack[-1].end <= s.start:
                stack.pop()
            stack.append(s)
    return out


#: A statement: text between line breaks, semicolons and braces; a list of names in braces may begin it.
_STATEMENT = re.compile(r"(?:[ \t]*+(?:const|let|var)\s++\{[^{}]*+\}\s*+=)?[^\n;{}]++")
#: Calls and sinks around a name that count it as theirs, from the innermost.
AROUND = 32


def flows(code: str, f: Scope, parts: list[re.Match], calls: list[tuple], sinks: list[tuple], lines: list[int]) -> list[tuple]:
    """(origin, origin line, parameter, target, target line, argument) of a function's own statements.

    ``origin`` is a kind of source or ``param``; ``target`` a kind of sink or ``call:name``. A name carries all
    origins of its assignments up to there, in the order of the text; one without any clears it. A name is an
    argument of the AROUND calls and sinks nearest around it.
    """
    line = lambda at: bisect_right(lines, at)
    holds: dict[str, dict] = {p: {("param", line(f.start), k): None} for k, p in enumerate(f.params)}
    spans = [(s, e, f"call:{name}", at, k) for at, name, arguments in calls for k, (s, e) in enumerate(arguments)]
    spans = sorted([*spans, *((s, e, kind, at, None) for at, kind, s, e in sinks)], key=lambda x: (x[0], -x[1]))
    out: dict[tuple, None] = {}
    around: list[tuple] = []
    k = 0
    for part in parts:
        named = [(m.start(), holds[m[0]]) for m in _NAME.finditer(code, part.start(), part.end()) if m[0] in holds]
        named += [(m.start(), {(SOURCES[int(m.lastgroup[1:])][0], line(m.start()), None): None}) for m in _beginning(_SOURCE, _SOURCE_STARTS, code, part.start(), part.end())]
        named.sort(key=lambda x: x[0])
        for at, origins in named:
            while k < len(spans) and spans[k][0] <= at:
                while around and around[-1][1] <= spans[k][0]:
                    around.pop()
                around.append(spans[k])
                k += 1
            while around and around[-1][1] <= at:
                around.pop()
            for s, e, target, place, arg in around[-AROUND:]:
                if s <= at < e:
                    for o in origins:
                        out[(*o, target, line(place), arg)] = None
        if m := _ASSIGNED.match(part[0]):
            got: dict = {}
            for at, origins in named:
                if at >= part.start() + m.start("value"):
                    got |= origins
            for n in [m["one"]] if m["one"] else [here for _, here in _named(m["many"])]:
                if got:
                    holds[n] = got
                else:
                    holds.pop(n, None)
    return list(out)


def describe(text: str, lang: str, whole: bool = True, measure: bool = True) -> dict:
    """All facts of one file, or its measures alone; without ``measure``, all but the measures of it and of its functions."""
    code = blanked(text, lang)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    # What stands before the first line of code, such as a long comment, is not searched again.
    begin = code.rfind("\n", 0, len(code) - len(code.lstrip())) + 1
    close, commas, deep = matched(code, begin)
    found = scopes(code, text, lang, close, commas, begin)
    line = lambda at: bisect_right(lines, at)
    last = lambda s: line(max(s.start, s.end - 1 if lang == "python" and s.end < len(code) else min(s.end, len(code) - 1)))
    functions = [s for s in found if s.kind != "class"]
    exported_later = set(_EXPORTED_AS.findall(code, begin)) if whole else set()
    # Branches, tokens, calls and sinks count in functions only; none begins on a line before that of the first.
    head = max(begin, code.rfind("\n", 0, min(s.start for s in functions)) + 1) if functions else begin
    branches = [m.start() for m in _BRANCH.finditer(code, head)] if functions and measure else []
    spans = [(m.start(), m[0]) for m in _OPERATOR.finditer(code, head)] + [(m.start(), m[0]) for m in _NAME.finditer(code, head)] if functions and measure else []
    spans.sort()
    tokens = _own(found, [at for at, _ in spans])
    called: list[list[tuple]] = [[] for _ in found]
    heads = {s.start for s in found}
    sites = [m for m in _CALL.finditer(code, head) if m.start() not in heads and (n := m[1].rpartition(".")[2]) not in BUILTINS and len(n) > 1 and m[1] not in BUILTINS] if functions and whole else []
    for k, own in enumerate(_own(found, [m.start() for m in sites])):
        for i in own:
            at = sites[i].end() - 1
            cuts = [*commas.get(at, []), close[at]]
            arguments = [(s, e) for s, e in zip([at + 1, *(c + 1 for c in cuts[:-1])], cuts, strict=True) if code[s:e].strip()]
            called[k].append((sites[i].start(), sites[i][1], arguments))
    parts = list(_STATEMENT.finditer(code, begin)) if functions and whole else []
    own_parts = [[parts[i] for i in own] for own in _own(found, [m.start() for m in parts])]
    sunk: list[list[tuple]] = [[] for _ in found]
    drains = list(_beginning(_SINK, _SINK_STARTS, code, head, len(code))) if functions and whole else []
    for k, own in enumerate(_own(found, [m.start() for m in drains])):
        for m in (drains[i] for i in own):
            end = close[m.end() - 1] if m[0][-1] == "(" else code.find("\n", m.end())
            sunk[k].append((m.start(), SINKS[int(m.lastgroup[1:])][0], m.end(), end if end >= 0 else len(code)))
    entry_lines = {line(m.start()) for m in _ENTRY_LINE.finditer(text, head)} if functions and whole else set()
    inside: dict[int, list[Scope]] = {}
    for s in found:
        if s.parent is not None:
            inside.setdefault(id(s.parent), []).append(s)
    rows, calls, flowing = [], [], []
    for k, s in enumerate(found):
        if s.kind == "class":
            continue
        entry = s.exported and lang in (*JS, "golang", "") or line(s.start) in entry_lines or bool(_ENTRY_NAME.match(s.name)) or s.name in exported_later
        rows.append({
            "name": s.name, "kind": s.kind, "line": line(s.start), "end_line": last(s), "params": s.params, "is_async": s.is_async, "is_exported": s.exported, "is_entry": entry,
            "within": s.parent.name if s.parent else None,
        })
        if measure:
            words = [spans[i][1] for i in tokens[k]]
            operators, kinds = sum(not (w[0].isalpha() or w[0] in "_$") for w in words), len(set(words))
            rows[-1] |= {
                "complexity": 1 + bisect_left(branches, s.end) - bisect_left(branches, s.body), "nesting": deep.get(s.body, 0) if lang != "python" else _indent_depth(code, s),
                "operators": operators, "operands": len(words) - operators, "volume": round(len(words) * math.log2(kinds)) if kinds > 1 else 0,
            }
        if not whole:
            continue
        plain = lambda a: t if _NAME.fullmatch(t := code[a[0] : a[1]].strip()) else ""
        calls += [{"caller": s.name, "caller_line": line(s.start), "callee": name, "line": line(at), "args": [plain(a) for a in arguments]} for at, name, arguments in called[k]]
        flowing += [{"function": s.name, "function_line": line(s.start), "origin": o, "origin_line": n, "param": p, "target": t, "target_line": to, "arg": a} for o, n, p, t, to, a in flows(code, s, own_parts[k], called[k], sunk[k], lines)]
    classes = [{"name": s.name, "line": line(s.start), "end_line": last(s), "is_exported": s.exported, "base": s.base, "methods": [x.name for x in inside.get(id(s), []) if x.kind in ("method", "function", "arrow")]} for s in found if s.kind == "class"]
    if not whole:
        return {"measures": _measures(text, code, lines, deep, rows, classes)}
    taken = [{"specifier": of, "name": n, "alias": here, "kind": kind, "line": at} for of, n, here, kind, at in imports(text, code, lang, lines, begin)]
    given = [{"name": n, "local": here, "kind": kind, "line": at} for n, here, kind, at in exports(text, code, lang, lines, found, begin)]
    return {"functions": rows, "classes": classes, "imports": taken, "exports": given, "calls": calls, "flows": flowing, "measures": _measures(text, code, lines, deep, rows, classes) if measure else None}


def bodies(text: str, lang: str) -> list[str]:
    """The source of each function or method, of any length and language, header included; a nested one stands in its outer's too."""
    code = blanked(text, lang)
    close, commas, _ = matched(code)
    out = []
    for s in scopes(code, text, lang, close, commas):
        if s.kind != "class":
            start = text.rfind("\n", 0, s.start) + 1 if text[text.rfind("\n", 0, s.start) + 1 : s.start].strip() in _LEADS else s.start
            out.append(text[start : s.end + (lang != "python")])
    return out


#: Words before a function's name on its line that belong to it.
_LEADS = frozenset(["", "function", "async function", "export function", "export async function", "export default function", "const", "let", "var", "export const", "async", "func", "def", "async def"])


def _indent_depth(code: str, s: Scope) -> int:
    """Steps of indent within a block, less one for its own."""
    widths, most = [], 0
    for m in re.finditer(r"(?m)^([ \t]*+)(?=\S)", code[s.body : s.end]):
        width = len(m[1].expandtabs())
        while widths and widths[-1] >= width:
            widths.pop()
        widths.append(width)
        most = max(most, len(widths))
    return max(0, most - 1)


_COMMENT = re.compile(r"\s*+(?://|#|\*|/\*|<!--)")


def _measures(text: str, code: str, lines: list[int], deep: dict[int, int], functions: list[dict], classes: list[dict]) -> dict:
    """Measures of the whole file."""
    filled = [x for x in text.split("\n") if x.strip(" \t\r\f")]
    sizes = [f["end_line"] - f["line"] + 1 for f in functions]
    volume = [f["volume"] for f in functions]
    callbacks = depth = 0
    if "=>" in code:
        stack = []
        for m in re.finditer(r"=>\s*+\{|[{}]", code):
            if m[0] != "}":
                stack.append(len(m[0]) > 1)
                depth += stack[-1]
                callbacks = max(callbacks, depth)
            elif stack:
                depth -= stack.pop()
    return {
        "complexity": sum(f["complexity"] for f in functions) or 1, "nesting": max((d + 1 for d in deep.values()), default=0) or max((f["nesting"] for f in functions), default=0),
        "functions": len(functions), "classes": len(classes), "mean_lines": math.floor(sum(sizes) / len(sizes) + 0.5) if sizes else 0, "most_lines": max(sizes, default=0),
        "callbacks": callbacks, "comments": sum(bool(_COMMENT.match(x)) for x in filled) / len(filled) if filled else 0.0, "volume": sum(volume), "loc": len(filled),
    }


_FUNCTION = "name:string,kind:string,line:int,end_line:int,params:array<string>,is_async:boolean,is_exported:boolean,is_entry:boolean,within:string,complexity:int,nesting:int,operators:int,operands:int,volume:bigint"
FACTS = {
    "functions": f"array<struct<{_FUNCTION}>>",
    "classes": "array<struct<name:string,line:int,end_line:int,is_exported:boolean,base:string,methods:array<string>>>",
    "imports": "array<struct<specifier:string,name:string,alias:string,kind:string,line:int>>",
    "exports": "array<struct<name:string,local:string,kind:string,line:int>>",
    "calls": "array<struct<caller:string,caller_line:int,callee:string,line:int,args:array<string>>>",
    "flows": "array<struct<function:string,function_line:int,origin:string,origin_line:int,param:int,target:string,target_line:int,arg:int>>",
    "measures": "struct<complexity:bigint,nesting:int,functions:int,classes:int,mean_lines:int,most_lines:int,callbacks:int,comments:double,volume:bigint,loc:int>",
}
_NOTHING = {k: None if k == "measures" else [] for k in FACTS}


def facts(files: DataFrame, path: str = "path", content: str = "content", lang: str = "lang", measure: bool = True) -> DataFrame:
    """(path, lang, functions, classes, imports, exports, calls, flows, measures): a row for each file.

    Without ``measure``, the measures of files and functions are null.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    schema = "path string, lang string, " + ", ".join(f"{k} {v}" for k, v in FACTS.items())
    types = {k: to_arrow_type(_parse_datatype_string(v)) for k, v in FACTS.items()}

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                paths, texts, langs = (c.slice(at, 64).to_pylist() for c in batch.columns)
                rows = [describe(t, x or "", measure=measure) if t else _NOTHING for t, x in zip(texts, langs, strict=True)]
                columns = [pa.array([r[k] for r in rows], types[k]) for k in FACTS]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(langs, pa.string()), *columns], ["path", "lang", *FACTS])

    small_batches(files.sparkSession)
    return files.select(files[path].cast("string"), content, files[lang].cast("string")).mapInArrow(read, schema)


def measured(files: DataFrame, text: str = "content", lang: str = "lang") -> DataFrame:
    """``files`` with the struct ``measures`` of each: that of ``facts``, without what only the other facts need."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    own = files.columns
    kind = to_arrow_type(_parse_datatype_string(FACTS["measures"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + f", measures {FACTS['measures']}"

    def read(batches):
        for batch in batches:
            pairs = zip(batch.column(own.index(text)).to_pylist(), batch.column(own.index(lang)).to_pylist(), strict=True)
            column = pa.array([describe(t, x or "", whole=False)["measures"] if t else None for t, x in pairs], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*own, "measures"])

    small_batches(files.sparkSession)
    return files.mapInArrow(read, schema)
