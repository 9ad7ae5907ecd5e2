"""Structure of source files where regular expressions cannot tell: braces, blocks, calls.

A stateful scan of each file, in Arrow batches; the only Python in the scanning tier.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.batches import small_batches

SCHEMA = "path string, functions array<string>, imports array<string>, branches int, depth int, calls array<string>"
_FUNCTION = re.compile(r"\b(?:function\s+(\w+)|def\s+(\w+)|func\s+(\w+)|(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>)")
_IMPORT = re.compile(r"""(?:from\s+['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)|^\s*import\s+(\w[\w.]*)|^\s*from\s+(\w[\w.]*)\s+import)""", re.M)
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|except|elif)\b|&&|\|\||\?(?=[^.?])")
_CALL = re.compile(r"\b(\w+)\s*\(")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "def", "func"}


def describe(content: str) -> tuple[list[str], list[str], int, int, list[str]]:
    """Functions, imports, branches, depth of braces outside strings, and calls of a file."""
    names = [next(filter(None, m.groups())) for m in _FUNCTION.finditer(content)]
    imports = [next(filter(None, m.groups())) for m in _IMPORT.finditer(content)]
    depth = deepest = 0
    quote = ""
    escaped = False
    for c in content:
        if quote:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == quote or c == "\n" and quote != "`":
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c == "{":
            depth += 1
            deepest = max(deepest, depth)
        elif c == "}":
            depth = max(0, depth - 1)
    calls = sorted({m[1] for m in _CALL.finditer(content)} - _KEYWORDS - set(names))
    return names, imports, len(_BRANCH.findall(content)), deepest, calls


def parse(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, functions, imports, branches, depth, calls) of each file; null content is empty."""

    def read(batches):
        for batch in batches:
            rows = [describe(x or "") for x in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            texts = pa.list_(pa.string())
            types = (texts, texts, pa.int32(), pa.int32(), texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["path", "functions", "imports", "branches", "depth", "calls"])

    small_batches(files.sparkSession)
    return files.select(files[path].cast("string"), content).mapInArrow(read, SCHEMA)


_ASSIGN = re.compile(r"^\s*(?:const|let|var)?\s*(\w+)\s*=(?!=)\s*(.+)$")
_SOURCE = re.compile(r"\b(?:req|request)\.(?:query|body|params|headers|args|form)\b|\buser(?:Input|Data)\b|\binput\s*\(")
_SINK = re.compile(r"\b(eval|exec|query|execute|fetch|system|innerHTML|write)\b\s*(?:\(|=)\s*(.*)$")
_NAME = re.compile(r"\b[A-Za-z_]\w*\b")
#: Trust in a path that follows assignments only.
CONFIDENCE = 0.85


def taint_of(content: str) -> list[tuple[str, int, int, str]]:
    """(sink, source line, sink line, path of names), each definition versioned by its line.

    A name is tainted from its last assignment on, if that used a source or a tainted name.
    """
    tainted: dict[str, tuple[int, str]] = {}
    out = []
    for n, line in enumerate(content.split("\n"), 1):
        if sink := _SINK.search(line):
            if _SOURCE.search(sink[2]):
                out.append((sink[1], n, n, "input"))
            out += [(sink[1], tainted[x][0], n, tainted[x][1]) for x in dict.fromkeys(_NAME.findall(sink[2])) if x in tainted]
        if m := _ASSIGN.match(line):
            name, value = m[1], m[2]
            carried = next((tainted[x] for x in _NAME.findall(value) if x in tainted), None)
            if _SOURCE.search(value):
                tainted[name] = (n, f"{name}@{n}")
            elif carried:
                tainted[name] = (carried[0], f"{carried[1]}>{name}@{n}")
            else:
                tainted.pop(name, None)
    return out


def taint_paths(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, sink, source_line, sink_line, flow, confidence) of each file."""

    def read(batches):
        for batch in batches:
            rows = [(p, *t, CONFIDENCE) for p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for t in taint_of(c or "")]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "sink", "source_line", "sink_line", "flow", "confidence"])

    small_batches(files.sparkSession)
    return files.select(files[path].cast("string"), content).mapInArrow(read, "path string, sink string, source_line int, sink_line int, flow string, confidence double")


_EXPORT = re.compile(r"^\s*(?:export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|interface|type|enum)\s+(\w+)|module\.exports\.(\w+)\s*=|exports\.(\w+)\s*=)", re.M)
_CLASS = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+|public\s+|final\s+)*class\s+(\w+)", re.M)
_OPERATOR, _COMMENT = re.compile(r"[+\-*/%&|^~<>=!]{1,3}"), re.compile(r"\s*(?://|#|\*|/\*|<!--)")


def metrics_of(content: str) -> tuple:
    """Functions, classes, exports, complexity, nesting, share of comments and Halstead volume of a file."""
    names, _, branches, deepest, _ = describe(content)
    lines = [x for x in content.split("\n") if x.strip()]
    operators, operands = _OPERATOR.findall(content), re.findall(r"\b[a-zA-Z_]\w*\b", content)
    kinds = len(set(operators)) + len(set(operands))
    volume = round((len(operators) + len(operands)) * math.log2(kinds)) if kinds > 1 else 0
    comments = sum(bool(_COMMENT.match(x)) for x in lines) / len(lines) if lines else 0.0
    return len(names), len(_CLASS.findall(content)), len(_EXPORT.findall(content)), len(names) + branches if names else 1, deepest, comments, volume, len(lines)


def _each(files: DataFrame, path: str, content: str, schema: str, of) -> DataFrame:
    """Rows (path, and what ``of`` gives for the content) of each file, in Arrow batches; null content is empty."""

    def read(batches):
        for batch in batches:
            rows = [(p, *x) for p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for x in of(c or "")]
            fields = [f.split() for f in schema.split(", ")]
            kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    small_batches(files.sparkSession)
    return files.select(files[path].cast("string"), content).mapInArrow(read, schema)


def measured(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return _each(files, path, content, "path string, functions int, classes int, exports int, complexity int, nesting int, comments double, halstead bigint, loc int", lambda c: [metrics_of(c)])


def clones(files: DataFrame) -> DataFrame:
    """(path, number, group, links): functions of each file (path, content, lang) that are clones of others of it."""
    from .authorship import clone_groups

    def read(batches):
        for batch in batches:
            rows = [(p, *x) for p, c, lang in zip(*(x.to_pylist() for x in batch.columns), strict=True) for x in clone_groups(c or "", lang or "")]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "number", "group", "links"])

    small_batches(files.sparkSession)
    return files.select("path", "content", "lang").mapInArrow(read, "path string, number int, group int, links int")
