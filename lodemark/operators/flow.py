"""Control flow of a function's body: a graph of its statements, from a tree of blocks.

Statements are read by one descent over the blanked code: conditions, loops of three kinds, switches that fall through,
try with catch and finally, labels, branches without braces. A function inside is one statement, as is code nested
deeper than DEEPEST. Python's blocks are read by their indent. What a node may run next is an edge; every statement
of a try may go on to its catch.
"""

from __future__ import annotations

import re
from collections import defaultdict

from .source import _FUNCTIONS, blanked, matched

DEEPEST = 150
_BLANK = re.compile(r"[\s;]*+")
_WORD = re.compile(r"(?:(?P<label>[A-Za-z_$][\w$]*+)\s*+:(?![:=])\s*+)?(?P<word>if|else|for|while|do|switch|try|catch|finally|return|throw|break|continue|case|default)\b")
_PYTHON = re.compile(r"(?P<word>if|elif|else|for|while|try|except|finally|with|match|case|return|raise|break|continue|def|class|async)\b")
_INNER = re.compile(r"(?:async\s++)?function\b|class\b")


class Graph:
    """Nodes are (line, text); ``after`` has the edges. Node 0 is the entry."""

    def __init__(self):
        self.nodes: list[tuple[int, str]] = [(0, "")]
        self.after: dict[int, set[int]] = defaultdict(set)
        self.loops: list[dict] = []
        self.tries: list[list[int]] = []

    def node(self, line: int, text: str, before: set[int]) -> int:
        n = len(self.nodes)
        self.nodes.append((line, text))
        for b in before:
            self.after[b].add(n)
        for t in self.tries:
            t.append(n)
        return n

    def leave(self, word: str, label: str | None, n: int) -> None:
        """A break or continue of the nearest loop, or of the one that the label names."""
        for loop in reversed(self.loops):
            if label and loop["label"] != label or word == "continue" and not loop["loops"]:
                continue
            loop[word].add(n)
            return


class _Braces(Graph):
    def __init__(self, code: str):
        super().__init__()
        self.code = code
        self.close, _, _ = matched(code)
        self.breaks = [m.end() for m in re.finditer("\n", code)]

    def line(self, at: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.breaks, at)

    def simple_end(self, at: int, end: int) -> int:
        """Where a plain statement ends: at a semicolon, a line's end or the block's, outside of brackets."""
        start = at
        while at < end:
            c = self.code[at]
            if c in "([{":
                if at not in self.close:
                    return end
                at = min(self.close[at], end) + 1
                continue
            if c == ";" or c == "}" or c == "\n" and self.code[start:at].strip() and not self.code[start:at].rstrip().endswith(("=", ",", "+", "&&", "||", "=>", ".", "(", "?", ":")):
                return at
            at += 1
        return end

    def block(self, at: int, end: int, before: set[int], depth: int) -> set[int]:
        while True:
            at = _BLANK.match(self.code, at, end).end()
            if at >= end:
                return before
            if self.code[at] == "}":
                at += 1
                continue
            at, before = self.statement(at, end, before, depth)

    def head(self, at: int, end: int) -> tuple[int, int]:
        """The range of a condition: in round brackets, or up to the brace."""
        at = _BLANK.match(self.code, at, end).end()
        if at < end and self.code[at] == "(":
            stop = min(self.close.get(at, end), end)
            return at + 1, min(stop + 1, end)
        stop = self.code.find("{", at, end)
        return at, stop if stop >= 0 else self.simple_end(at, end)

    def body(self, at: int, end: int, before: set[int], depth: int) -> tuple[int, set[int]]:
        """A block in braces or one statement; where it ends and what leaves it."""
        at = _BLANK.match(self.code, at, end).end()
        if at < end and self.code[at] == "{":
            stop = min(self.close.get(at, end), end)
            return min(stop + 1, end), self.block(at + 1, stop, before, depth + 1)
        return self.statement(at, end, before, depth + 1) if at < end else (at, before)

    def following(self, word: str, at: int, end: int) -> int | None:
        """Where the code after ``word`` begins, if that is what comes next."""
        at = _BLANK.match(self.code, at, end).end()
        m = re.compile(rf"{word}\b").match(self.code, at, end)
        return m.end() if m else None

    def plain(self, at: int, end: int, before: set[int]) -> tuple[int, set[int]]:
        stop = max(self.simple_end(at, end), at + 1)
        return stop, {self.node(self.line(at), self.code[at:stop], before)}

    def statement(self, at: int, end: int, before: set[int], depth: int) -> tuple[int, set[int]]:
        code = self.code
        if code[at] == "{" and depth < DEEPEST:
            stop = min(self.close.get(at, end), end)
            return min(stop + 1, end), self.block(at + 1, stop, before, depth + 1)
        m = _WORD.match(code, at, end)
        if not m or depth >= DEEPEST or _INNER.match(code, at, end):
            return self.plain(at, end, before)
        word, label, line, after = m["word"], m["label"], self.line(at), m.end()
        if word in ("return", "throw"):
            stop = max(self.simple_end(after, end), after)
            self.node(line, code[at:stop], before)
            return stop, set()
        if word in ("break", "continue"):
            stop = max(self.simple_end(after, end), after)
            self.leave(word, code[after:stop].strip() or None, self.node(line, code[at:stop], before))
            return stop, set()
        if word == "if":
            start, stop = self.head(after, end)
            n = self.node(line, code[at:stop], before)
            at, out = self.body(stop, end, {n}, depth)
            other = self.following("else", at, end)
            if other is None:
                return at, out | {n}
            at, more = self.body(other, end, {n}, depth)
            return at, out | more
        if word in ("for", "while", "do", "switch"):
            loop = {"label": label, "loops": word != "switch", "break": set(), "continue": set()}
            if word == "do":
                first = self.node(line, "", before)
                self.loops.append(loop)
                at, out = self.body(after, end, {first}, depth)
                self.loops.pop()
                test = self.following("while", at, end)
                start, stop = self.head(test, end) if test is not None else (at, at)
                n = self.node(self.line(start), code[start:stop].rstrip(") "), out | loop["continue"])
                self.after[n].add(first)
                return stop, {n} | loop["break"]
            start, stop = self.head(after, end)
            n = self.node(line, code[at:stop], before)
            self.loops.append(loop)
            at, out = self.cases(stop, end, n, depth) if word == "switch" else self.body(stop, end, {n}, depth)
            self.loops.pop()
            if word == "switch":
                return at, out | loop["break"]
            for b in out | loop["continue"]:
                self.after[b].add(n)
            return at, {n} | loop["break"]
        if word == "try":
            return self.tried(line, after, end, before, depth)
        return self.plain(at, end, before)

    def cases(self, at: int, end: int, n: int, depth: int) -> tuple[int, set[int]]:
        at = _BLANK.match(self.code, at, end).end()
        if at >= end or self.code[at] != "{":
            return at, {n}
        stop, out, default = min(self.close.get(at, end), end), set(), False
        at += 1
        label = re.compile(r"(?:case\b[^:\n]*+|(default)\b\s*+):")
        while True:
            at = _BLANK.match(self.code, at, stop).end()
            if at >= stop:
                return min(stop + 1, end), out if default else out | {n}
            if m := label.match(self.code, at, stop):
                default = default or bool(m[1])
                out = {self.node(self.line(at), m[0], out | {n})}
                at = m.end()
            else:
                at, out = self.statement(at, stop, out, depth + 1)

    def tried(self, line: int, at: int, end: int, before: set[int], depth: int) -> tuple[int, set[int]]:
        inside: list[int] = []
        first = self.node(line, "", before)
        self.tries.append(inside)
        at, out = self.body(at, end, {first}, depth)
        self.tries.pop()
        failing, caught = {first, *inside}, False
        if (handler := self.following("catch", at, end)) is not None:
            caught = True
            start, stop = self.head(handler, end) if _BLANK.match(self.code, handler, end).end() < end and self.code[_BLANK.match(self.code, handler, end).end()] == "(" else (handler, handler)
            k = self.node(self.line(handler), "", failing)
            at, more = self.body(stop, end, {k}, depth)
            out |= more
        if (last := self.following("finally", at, end)) is not None:
            at, out = self.body(last, end, {self.node(self.line(last), "", out if caught else out | failing)}, depth)
        return at, out


class _Indent(Graph):
    def __init__(self, code: str):
        super().__init__()
        self.rows = [(k, len(x.expandtabs()) - len(x.expandtabs().lstrip()), x.strip()) for k, x in enumerate(code.split("\n")) if x.strip()]

    def under(self, i: int, end: int, before: set[int], depth: int) -> set[int]:
        """The block below a head, or what stands behind its colon."""
        k, width, text = self.rows[i]
        rest = text.rpartition(":")[2].strip()
        if end > i + 1 or not rest:
            return self.block(i + 1, end, before, depth)
        word = rest.split()[0]
        n = self.node(k, rest, before)
        if word in ("break", "continue"):
            self.leave(word, None, n)
        return set() if word in ("break", "continue", "return", "raise") else {n}

    def end_of(self, i: int) -> int:
        j = i + 1
        while j < len(self.rows) and self.rows[j][1] > self.rows[i][1]:
            j += 1
        return j

    def block(self, i: int, end: int, before: set[int], depth: int) -> set[int]:
        while i < end:
            k, _, text = self.rows[i]
            stop = min(self.end_of(i), end)
            m = _PYTHON.match(text)
            word = m["word"] if m else ""
            if word == "async" or word in ("def", "class") or depth >= DEEPEST:
                before, i = {self.node(k, text, before)}, stop
            elif word == "if":
                out, chain = set(), True
                while chain:
                    n = self.node(self.rows[i][0], self.rows[i][2], before)
                    out |= self.under(i, stop, {n}, depth + 1)
                    before, i = {n}, stop
                    if i < end and self.rows[i][2].startswith("elif"):
                        stop = min(self.end_of(i), end)
                        continue
                    chain = False
                if i < end and self.rows[i][2].startswith("else"):
                    stop = min(self.end_of(i), end)
                    before, i = out | self.under(i, stop, before, depth + 1), stop
                else:
                    before = before | out
            elif word in ("for", "while"):
                loop = {"label": None, "loops": True, "break": set(), "continue": set()}
                n = self.node(k, text, before)
                self.loops.append(loop)
                out = self.under(i, stop, {n}, depth + 1)
                self.loops.pop()
                for b in out | loop["continue"]:
                    self.after[b].add(n)
                before, i = {n}, stop
                if i < end and self.rows[i][2].startswith("else"):
                    stop = min(self.end_of(i), end)
                    before, i = self.under(i, stop, before, depth + 1), stop
                before = before | loop["break"]
            elif word == "try":
                first = self.node(k, "", before)
                inside: list[int] = []
                self.tries.append(inside)
                out = self.under(i, stop, {first}, depth + 1)
                self.tries.pop()
                i, handled = stop, set()
                while i < end and _PYTHON.match(self.rows[i][2]) and _PYTHON.match(self.rows[i][2])["word"] in ("except", "else", "finally"):
                    stop, kind = min(self.end_of(i), end), _PYTHON.match(self.rows[i][2])["word"]
                    if kind == "except":
                        handled |= self.under(i, stop, {self.node(self.rows[i][0], "", {first, *inside})}, depth + 1)
                    elif kind == "else":
                        out = self.under(i, stop, out, depth + 1)
                    else:
                        out, handled = self.under(i, stop, {self.node(self.rows[i][0], "", out | handled | (set() if handled else {first, *inside}))}, depth + 1), set()
                    i = stop
                before = out | handled
            elif word in ("break", "continue"):
                self.leave(word, None, self.node(k, text, before))
                before, i = set(), stop
            elif word in ("return", "raise"):
                self.node(k, text, before)
                before, i = set(), stop
            elif word == "match":
                n, out, j, default = self.node(k, text, before), set(), i + 1, False
                while j < stop:
                    last = min(self.end_of(j), stop)
                    out |= self.under(j, last, {self.node(self.rows[j][0], self.rows[j][2], {n})}, depth + 1)
                    default, j = default or self.rows[j][2].startswith("case _:"), last
                before, i = out if default else out | {n}, stop
            else:
                n = self.node(k, text, before)
                before, i = (self.under(i, stop, {n}, depth + 1) if stop > i + 1 else {n}), stop
        return before


def graph(body: str, lang: str) -> Graph:
    """The graph of a function's source, header first; lines count from 0, the header's."""
    code = blanked(body, lang)
    if lang == "python":
        g = _Indent(code)
        if g.rows:
            g.nodes[0] = (g.rows[0][0], "")
            if len(g.rows) > 1:
                g.block(1, len(g.rows), {0}, 0)
            elif ":" in g.rows[0][2]:
                g.node(0, g.rows[0][2].partition(":")[2], {0})
        return g
    g = _Braces(code)
    m = _FUNCTIONS.get(lang, _FUNCTIONS[""]).search(code)
    at = m.end() - 1 if m and code[m.end() - 1 : m.end()] == "(" else 0
    start = code.find("{", g.close.get(at, at))
    if start < 0:
        start = code.find("=>") + 1
        g.block(start + 1, len(code), {0}, 0)
    else:
        g.block(start + 1, min(g.close.get(start, len(code)), len(code)), {0}, 0)
    return g
