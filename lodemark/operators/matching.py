"""Patterns over texts of any length: forms that need no stack, and literals that a match must hold.

Java's expressions keep a frame for each turn of a group's loop, and a pattern that scans on from its
beginning is quadratic in a text that repeats that beginning. So loops of groups get possessive or fixed forms that
match the same, and a text is searched only if it holds the literals that every match has: a text of beginnings alone
is never searched.

Tables of patterns over whole texts run in Arrow batches instead (``tallied``): Arrow's expressions are automata, linear in
a text, and read it some ten times as fast as columns do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches

#: Loops of groups in the tables of patterns, and forms that find the same without a frame for each turn.
LOOPS = [
    (r"(?:\s*,\s*\w+\s*:\s*\w+)+", r"(?:\s*+,\s*+\w++\s*+:\s*+\w++)++"),
    (r"(?:\w+,\s*){2,}\.\.\.", r"(?:\w++,\s*+){2,}+\.\.\."),
    (r"(?:\w+,\s*){2,}\w+", r"(?:\w++,\s*+){2}\w+"),
    (r"(?:\w+\s*,\s*){4,}", r"(?:\w++\s*+,\s*+){4,}+"),
    (r"(?:\s*,\s*\w+)+\s*\}", r"(?:\s*+,\s*+\w++)++\s*\}"),
    (r"(?:\s*,\s*\w+)*", r"(?:\s*+,\s*+\w++(?=\s*,))*+(?:\s*,\s*\w+)?"),
    (r"(?:(?:static|virtual|override|async)\s+)*", ""),
    (r"(?:\s{4,}\w[^:\n]+:[^\n]+\n){2,}", r"(?:\s{4,}\w[^:\n]+:[^\n]+\n){2}"),
    (r"""(?:[^"'\n]*\{[^}]+\}){2,}[^"'\n]*["']""", r"""(?:[^"'\n]*\{[^}]+\}){2}(?:(?:[^"'\n]*\{[^}]+\})*+[^"'\n]*["']|[^"'\n]*["'])"""),
    (r"(?:(?!\})[\s\S])", r"[^}]"),
    (r"\s*(?:!|\s*)\w+", r"\s*!?\w+"),
    (r"\s*(?:\{[^}]*\})?\s*", r"\s*+(?:\{[^}]*+\}\s*+)?"),
    (r"\s*[\w\s]+─{2,}", r"[\w\s]++─{2,}"),
    (r"(?:import|require).*\bzod\b|", r"(?:import|require)(?:(?!import|require|\bzod\b).)*+\bzod\b|"),
    (r"\(\s*(?:f[\"']|[^)]*\+)", r"\(\s*+(?:f[\"']|(?:(?!os\.popen\s*\()[^)+])*+\+)"),
    (r"algorithms?\s*[:=]\s*\[.*[\"']none[\"']", r"algorithms?\s*+[:=]\s*+\[(?:(?!algorithms?\s*[:=]\s*\[|[\"']none[\"']).)*+[\"']none[\"']"),
]


@cache
def java(pattern: str) -> str:
    """The pattern for Java: word borders between ASCII letters, as the tables mean them, and loops without frames."""
    return loops(pattern).replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")


def _needs(tree) -> list:
    """Literals, and alternatives of them, that a match of the parsed pattern holds in this order."""
    from re import _constants as C

    out, run = [], ""
    for op, arg in tree:
        if op is C.LITERAL and 32 < arg < 127:
            run += chr(arg)
            continue
        if run:
            out.append(run)
            run = ""
        if op is C.SUBPATTERN:
            out += _needs(arg[3])
        elif op is C.ATOMIC_GROUP:
            out += _needs(arg)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            out += _needs(arg[2])
        elif op is C.ASSERT and arg[0] > 0:
            out += _needs(arg[1])
        elif op is C.BRANCH:
            each = [_needs(b) for b in arg[1]]
            if all(each):
                out.append(each)
    return [*out, run] if run else out


#: Gaps between the two ends of a pattern, and what they are made of.
GAPS = {"[^)]*": "[^)]", ".*": "."}


@cache
def tempered(pattern: str) -> str:
    """A form that finds a match in the same texts, in time linear in them, where one gap parts a pattern in two.

    From a beginning the gap runs to the next end and stops at another beginning, which finds that end itself.
    """
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    rest, depth, at, gaps = pattern[len(flags) :], 0, 0, []
    while at < len(rest):
        gap = next((g for g in GAPS if depth == 0 and rest.startswith(g, at)), None)
        if gap:
            gaps.append((at, gap))
            at += len(gap)
        elif rest[at] == "\\":
            at += 2
        elif rest[at] == "[":
            at = rest.index("]", at + 2) + 1
        else:
            depth += {"(": 1, ")": -1}.get(rest[at], 0)
            if rest[at] == "|" and depth == 0:
                return pattern
            at += 1
    if len(gaps) != 1:
        return pattern
    ((at, gap),) = gaps
    first, last = rest[:at], rest[at + len(gap) :]
    if not first or not last or last == "\\)":
        return pattern
    return f"{flags}{first}(?:(?!{first}|{last}){GAPS[gap]})*+{last}"


#: More alternatives than this are not asked for one by one.
ALTERNATIVES = 8


def _words(wanted: list) -> tuple[str, ...]:
    """One literal of each alternative, the last."""
    return tuple(dict.fromkeys(x for w in wanted for x in ((w[-1],) if isinstance(w[-1], str) else _words(w[-1]))))


@cache
def needs(pattern: str) -> tuple[bool, tuple]:
    """Whether case counts, and the longest and the last literals that a match holds; each a tuple of alternatives."""
    from re import _parser

    parsed = _parser.parse(pattern)
    folded = bool(parsed.state.flags & re.I) or "(?i:" in pattern
    each = [(w,) if isinstance(w, str) else _words(w) for w in _needs(parsed)]
    each = [w for w in each if len(w) <= ALTERNATIVES]
    words = [w for w in each if min(map(len, w)) > 2]
    kept = dict.fromkeys([max(each, key=lambda w: min(map(len, w))), *words[-1:], each[-1]]) if each else ()
    return not folded, tuple(kept)


def _holds(text: Column, wanted, folded: bool) -> Column | None:
    tests = [_any([text.contains(x.lower() if folded else x) for x in w]) for w in wanted]
    return reduce(and_, tests) if tests else None


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def worth(text: Column, pattern: str, lowered: Column | None = None) -> Column:
    """Whether the text holds what a match must hold."""
    exact, wanted = needs(pattern)
    test = _holds(text if exact else F.lower(text) if lowered is None else lowered, wanted, not exact)
    return F.lit(True) if test is None else test


def found(text: Column, pattern: str) -> Column:
    """Whether the pattern matches somewhere in the text."""
    return worth(text, pattern) & text.rlike(java(tempered(pattern)))


def one_of(patterns: list[str]) -> str:
    """One alternation of patterns, each with its own flags."""
    return "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns)


def loops(pattern: str) -> str:
    for loop, form in LOOPS:
        pattern = pattern.replace(loop, form)
    return pattern


def last_words(pattern: str) -> tuple[str, ...]:
    """Alternatives of the last literal of a pattern's matches, in lower case; none if it has no literal."""
    _, wanted = needs(pattern)
    words = [w for w in wanted if min(map(len, w)) > 2] or wanted
    return tuple(x.lower() for x in words[-1]) if words else ()


def found_any(text: Column, patterns: list[str], lowered: Column | None = None) -> Column:
    """Whether one of Java's own patterns matches somewhere in the text, asked only if it holds the last literal of one."""
    test = text.rlike(one_of([loops(tempered(p)) for p in patterns]))
    words = [last_words(p) for p in patterns]
    if not all(words):
        return test
    low = F.lower(text) if lowered is None else lowered
    held = F.array(*[F.lit(x) for x in dict.fromkeys(x for w in words for x in w)])
    return F.exists(held, lambda x: F.contains(low, x)) & test


def _wide(tree, folded: bool) -> str:
    from re import _constants as C

    out = []
    for op, arg in tree:
        if op is C.LITERAL:
            out.append(re.escape(chr(arg)))
        elif op is C.NOT_LITERAL:
            out.append(f"[^\\x{{{arg:x}}}]")
        elif op is C.ANY:
            out.append("(?s:.)")
        elif op is C.IN:
            parts = {C.LITERAL: lambda x: f"\\x{{{x:x}}}", C.RANGE: lambda x: f"\\x{{{x[0]:x}}}-\\x{{{x[1]:x}}}", C.CATEGORY: lambda x: _CLASS[x], C.NEGATE: lambda _: "^"}
            out.append("[" + "".join(parts[o](a) for o, a in arg) + "]")
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high = min(arg[0], 8), arg[1] if arg[1] <= 8 else None
            out.append(f"(?:{_wide(arg[2], folded)}){{{low},{'' if high is None else high}}}")
        elif op is C.SUBPATTERN:
            within = _wide(arg[3], folded)
            out.append(f"(?i:{within})" if arg[1] & re.I else f"(?-i:{within})" if arg[2] & re.I else f"(?:{within})")
        elif op is C.ATOMIC_GROUP:
            out.append(f"(?:{_wide(arg, folded)})")
        elif op is C.BRANCH:
            out.append("(?:" + "|".join(_wide(b, folded) for b in arg[1]) + ")")
        elif op not in (C.AT, C.ASSERT, C.ASSERT_NOT):
            raise ValueError(f"no automaton for {op}")
    return "".join(out)


@cache
def wide(pattern: str) -> str:
    """An automaton's form that matches wherever Java's does, and in more places.

    Borders and looks ahead and back are left out, loops go on where they may end early, counts over eight are eight or more.
    """
    from re import _constants as C
    from re import _parser

    _CLASS.update({C.CATEGORY_SPACE: r"\s\x0b", C.CATEGORY_NOT_SPACE: r"\S", C.CATEGORY_WORD: r"\w", C.CATEGORY_NOT_WORD: r"\W", C.CATEGORY_DIGIT: r"\d", C.CATEGORY_NOT_DIGIT: r"\D"})
    parsed = _parser.parse(pattern)
    folded = bool(parsed.state.flags & re.I)
    return ("(?i)" if folded else "") + _wide(parsed, folded)


#: Classes of characters as an automaton's expressions write them; Java's blanks hold the vertical tab.
_CLASS: dict = {}


#: Wide forms that one automaton takes; far more of them have too many states.
TOGETHER = 6


def held(texts: pa.Array, patterns: tuple[str, ...]) -> np.ndarray:
    """Whether each text may match one of Java's patterns: all that do are told, and few others.

    First one automaton of words that matches hold, as it is fast in texts without any; in what is left, the wide forms.
    """
    short = {p: min(map(len, last_words(p)), default=0) < 3 for p in patterns}
    words = sorted({w for p in patterns if not short[p] for w in last_words(p)})
    first = "|".join([f"(?i:{re.escape(w)})" for w in words] + [f"(?:{wide(p)})" for p in patterns if short[p]])
    out = pc.match_substring_regex(texts, first)
    places, some = np.flatnonzero(out), texts.filter(out)
    out = np.zeros(len(texts), bool)
    for k in range(0, len(patterns) if len(places) else 0, TOGETHER):
        more = pc.match_substring_regex(some, "|".join(f"(?:{wide(p)})" for p in patterns[k : k + TOGETHER]))
        out[places[np.flatnonzero(more)]] = True
        rest = pc.invert(more)
        places, some = places[np.flatnonzero(rest)], some.filter(rest)
    return out


def counted(text: Column, pattern: str) -> Column:
    """Number of matches."""
    return F.when(worth(text, pattern), F.regexp_count(text, F.lit(java(pattern)))).otherwise(0)


#: What is told of a pattern in a text: its matches, whether it has one, the lines that hold one.
MATCHES, ANY, LINES = "matches", "any", "lines"


@dataclass(frozen=True)
class Ask:
    """A column of whole numbers: what is told of a pattern, in some languages (none named: all), else 0.

    Behind gates the pattern is searched only where the sum of each gate's columns, which come before, is enough.
    """

    column: str
    pattern: str
    what: str = MATCHES
    langs: tuple[str, ...] = ()
    gates: tuple[tuple[tuple[str, ...], int], ...] = ()


def automaton(pattern: str) -> bool:
    """Whether Arrow's expressions can state the pattern: they look neither ahead nor back and repeat a thousand times at most."""
    return not any(x in pattern for x in ("(?!", "(?=", "(?<", "3000"))


def _told(texts: pa.Array, pattern: str, what: str) -> np.ndarray:
    if what == MATCHES:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    held = pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    if what == ANY or not held.any():
        return held.astype(np.int32)
    # A line that matches does so in its text as well, so only the lines of such texts are searched.
    lines = pc.split_pattern(texts.filter(pa.array(held)), "\n")
    hits = pc.match_substring_regex(lines.flatten(), pattern).to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), np.int32)
    out[held] = np.add.reduceat(hits.astype(np.int32), lines.offsets.to_numpy()[:-1] - lines.offsets[0].as_py())
    return out


def tallied(rows: DataFrame, asks: list[Ask]) -> DataFrame:
    """``rows`` (text without nulls; lang and the columns of gates, if asks name any) with a column for each ask."""
    own = rows.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{a.column}` int" for a in asks])

    def read(batches):
        for batch in batches:
            texts, known, columns = batch.column(own.index("text")), {}, {}
            value = lambda name: columns[name] if name in columns else batch.column(own.index(name)).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            for a in asks:
                if (a.langs, a.gates) not in known:
                    at = pc.is_in(batch.column(own.index("lang")), pa.array(a.langs)).to_numpy(zero_copy_only=False) if a.langs else np.ones(len(texts), bool)
                    for names, least in a.gates:
                        at = at & (sum(map(value, names)) >= least)
                    known[a.langs, a.gates] = at, texts if at.all() else texts.filter(pa.array(at))
                at, some = known[a.langs, a.gates]
                columns[a.column] = np.zeros(len(texts), np.int32)
                columns[a.column][at] = _told(some, a.pattern, a.what)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns.values())], [*own, *columns])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(read, schema)
