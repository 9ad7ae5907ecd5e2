"""Single-assignment form of functions: dominators, joins, versions and taint over the graph of their statements.

A graph (``flow``) is as small as a function, so it is worked out in Python, file by file in
Arrow batches. A version is written name.number; a join (φ) gives a name a new version where different ones meet.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .structure import _ASSIGN, _NAME, _SINK, _SOURCE, CONFIDENCE


def dominators(after: dict[int, set[int]], entry: int = 0) -> tuple[dict[int, int], dict[int, set[int]]]:
    """The nearest dominator of each line that is reached, and each line's frontier."""
    order, seen, stack = [], {entry}, [(entry, iter(sorted(after.get(entry, ()))))]
    while stack:
        node, rest = stack[-1]
        nxt = next((x for x in rest if x not in seen), None)
        if nxt is None:
            order.append(stack.pop()[0])
        else:
            seen.add(nxt)
            stack.append((nxt, iter(sorted(after.get(nxt, ())))))
    place = {n: k for k, n in enumerate(order)}
    before = defaultdict(list)
    for a in order:
        for b in after.get(a, ()):
            before[b].append(a)
    near, changed = {entry: entry}, True
    while changed:
        changed = False
        for n in order[-2::-1]:
            known = [p for p in before[n] if p in near]
            new = known[0]
            for p in known[1:]:
                while new != p:
                    if place[new] < place[p]:
                        new = near[new]
                    else:
                        p = near[p]
            if near.get(n) != new:
                near[n], changed = new, True
    frontier = defaultdict(set)
    for n in order:
        if len(before[n]) > 1 or n == entry and before[n]:
            for p in before[n]:
                while p != near[n] or p == n == entry:
                    frontier[p].add(n)
                    if p == entry:
                        break
                    p = near[p]
    return near, frontier


def converted(body: str, lang: str = "typescript", first: int = 1) -> dict:
    """Blocks, joins, versions and taint paths of a function whose first line has number ``first``."""
    from .flow import graph

    g = graph(body, lang)
    lines, after = [text for _, text in g.nodes], g.after
    number = [line for line, _ in g.nodes]
    near, frontier = dominators(after)
    sets = {n: m for n in near if (m := _ASSIGN.match(lines[n]))}
    joins: dict[int, set[str]] = defaultdict(set)
    for name in {m[1] for m in sets.values()}:
        work = [n for n, m in sets.items() if m[1] == name]
        while work:
            for f in frontier[work.pop()]:
                if name not in joins[f]:
                    joins[f].add(name)
                    work.append(f)
    below = defaultdict(list)
    for n, p in near.items():
        if n != p:
            below[p].append(n)
    count, phi, uses, defs = defaultdict(int), defaultdict(set), {}, {}

    def fresh(name: str) -> str:
        count[name] += 1
        return f"{name}.{count[name]}"

    made = {(n, name): fresh(name) for n in sorted(joins) for name in sorted(joins[n])}
    walk = [(0, {})]
    while walk:
        n, now = walk.pop()
        now = now | {name: made[n, name] for name in joins.get(n, ())}
        m = sets.get(n)
        uses[n] = [now[x] for x in dict.fromkeys(_NAME.findall(m[2] if m else lines[n])) if x in now]
        if m:
            now = now | {m[1]: fresh(m[1])}
            defs[n] = now[m[1]]
        for b in after.get(n, ()):
            for name in joins.get(b, ()):
                if name in now:
                    phi[made[b, name]].add(now[name])
        walk += [(b, now) for b in sorted(below[n], reverse=True)]
    source = {defs[n]: n for n, m in sets.items() if _SOURCE.search(m[2])}
    changed = True
    while changed:
        changed = False
        for version, parts in [*((defs[n], uses[n]) for n in defs), *phi.items()]:
            found = [source[p] for p in parts if p in source]
            if found and (version not in source or min(found) < source[version]):
                source[version], changed = min(found), True
    paths = []
    for n in sorted(near):
        sink = _SINK.search(lines[n])
        if sink:
            used = set(_NAME.findall(sink[2]))
            paths += [(sink[1], number[source[v]] + first, number[n] + first, v) for v in uses[n] if v in source and v.rsplit(".", 1)[0] in used]
    back = defaultdict(int)
    for n in near:
        for b in after.get(n, ()):
            back[b] += 1
    forked = {b for n in near if len(after.get(n, ())) > 1 for b in after[n]}
    blocks = sum(1 for n in near if n == 0 or back[n] != 1 or n in forked)
    return {"blocks": blocks, "joins": sorted(made.values()), "versions": sum(count.values()), "paths": paths}


def ssa_paths(files: DataFrame) -> DataFrame:
    """(path, number, blocks, joins, versions, sink, source_line, sink_line, version, confidence) of files (path, content, lang).

    A function without a taint path has one row with a null sink; lines count from the function's first.
    """
    from .source import bodies

    names = ["path", "number", "blocks", "joins", "versions", "sink", "source_line", "sink_line", "version", "confidence"]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64())
    schema = "path string, number int, blocks int, joins int, versions int, sink string, source_line int, sink_line int, version string, confidence double"

    def read(batches):
        for batch in batches:
            rows = []
            for path, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, body in enumerate(bodies(text or "", lang or "")):
                    form = converted(body, lang or "")
                    head = (path, n, form["blocks"], len(form["joins"]), form["versions"])
                    rows += [(*head, *p, CONFIDENCE) for p in form["paths"]] or [(*head, None, None, None, None, None)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("path", "content", "lang").mapInArrow(read, schema)
