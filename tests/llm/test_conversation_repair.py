"""Conversation repair against plain search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodemark.llm import conversation_repair as cr
from lodemark.llm import queries as llm_queries
from lodemark.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int, digest string, id string, copies int, col int"
GOAL = re.compile(r"(s?(ua)+)?\Z")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        marks = WORD.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(cost, audit, repaired rows): every row's edits in turn, the best of each way to write roles so far."""
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(2 * len(rows) + 3):
            for roles, (cost, audit, done) in list(best.items()):
                for name in ("user", "assistant"):
                    if legal_so_far(roles + name[0]):
                        put(best, roles + name[0], cost + 3, audit + "I", (*done, (name, "")))
        return best

    def put(table, roles, cost, audit, done):
        if roles not in table or (cost, audit) < table[roles][:2]:
            table[roles] = (cost, audit, done)

    def legal_so_far(roles):
        return re.match(r"s?(ua)*u?\Z", roles) and len(roles) <= 2 * len(rows) + 3

    best = insert(best)
    for (role, text), kind in zip(rows, kinds, strict=True):
        after = {}
        for roles, (cost, audit, done) in best.items():
            put(after, roles, cost + 4, audit + "D", done)
            if kind not in ("blank", "duplicate"):
                more = 3 if kind == "truncated" else 0
                if role[:1] and legal_so_far(roles + role[0]):
                    put(after, roles + role[0], cost + more, audit + "K", (*done, (role, text)))
                for name in ("user", "assistant"):
                    if legal_so_far(roles + name[0]):
                        put(after, roles + name[0], cost + more + 3, audit + "R", (*done, (name, text)))
        best = insert(after)
    return min((cost, audit, done) for roles, (cost, audit, done) in best.items() if GOAL.match(roles))


def expected(rows):
    """The report's row for one conversation's original rows (turn, role, text), none of them tied."""
    after = []
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        after += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    turns = {t for t, _, _ in after if t is not None}
    pairs = [r[1:] for r in after]
    kinds = faults(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
    cost, audit, done = cheapest(pairs, kinds)
    text = "\n".join(f"{r}:{t}" for r, t in done)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, "y", "z", 2, 3) for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.report(frame).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert got == {k: expected(v) for k, v in groups.items()}
    return got


def random_rows(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in sorted(rng.sample(range(longest + 4), rng.randint(1, longest))):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn if rng.random() > 0.05 else None, role, rng.choice(["a.", "b!", "c?  \n", "d", "", " \t", None, "e . x", "long " * 50 + "."])))
    return rows


def test_report_equals_plain_search(spark):
    rows = random_rows(1, 150, 6) + [(None, 0, "user", "q."), (None, 1, "assistant", "r."), (None, None, None, None)]
    got = check(spark, rows)
    assert {r[5] for r in got.values()} > {0, 3, 4}


def test_windows_agree_with_one_search(spark, monkeypatch):
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 14))]
        whole = cr.search(rows, {0: (0, "")}, last=True)
        for size in (1, 3):
            monkeypatch.setattr(cr, "WINDOW", size)
            state = cr._Plan()
            for turn, (initial, fault) in enumerate(rows):
                state.add(turn, initial, fault)
            ((cost, audit),) = whole.values()
            assert state.result()[-2:] == (cost, audit)


def test_long_conversation(spark):
    rows = [(7, t, "user" if t % 2 == 0 or t % 31 == 0 else "assistant", f"t{t}." if t % 7 else f"t{t}") for t in range(9000)]
    plan = cr.plan(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()[0]
    assert plan["truncated"] == sum(t % 7 == 0 for t in range(9000))
    edits = cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert "".join(r["edit"] for r in edits) == plan["audit"]
    left = "".join(r["role"][0] for r in edits if r["edit"] != "D")
    assert GOAL.match(left) and [r["position"] for r in edits] == list(range(len(edits)))
    assert plan["cost"] == sum({"K": 0, "R": 3, "D": 4, "I": 3}[r["edit"]] + 3 * (r["edit"] in "KR" and r["text"][-1:] != ".") for r in edits)


def test_ties_go_to_the_least_audit():
    assert cr.search([("a", ""), ("u", "")], {0: (0, "")}, last=True) == {3: (6, "IKKI")}
    assert cr.search([("u", "blank")], {0: (0, "")}, last=True) == {0: (4, "D")}
    assert cr.search([("s", "")], {0: (0, "")}, last=True) == {0: (4, "D")}


def test_empty_table(spark):
    assert cr.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert cr.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").collect()]
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    got = {r["conv_id"]: tuple(r)[1:] for r in llm_queries.op13_conversation_repair(spark, SF).collect()}
    assert got == {k: expected(v) for k, v in groups.items()}


@pytest.mark.parametrize("text, kind", [("", "blank"), (" \t\x0b", "blank"), ("\x85", "truncated"), ("a.\n ", ""), ("a. b", "truncated")])
def test_faults(spark, text, kind):
    got = cr.plan(spark.createDataFrame([(1, 1, "user", text)], "conv_id long, turn long, role string, text string")).collect()[0]
    assert [k for k in ("blank", "duplicate", "truncated") if got[k]] == ([kind] if kind else [])
