from __future__ import annotations

import hashlib
import random
import zlib
from functools import cache

import pytest

from obsframe.llm import queries, repair, viterbi
from obsframe.llm.repair import RepairParams

SPACE = " \t\n\x0b\x0c\r"


def best_audit(rows):
    """(cost, audit) by trying everything, least audit first; rows: (initial, must go, truncated)."""

    @cache
    def go(i, state, inserted):
        out = []
        if i == len(rows) and state in "0a":
            out.append((0, ""))
        following = "a" if state == "u" else "u"
        if inserted < 3:
            cost, rest = go(i, following, inserted + 1)
            out.append((cost + 2, "I" + rest))
        if i < len(rows):
            initial, gone, late = rows[i]
            cost, rest = go(i + 1, state, 0)
            out.append((cost + 3, "D" + rest))
            if not gone:
                cost, rest = go(i + 1, following, 0)
                out.append((cost + 2 + late, "R" + rest))
                if initial == following or (initial, state) == ("s", "0"):
                    cost, rest = go(i + 1, initial, 0)
                    out.append((cost + late, "K" + rest))
        return min(out, default=(1 << 40, ""))

    return go(0, "0", 0)


def brute(rows):
    """The contract read row by row: rows (turn, role, text) of one conversation after damage, in order."""
    seen, marked = set(), []
    blank = duplicate = truncated = 0
    for _, role, text in rows:
        told = text.strip(SPACE)
        fault = "blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, duplicate, truncated = blank + (fault == "blank"), duplicate + (fault == "duplicate"), truncated + (fault == "truncated")
        marked.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = best_audit(tuple(marked))
    out, state, at = [], "0", 0
    for x in audit:
        following = "a" if state == "u" else "u"
        if x == "I":
            out.append(({"u": "user", "a": "assistant"}[following], ""))
            state = following
            continue
        _, role, text = rows[at]
        at += 1
        if x != "D":
            state = role[0] if x == "K" else following
            out.append((role if x == "K" else {"u": "user", "a": "assistant"}[following], text))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, blank, duplicate, truncated, illegal, cost, audit, digest


def damaged(table):
    """All conversations of rows (conv_id, turn, role, text) after damage."""
    out = {}
    for conv, turn, role, text in table:
        out.setdefault(conv, [])
        show = lambda x: " " if x is None else x
        fault, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    by = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(rows, key=by) for c, rows in out.items()}


def conversations(rng, n, length):
    table = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([1, 2, length])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", None, ""])
            if rng.random() < 0.6:
                role = ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "and", " \t", "", None, f"turn {turn}?", f"said {turn} \n", "é. "])
            table.append((conv, rng.choice([turn] * 9 + [None, turn + 3]), role, text))
    return table


def answer(spark, table, p, tmp_path=None):
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    hurt = repair.damage(rows)
    edits, status = repair.plan(hurt, p)
    told = {r.c: r for r in repair.digests(repair.repaired(hurt, edits)).collect()}
    return {
        r.c: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, told[r.c].cost, told[r.c].audit, told[r.c].repaired_sha256) for r in status.collect()
    }


def same(spark, table, p):
    got = answer(spark, table, p)
    expected = {("" if c is None else f"={c}"): brute(rows) for c, rows in damaged(table).items() if rows}
    assert got == expected
    return got


@pytest.mark.parametrize("p", [RepairParams(), RepairParams(chunk_rows=3), RepairParams(chunk_rows=1, passes=1)])
def test_like_brute_force(spark, p):
    got = same(spark, conversations(random.Random(p.chunk_rows), 25, 25), p)
    assert {x for v in got.values() for x in v[6]} == set("DIKR")


@pytest.mark.parametrize("roles", [["user"], ["tool"], ["system"], ["user", "assistant"], ["assistant"]])
def test_one_conversation_over_many_chunks(spark, roles):
    """Rows that carry a difference on for ever never converge; the passes end and the steps are composed."""
    table = [(7, t, roles[t % len(roles)], f"said {t}.") for t in range(90)]
    same(spark, table, RepairParams(chunk_rows=7, passes=2))


def test_convergence_needs_few_rows():
    rng = random.Random(2)
    meets = 0
    for _ in range(200):
        codes = "".join(rng.choices("uauaUAso", k=40))
        assert viterbi.parallel(codes, (0, 0, 0, 0), viterbi.END) == (viterbi.backward(codes, (0, 0, 0, 0)) == viterbi.backward(codes, viterbi.END))
        meets += viterbi.parallel(codes, (0, 0, 0, 0), viterbi.END)
        tail = viterbi.normal(tuple(rng.randint(0, 4) for _ in range(4)))
        assert viterbi.product(viterbi.matrix(codes), tail) == viterbi.backward(codes, tail)
    assert meets > 150


def test_copies_blanks_and_nothing_left(spark):
    table = [(1, 0, "user", "Again.")] * 30 + [(1, 1, "user", " ")] * 5 + [(2, None, None, None)] * 3 + [(3, t, "user", "Hm.") for t in range(3)]
    same(spark, table, RepairParams(chunk_rows=2))


def test_query_returns_every_conversation(spark, tmp_path):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = conversations(random.Random(5), 12, 9) + [(lost + 5000, None, None, None)]
    drop = next(c for c in range(6000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table.append((drop, 0, "user", "Gone."))
    frame = spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id long, turn long, role string, text string, mark string, c int")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op12_repair(spark, str(tmp_path))
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"] * 2
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: brute(rows) if rows else nothing for c, rows in damaged(table).items()}
    assert got[drop] == nothing


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    edits, status = repair.plan(repair.damage(rows))
    assert edits.collect() == [] and status.collect() == [] and repair.digests(repair.repaired(rows, edits)).collect() == []
