"""Conversation repair against an exhaustive search over edits."""

import hashlib
import itertools
import re
import zlib

import pytest

from noticeflow.llm import turn_repair

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, key string, pos string, marks string"
BLANK = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """(conv, turn, role, text) after the damage."""
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        role, text = say(role), say(text)
        d = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else role
        out += [(conv, turn, role, text)] * (2 if d == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain_faults(turns):
    seen, faults = set(), []
    for _, _, role, text in turns:
        core = text.rstrip(BLANK)
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def plain_repair(turns, faults):
    """Least cost and audit, and the repaired lines, by trying everything."""
    inserts = [(), *((r,) for r in "ua"), *itertools.product("ua", repeat=2)]
    best = None

    def go(i, cost, audit, roles, lines):
        nonlocal best
        if best and cost > best[0]:
            return
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == len(turns):
            for more in inserts:
                r = roles + "".join(more)
                if GOOD.fullmatch(r):
                    found = (cost + 5 * len(more), audit + "I" * len(more), lines + [{"u": "user:", "a": "assistant:"}[x] for x in more])
                    best = min(best or found, found)
            return
        for more in inserts:
            c, a, r = cost + 5 * len(more), audit + "I" * len(more), roles + "".join(more)
            add = lines + [{"u": "user:", "a": "assistant:"}[x] for x in more]
            _, _, role, text = turns[i]
            go(i + 1, c + 2, a + "D", r, add)
            if faults[i] in ("", "t"):
                extra = 5 if faults[i] else 0
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, c + extra, a + "K", r + role[0], [*add, f"{role}:{text}"])
                for to in ("user", "assistant"):
                    go(i + 1, c + extra + 1, a + "R", r + to[0], [*add, f"{to}:{text}"])

    go(0, 0, "", "", [])
    return best


def plain_report(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = plain_damage([r for r in rows if r[0] == conv])
        faults = plain_faults(turns)
        places = {t[1] for t in turns} - {None}
        initials = [t[2][:1] for t in turns]
        cost, audit, lines = plain_repair(turns, faults)
        out[conv] = (
            max(places) - min(places) + 1 - len(places) if places else 0,
            *(faults.count(x) for x in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def ours(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y", None) for r in rows], SCHEMA).repartition(3)
    named = turn_repair.schema_of(table, "conv_id", "turn", "role", "text")
    found = turn_repair.repair_report(spark, named.withColumnRenamed("conv", "conv_id"), turn_repair.damage(named)).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}


def made(rng, n, size):
    texts = ["Well.", "So?", "cut off", "cut, ", " \n", "", "Yes!  ", None, "é."]
    roles = ["user", "assistant", "system", "tool", None, "", "author"]
    rows = []
    for conv in range(n):
        for i in range(rng.randrange(size)):
            turn = None if rng.random() < 0.1 else i + (rng.random() < 0.2)
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[i % 2]
            rows.append((conv if conv else None, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"No {i}."))
    return rows


@pytest.fixture(scope="module")
def rng():
    import random

    return random.Random(7)


def test_report_is_what_trying_everything_gives(spark, rng):
    rows = made(rng, 60, 6)
    assert ours(spark, rows) == plain_report(rows)


def test_runs_may_be_cut_anywhere(spark, rng, monkeypatch):
    """Runs of two turns: every conversation is put together from several."""
    monkeypatch.setattr(turn_repair, "RUN_BITS", 1)
    monkeypatch.setattr(turn_repair, "HASH_BITS", 1)
    rows = made(rng, 40, 6)
    assert ours(spark, rows) == plain_report(rows)


def test_runs_combine_to_the_sum_of_the_whole(rng):
    for _ in range(400):
        marks = "".join(rng.choice("suaxbdSUAX") for _ in range(rng.randrange(1, 14)))
        at = rng.randrange(len(marks) + 1)
        two = turn_repair.joined_sums(turn_repair.sums(marks[:at]), turn_repair.sums(marks[at:]))
        assert two == turn_repair.sums(marks)


def test_least_cost_and_audit(rng):
    for _ in range(300):
        marks = "".join(rng.choice("suaxbdSUA") for _ in range(rng.randrange(0, 6)))
        turns = [(0, 0, {"s": "system", "u": "user", "a": "assistant"}.get(m.lower(), "tool"), f"{i}") for i, m in enumerate(marks)]
        faults = [m if m in "bd" else "t" if m.isupper() else "" for m in marks]
        assert turn_repair.best(turn_repair.run_sum(marks, "n")) == plain_repair(turns, faults)[:2], marks


def test_one_conversation_holds_most_rows(spark):
    """A long conversation with a hot row and texts of any length; nothing but its own digest is whole anywhere."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(6000)] + [(1, None, "user", "again")] * 2000 + [(2, 0, "user", "x" * 300_000 + "."), (3, 1, None, None)]
    found = ours(spark, rows)
    turns = plain_damage([r for r in rows if r[0] == 1])
    faults = plain_faults(turns)
    marks = "".join(f if f in ("b", "d") else t[2][0].upper() if f else t[2][0] for t, f in zip(turns, faults))
    cost, audit = turn_repair.best(turn_repair.run_sum(marks, "n"))
    lines, at = [], iter(turns)
    for letter, role, added in turn_repair.edits(audit, marks):
        lines += [{"u": "user:", "a": "assistant:"}[x] for x in added]
        if letter != "I":
            t = next(at)
            lines += [f"{role or t[2]}:{t[3]}"] if letter != "D" else []
    assert found[1][1:4] == tuple(faults.count(x) for x in "bdt")
    assert found[1][5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert {k: v for k, v in found.items() if k != 1} == plain_report([r for r in rows if r[0] != 1])


def test_empty_table(spark):
    assert ours(spark, []) == {}
