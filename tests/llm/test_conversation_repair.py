"""Conversation repair against dynamic programming over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tesserae.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string, row long, again boolean"


def cheapest(rows, entry=cr.START, goal=cr.A):
    """(cost, audit) by states and rows."""

    def with_inserts(at):
        for _ in range(4):
            for state, (cost, audit) in list(at.items()):
                to, new = cr.NEXT[state][1], (cost + 3, audit + "I")
                at[to] = min(at.get(to, new), new)
        return at

    at = with_inserts({entry: (0, "")})
    for initial, gone, cut in rows:
        new = {}
        for state, (cost, audit) in at.items():
            moves = [(state, 4, "D")]
            if not gone:
                moves.append((cr.NEXT[state][1], 3 + 3 * cut, "R"))
                if (state, initial) in cr.STEP:
                    moves.append((cr.STEP[state, initial], 3 * cut, "K"))
            for to, more, edit in moves:
                found = (cost + more, audit + edit)
                new[to] = min(new.get(to, found), found)
        at = with_inserts(new)
    return at.get(goal)


def slow_repair(rows):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of (conv_id, turn, role, text)."""
    convs, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        convs[conv] += [[], [(turn, role, "")], [(turn, role, re.sub("[.!?]", "", text))], [(turn, role, text)] * 2, [(turn, "user", text)]][case] if case < 5 else [(turn, role, text)]
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, cases, n = set(), [], [0, 0, 0]
        for _, role, text in turns:
            found = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not found else 1 if (role, text) in seen else 2 if found[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            cases.append((role[:1], fault in (0, 1), fault == 2))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(cases, cases[1:]))
        cost, audit = min(cheapest(cases, goal=g) for g in (cr.START, cr.A) if cheapest(cases, goal=g))
        lines, at, last = [], 0, ""
        for edit in audit:
            to = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append((to, ""))
            else:
                _, role, text = turns[at]
                at += 1
                lines += [(role, text)] if edit == "K" else [(to, text)] if edit == "R" else []
            last = lines[-1][0][:1] if lines else ""
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("kind", ["ua", "uuaasx", "u", "s", "x", "ssua"])
def test_search_finds_the_cheapest_edits(kind):
    rng = random.Random(kind)
    for _ in range(80):
        rows = [(rng.choice(kind), rng.random() < 0.2, rng.random() < 0.4) for _ in range(rng.randrange(0, 16))]
        for entry, goal in itertools.product(range(4), range(4)):
            if cr.reachable(entry, goal):
                want = cheapest(rows, entry, goal)
                assert cr.solve(rows, entry, goal) == want
                assert want is None or cr.suffix_bounds(rows)[0] <= want[0]


def test_runs_join_to_the_whole():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice("uuaasx"), rng.random() < 0.2, rng.random() < 0.4) for _ in range(24)]
        a, b = sorted(rng.sample(range(1, 24), 2))
        parts = [cr.solve_all(p, range(4), range(4)) for p in (rows[:a], rows[a:b], rows[b:])]
        found = cr.joined(cr.joined(parts[0], parts[1]), parts[2])
        assert cr.whole(found) == min(cheapest(rows, goal=cr.START), cheapest(rows))


@pytest.mark.parametrize("length", [3, 16])
def test_repair(spark, length):
    rng = random.Random(length)
    texts = ["Yes.", "No", "why?", "", " \t", None, "a\nb!", "long " * 5000 + "end."]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None, ""]), rng.choice(texts) if rng.random() < 0.4 else f"text {c} {t}.") for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, "user" if t % 2 else "assistant", f"turn {t}." if t % 7 else "same.") for t in range(300)]  # over many runs and ranges
    rows += [(101, t, "user", "copies.") for t in range(100)] + [(102, None, "user", "a."), (102, None, "assistant", "b."), (102, 3, "user", "c."), (None, 1, "user", "x."), (None, None, None, None), (103, 4, "user", "twice."), (103, 4, "user", "twice.")]
    rows += [(1000 + c, 0, "user", "alone.") for c in range(60)]  # some lose their only row
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 7, "x", 7, True) for r in rows], SCHEMA).repartition(3)
    every = df.select("conv_id").distinct().withColumn("conv_key", cr.conv_key(df["conv_id"]))
    got = every.join(cr.repair(cr.damage(df), length), "conv_key", "left").drop("conv_key").collect()
    want = slow_repair(rows)
    found = {r["conv_id"]: tuple(r)[1:] for r in got}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert len(got) == len(want) and any(v == empty for v in want.values())
    assert {k: empty if v[0] is None else v for k, v in found.items()} == want
    whole = {r["conv_id"]: tuple(r)[1:] for r in cr.repair_conversations(df, cr.damage(df)).collect()}
    assert whole == want
    assert cr.repair_conversations(df.limit(0), cr.damage(df.limit(0))).count() == 0
