"""Structure repair against a dynamic program over rows, and that against all edits of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from frostline.llm import structure
from frostline.llm.queries import op11_structure

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
OUT = {"u": "user", "a": "assistant"}


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def faults(rows: list[tuple]) -> list:
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows: list[tuple], fault: list) -> tuple:
    """(cost, audit, turns) by the best way to each state, row by row."""

    def inserted(best):
        for _ in range(3):
            for s, (c, a, t) in list(best.items()):
                new = (c + 5, a + "I", [*t, f"{OUT[NEXT[s]]}:"])
                if NEXT[s] not in best or new[:2] < best[NEXT[s]][:2]:
                    best[NEXT[s]] = new
        return best

    best = {"": (0, "", [])}
    for (_, _, role, text), f in zip(rows, fault):
        after: dict = {}

        def put(s, *new):
            if s not in after or new[:2] < after[s][:2]:
                after[s] = new

        for s, (c, a, t) in inserted(best).items():
            put(s, c + 2, a + "D", t)
            if f not in ("blank", "duplicate"):
                more = 5 if f else 0
                if role[:1] == NEXT[s] or (role[:1] == "s" and s == ""):
                    put(role[:1], c + more, a + "K", [*t, f"{role}:{text}"])
                put(NEXT[s], c + 1 + more, a + "R", [*t, f"{OUT[NEXT[s]]}:{text}"])
        best = after
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def by_trying_all(rows: list[tuple], fault: list) -> tuple:
    found = []
    places = len(rows) + 1
    for edits in itertools.product("DKua", repeat=len(rows)):
        for holes in itertools.product(["", "u", "a", "ua", "au"], repeat=places):
            cost, audit, initials, fits = 0, "", "", True
            for i in range(places):
                cost, audit, initials = cost + 5 * len(holes[i]), audit + "I" * len(holes[i]), initials + holes[i]
                if i < len(rows):
                    e = edits[i]
                    fits &= e == "D" or fault[i] not in ("blank", "duplicate")
                    initials += "" if e == "D" else rows[i][2][:1] if e == "K" else e
                    cost += {"D": 2, "K": 0}.get(e, 1) + (5 if e != "D" and fault[i] == "truncated" else 0)
                    audit += e if e in "DK" else "R"
            if fits and re.fullmatch("(s?(ua)+)?", initials):
                found.append((cost, audit))
    return min(found)


def brute(rows: list[tuple], broken: bool = True) -> dict:
    talks = {conv: [] for conv, *_ in rows}
    for r in damage(rows) if broken else rows:
        talks[r[0]].append(r)
    out = {}
    for conv, own in talks.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        fault, turns = faults(own), {t for _, t, _, _ in own if t is not None}
        cost, audit, said = cheapest(own, fault)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *map(fault.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def got(df) -> dict:
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def made(rng: random.Random, talks: int, most: int = 12) -> list[tuple]:
    texts = ["Yes.", "No!", "what", "", " \t", "end.  \n", "cut \x0b", "Why?"]
    roles = ["system", "user", "assistant", "tool", "", "student", "s", "a", None]
    rows = []
    for c in range(talks):
        even = rng.random() < 0.4
        for t in range(rng.randint(1, most)):
            role = ("user", "assistant")[t % 2] if even and rng.random() < 0.9 else rng.choice(roles)
            text = f"{t} {rng.choice(texts)}" if rng.random() < 0.7 else rng.choice([*texts, None])
            rows.append((c if rng.random() < 0.98 else None, rng.choice([t, t, t, t + 3, None]) if rng.random() < 0.2 else t, role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_the_program_is_the_cheapest_of_all():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(0, i, rng.choice(["s", "u", "a", "t"]), "x") for i in range(rng.randint(0, 3))]
        fault = [rng.choice([None, None, "truncated", "blank"]) for _ in rows]
        assert cheapest(rows, fault)[:2] == by_trying_all(rows, fault)


@pytest.mark.parametrize("bits", [12, 4, 2])
def test_same_as_row_by_row(spark, bits):
    """Small blocks cut conversations into segments, and 2 bits give a tree of several levels."""
    rows = made(random.Random(7), 60) + [(999, i, random.Random(i).choice(["user", "assistant", "system"]), f"{i % 37} ok{'.' * (i % 3)}") for i in range(150)]
    df = structure.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got(structure.report(structure.plan_edits(df, bits))) == brute(rows)


def test_repaired_turns(spark):
    rows = made(random.Random(3), 40)
    edits = structure.plan_edits(structure.damaged(spark.createDataFrame(rows, SCHEMA)), 3)
    said: dict = {}
    for r in sorted(structure.repaired_turns(edits).collect(), key=lambda r: (r.at, r.k)):
        said.setdefault(r.conv_id, []).append(r)
    want = brute(rows)
    for conv, turns in said.items():
        assert re.fullmatch("s?(ua)+", "".join(r.role[:1] for r in turns))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == want[conv][-1]
    assert all(not want[c][6].strip("D") for c in set(want) - set(said))


def test_runs_and_powers():
    """Long runs cost what their rows cost one by one, and copies beyond the first are deletions."""
    rng = random.Random(4)
    for _ in range(30):
        rows = [(i, rng.randrange(9), rng.choice([1, 1, 1, 40])) for i in range(rng.randint(1, 30)) for _ in range(rng.choice([1, 5]))]
        step = structure.INSERTS
        for _, symbol, n in reversed(rows):
            for s in [structure.MUST_GO] * (n - 1) + [symbol]:
                step = structure.times(structure.power(s, 0), step)
        assert (structure.transition(rows) == step).all()
    edits, state = structure.choose([(0, 3, 1), (1, 0, 10**6)], structure.NOTHING, structure.ACCEPT, True)
    assert state == structure.NOTHING and edits == [("D", ""), ("D" * 10**6, "")]


def test_edges(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, a long text, conversations that vanish, clashing columns, no rows."""
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "assistant", "Yo."), (1, None, "user", "a."), (1, None, "user", "a."), (1, None, "assistant", "b."), (2, 1, "user", "x" * 300_000 + ".  "), (2, 9, "assistant", "y" * 300_000)]
    rows += [(c, 0, "user", "only.") for c in range(10, 70)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as at", "2 as n", "3 as copies", "'q' as audit")
    want = brute(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert (0, 0, 0, 0, 0, 0, "", empty) in want.values()
    assert got(structure.repair(structure.damaged(df))) == want
    assert structure.repair(structure.damaged(df.limit(0))).count() == 0
    assert structure.repaired_turns(structure.plan_edits(structure.damaged(df.limit(0)))).count() == 0
    named = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yo.")], "conv_id string, turn int, role string, text string")
    assert got(structure.repair(structure.damaged(named))) == brute([tuple(r) for r in named.collect()])


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_structure(spark, "/root/testdata/sf0.001")) == brute(rows)
