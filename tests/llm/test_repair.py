"""Conversation repair against plain dynamic programming over all edits."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from stratafold.llm import repair

STEP = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """Least (cost, audit, turns) by states; rows of (role, text, fault)."""
    def inserts(states):
        out = dict(states)
        for _ in range(2):
            for q, (c, a, t) in list(out.items()):
                new = (c + 3, a + "I", (*t, ({"u": "user", "a": "assistant"}[STEP[q]], "")))
                if STEP[q] not in out or new[:2] < out[STEP[q]][:2]:
                    out[STEP[q]] = new
        return out

    states = inserts({"": (0, "", ())})
    for role, text, fault in rows:
        new = {}

        def put(q, x):
            if q not in new or x[:2] < new[q][:2]:
                new[q] = x

        for q, (c, a, t) in states.items():
            put(q, (c + 4, a + "D", t))
            if fault in (0, 3):
                more = 3 if fault == 3 else 0
                if (role[:1] == "s" and q == "") or (role[:1] in ("u", "a") and role[:1] == STEP[q]):
                    put(role[:1], (c + more, a + "K", (*t, (role, text))))
                put(STEP[q], (c + 3 + more, a + "R", (*t, ({"u": "user", "a": "assistant"}[STEP[q]], text))))
        states = inserts(new)
    return min((states[q] for q in ("", "a") if q in states), key=lambda x: x[:2])


def damaged(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
        role, text = (" " if x is None else x for x in (role, text))
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        mine += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def plain_report(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        seen, faulty = set(), []
        for _, role, text in mine:
            stripped = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 1 if not stripped else 2 if (role, text) in seen else 3 if stripped[-1] not in ".!?" else 0
            seen.add((role, text))
            faulty.append((role, text, fault))
        n = Counter(f for *_, f in faulty)
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, fixed = plain_repair(faulty)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (gaps, n[1], n[2], n[3], illegal, cost, audit, sha)
    return out


def result(df):
    got = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(out) == len(got)
    return out


def test_auction_finds_the_least_audit():
    r = random.Random(4)
    for _ in range(3000):
        rows = [(r.choice(["system", "user", "assistant", "tool", ""]), "x", r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(0, 12))]
        letters = "".join(chr(65 + {"s": 0, "u": 1, "a": 2}.get(x[:1], 3) * 4 + f) for x, _, f in rows)
        assert repair.cheapest_repair(letters) == plain_repair(rows)[:2]


def test_prices_are_feasible_and_long_ones_take_linear_work():
    r = random.Random(5)
    letters = "".join(chr(65 + r.randrange(16)) for _ in range(30_000))
    price = repair.auction(letters)
    for i in range(0, len(letters), 97):
        for q in range(4):
            assert price[4 * i + q] == min(c + price[4 * (i + rows) + to] for _, rows, to, c in repair._ARCS[letters[i], q])
    cost, audit = repair.cheapest_repair(letters)
    assert cost == price[0] and len(re.sub("I", "", audit)) == len(letters)


SCHEMA = "conv_id long, turn long, role string, text string, ROLE int, pos long, first string, audit string"


def awkward():
    r = random.Random(6)
    texts = ["Yes.", "no", "Why?", "", " \t", "Done!  \n", "ünï 中文。", "a.b", None, ":.", "x" * 3000 + "."]
    rows = [(c, t if r.random() < 0.9 else None, r.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]), r.choice(texts))
            for c in [*range(60), None] for t in range(r.randint(1, 9)) for _ in range(2 if r.random() < 0.1 else 1)]
    rows += [(-1, t, ("user", "assistant")[t % 2], f"turn {t % 700}.") for t in range(3000)] + [(-2, None, "user", "Hi."), (-3, 5, "user", "Hi."), (-3, 5, "user", "Hi.")]
    return rows


@pytest.mark.parametrize("run", [5, repair.RUN])
def test_report_of_awkward_conversations(spark, monkeypatch, run):
    monkeypatch.setattr(repair, "RUN", run)
    rows = awkward()
    df = spark.createDataFrame([(*x, 1, 2, "c", "d") for x in rows], SCHEMA).repartition(4)
    # rows of one turn with different texts are ordered by a hash of their text, which the plain version does not repeat
    several = {c for (c, t, role), n in Counter((c, t, r or " ") for c, t, r, _ in set(rows)).items() if n > 1}
    got, want = result(repair.repair_damaged(df)), plain_report(rows)
    assert set(got) == set(want)
    assert {c: x for c, x in got.items() if c not in several} == {c: x for c, x in want.items() if c not in several}
    assert len(want) - len(several) > 30
    ordered = repair.ordered(repair.damage(df))
    assert ordered.groupBy("conv_id", "pos").count().where("count > 1").isEmpty()


def test_repaired_turns_are_legal(spark):
    df = spark.createDataFrame([(*x, 1, 2, "c", "d") for x in awkward()], SCHEMA)
    rows = repair.ordered(repair.damage(df)).cache()
    found = repair.audits(repair.conversation_letters(repair.row_letters(rows)))
    roles = {}
    for r in sorted(repair.repaired_turns(rows, found).collect(), key=lambda r: r.position):
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[:1]
    assert roles and all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.repair_damaged(df).count() == 0
