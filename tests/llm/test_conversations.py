"""Conversation repair against a search over (cost, audit) of all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import conversations as C
from lodestrata.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def solve(rows):
    """(cost, audit, lines) of turns in order: the cheapest, then least, way."""
    seen, faults = set(), []
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, state, inserted):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            (role, text), fault = rows[i], faults[i]
            late = fault == "truncated"
            c, a, lines = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                if role[:1] in NEXT[state] and role[:1]:
                    c, a, lines = best(i + 1, NEXT[state][role[:1]], 0)
                    ways.append((c + late, "K" + a, (f"{role}:{text}", *lines)))
                for to, name in (("u", "user"), ("a", "assistant")):
                    if to in NEXT[state]:
                        c, a, lines = best(i + 1, NEXT[state][to], 0)
                        ways.append((c + 2 + late, "R" + a, (f"{name}:{text}", *lines)))
        if inserted < 3:
            for to, name in (("u", "user"), ("a", "assistant")):
                if to in NEXT[state]:
                    c, a, lines = best(i, NEXT[state][to], inserted + 1)
                    ways.append((c + 2, "I" + a, (f"{name}:", *lines)))
        return min(ways) if ways else (10**9, "", ())

    return faults, best(0, "", 0)


def row_of(conv, rows):
    """rows: (turn, role, text) after damage."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, (cost, audit, lines) = solve([r[1:] for r in rows])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    """conv -> rows after the contract's damage."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1))
    return out


def expected(convs):
    return sorted((row_of(c, r) for c, r in convs.items()), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def random_rows(rng, n):
    texts = ["Yes.", "No", "Why?", "", " \n", "Go on!", None, "x. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "supervisor"]
    return [(rng.randrange(n // 4), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("bits", [0, 1, 12])
def test_reports_equal_brute_force(spark, bits):
    """Also with chunks of one turn or two, so that most conversations are cut."""
    rows = random_rows(random.Random(bits), 240)
    convs = {}
    for c, *r in rows:
        convs.setdefault(c, []).append(r)
    assert got(C.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk_bits=bits)) == expected(convs)


def test_query_equals_brute_force(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    made = damaged([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert got(queries.op13_conversation_repair(spark, small)) == expected(made)


def test_damage_of_nulls(spark):
    rows = random_rows(random.Random(3), 200) + [(None, t, r, x) for t, r, x in ((None, "user", "Hm?"), (1, None, None), (1, "assistant", "Hm."))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(C.repair_report(queries.damaged_turns(df), df.select("conv_id"))) == expected(damaged(rows))


def test_edits_tell_the_report(spark):
    """The edits of each conversation, read in order, are its audit and its repaired lines."""
    rows = random_rows(random.Random(11), 160)
    df = spark.createDataFrame(rows, SCHEMA)
    report = {r.conv_id: r for r in C.repair_report(df).collect()}
    edits = {}
    for r in sorted(C.repair(df, chunk_bits=1).collect(), key=lambda r: (r.conv_id, r.nth)):
        edits.setdefault(r.conv_id, []).append(r)
    for conv, r in report.items():
        own = edits.get(conv, [])
        assert "".join(e.edit for e in own) == r.audit and [e.nth for e in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{e.role}:{e.text}" for e in own if e.edit != "D").encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(e.role[0] for e in own if e.edit != "D"))


def test_one_long_conversation(spark):
    """A third of all rows, in many chunks; and one of equal rows only."""
    rng = random.Random(5)
    long = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{i}?", f"{i}"])) for i in range(300)]
    rows = long + [(2, 7, "user", "same.")] * 300 + [(3 + i % 100, i, "user", "Hm.") for i in range(300)]
    convs = {}
    for c, *r in rows:
        convs.setdefault(c, []).append(r)
    assert got(C.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(4), chunk_bits=4)) == expected(convs)


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair_report(none).count() == 0 and C.repair(none).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")], SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "pos", "kind", "chunk", "letters", "a.b")})
    assert [r.audit for r in C.repair_report(df).collect()] == ["KK"]
    every = spark.createDataFrame([(1,), (2,), (None,)], "conv_id long")
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(C.repair_report(df, every))[1:] == [(2, *empty), (None, *empty)]
