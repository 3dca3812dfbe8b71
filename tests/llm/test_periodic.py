"""Periodic runs against a search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import periodic, queries
from lodestrata.llm.periodic import collapse_runs, find_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(w, exponent=4, least=6):
    """(start, length, period) of all runs."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and not any(w[i : i + length - d] == w[i + d : i + length] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def digest(doc_id, text):
    """The contract's row."""
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_force(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))


def stitched(w, span, exponent=4, least=6):
    """Tiles, fragments and their union, on one machine."""
    words, n, found = np.array(w, "<i4"), len(w), set()
    cut = list(periodic.tiles(n, exponent, span))
    for k in periodic.octaves(n, exponent):
        own = [t for t in cut if t[0] <= k <= t[1]]
        every = np.concatenate([words[t[2] : t[3]] for t in own])
        found |= {(q, a, z) for _, q, a, z in periodic.fragments(every, [t[3] - t[2] for t in own], [(t[2], t[4], t[5], n) for t in own], k, exponent)}
    whole = []
    for q, a, z in sorted(found):
        if whole and whole[-1][0] == q and a <= whole[-1][2]:
            whole[-1][2] = max(whole[-1][2], z)
        else:
            whole.append([q, a, z])
    return sorted(((a, z - a + q, q) for q, a, z in whole if z - a + q >= max(least, exponent * q)), key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, w = rng.randrange(1, 200), []
    while len(w) < n:
        w += [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(1, 14))] * rng.randrange(1, 9) + [rng.randrange(6) for _ in range(rng.randrange(3))]
    return w * 2 if rng.random() < 0.3 else w


@pytest.mark.parametrize("span", [4, 16, 8192])
def test_tiles_of_any_size_give_all_runs(span):
    rng = random.Random(span)
    for _ in range(300):
        w = random_words(rng)
        assert stitched(w, span) == brute_force(w), w


def test_a_useless_hash_costs_time_only(monkeypatch):
    monkeypatch.setattr(periodic, "WORD", 0)  # all blocks look alike
    rng = random.Random(7)
    for _ in range(40):
        w = random_words(rng)
        assert stitched(w, 16) == brute_force(w), w


def test_a_text_of_one_word_takes_linear_work():
    assert stitched([0] * 100_000, 8192) == [(0, 100_000, 1)]


def test_query_equals_brute_force(spark, small, texts):
    rows = queries.op12_periodic_runs(spark, small).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(digest(i, t) for i, t in texts.items())
    assert sum(r.n_runs for r in rows) > 10


def test_damage_of_odd_rows(odd_docs):
    rows = {(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()}
    made = {r.doc_id: r.text for r in queries.with_planted_runs(odd_docs.filter("doc_id IS NULL OR doc_id NOT IN (1, 2, 11)")).collect()}
    for i, t in rows:
        if i in made and i is not None and zlib.crc32(str(i).encode()) % 10 == 0 and (t or "").split():
            assert len(made[i].split()) == len(WORD.findall(t))
    assert None in made


@pytest.mark.parametrize("long", [1 << 20, 100])
def test_odd_rows(odd_docs, no_docs, long):
    """Also with the tiles of all but short texts dealt to tasks."""
    more = odd_docs.withColumn("text", F.when(F.col("doc_id") == 8, F.concat(F.repeat(F.lit("a b c "), 4000), F.lit("d "), F.repeat(F.lit("x\n"), 7))).otherwise(F.col("text")))
    rows = sorted(((r.doc_id, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in collapse_runs(more, span=64, long=long).collect()), key=repr)
    want = []
    for r in more.select("doc_id", "text").collect():
        w = WORD.findall(r.text or "")
        runs = brute_force(w) if len(w) < 1000 else [(0, 12_000, 3), (12_001, 7, 1)] if r.doc_id == 8 else []
        want.append((r.doc_id, runs, collapsed(w, runs)))
    assert rows == sorted(want, key=repr)
    assert collapse_runs(no_docs).count() == 0 and find_runs(no_docs).count() == 0


def test_other_bounds(spark):
    df = spark.createDataFrame([(1, "a a a a a b c b c b c b c b c"), (1, "a a a a a b c b c b c b c b c")], "doc_id long, text string")
    runs = lambda **kw: sorted((r.start, r.length, r.period) for r in find_runs(df, **kw).collect())
    assert runs() == [(5, 10, 2)] and runs(least=5) == [(0, 5, 1), (5, 10, 2)] and runs(exponent=5, least=1) == [(0, 5, 1), (5, 10, 2)] and runs(exponent=6) == []
    with pytest.raises(ValueError):
        find_runs(df, exponent=3)
