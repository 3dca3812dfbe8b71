"""Term spotting by automaton against brute force."""

import random

from lodestrata.functions.spotting import longest_by_root, occurrences, spot_terms

WORDS = "a the steel red über ring small blue".split()


def brute_force(texts, terms):
    out = []
    for i, t in texts:
        line = f" {' '.join((t or '').lower().split())} "
        for term in {" ".join((x or "").lower().split()) for x in terms} - {""}:
            n = sum(line.startswith(f" {term} ", at) for at in range(len(line)))
            if n:
                out.append((i, term, n))
    return sorted(out, key=repr)


def test_terms_equal_brute_force_in_any_shards(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(20)))) for i in range(60)] + [(None, "RED Ring"), (60, None), (61, ""), (61, "ring ring ring ring")]
    terms = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 4))) for _ in range(50)] + ["ring ring", "Red  RING", "", None, "absent"]
    a, b = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(t,) for t in terms], "term string")
    for shard in (10_000, 7):
        found = spot_terms(a, ["id"], "t", b, "term", shard=shard)
        assert sorted(((r.id, r.term, r.times) for r in found.collect()), key=repr) == brute_force(texts, terms)
    roots = longest_by_root(spot_terms(a.filter("id IS NULL"), ["id"], "t", b, "term"), ["id"]).collect()
    assert {(r.root, r.longest) for r in roots} >= {("red", "red ring")}
    assert spot_terms(a, ["id"], "t", b.limit(0), "term").count() == 0 and spot_terms(a.limit(0), ["id"], "t", b, "term").count() == 0


def test_a_long_text_takes_one_pass():
    line = "ring " * 200_000
    assert occurrences(line.strip(), tuple(" ".join(["ring"] * n) for n in (1, 2, 3))) == {"ring": 200_000, "ring ring": 199_999, "ring ring ring": 199_998}
