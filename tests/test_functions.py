"""Hand-computed values of scalar functions and operators."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import fuzzy, nulls
from lodestrata.functions.analysis import TEXT, edge_ngrams, stem_word
from lodestrata.functions.vectors import cosine, is_valid, statistics
from lodestrata.operators import corpus, graph, memory, relational, retrieval
from lodestrata.operators.catalog import PythonNames, docstring_parts


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_is_right_on_random_texts():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcß") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == slow_lcs(a, b)


def test_ratios():
    assert round(fuzzy.ratio("kitten", "sitting"), 2) == 61.54
    assert fuzzy.ratio("", "") == 100 and fuzzy.ratio("a", "") == 0
    assert fuzzy.partial_ratio("ring", "a small ring here") == 100
    assert fuzzy.token_sort_ratio("b a", "a b") == 100


def test_ratio_column_keeps_nulls(spark):
    df = spark.createDataFrame([("ab", "ab"), (None, "x")], "a string, b string")
    assert [r.r for r in df.select(fuzzy.ratio_column("a", "b").alias("r")).collect()] == [100.0, None]


@pytest.mark.parametrize(
    "word, stem",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
     ("relational", "relat"), ("digitizer", "digit"), ("hopefulness", "hope"), ("formalize", "formal"), ("electrical", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("rate", "rate"), ("controlling", "control"), ("sky", "sky")],
)
def test_stems(word, stem):
    assert stem_word(word) == stem


def test_null_rules(spark):
    df = spark.createDataFrame([(None,), (0.0,), (2.0,)], "x double")
    rows = df.select(nulls.number(F.col("x")), nulls.truthy_or(F.col("x"), 0.5), nulls.at_most(F.col("x"), 0), nulls.below(F.col("x"), 0)).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.5, True, True), (0.0, 0.5, True, False), (2.0, 2.0, False, False)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(cosine(F.col("a"), F.col("b")).alias("c"), is_valid(F.col("a"), 2).alias("v")).collect()
    assert [r.c for r in rows] == [1.0, 0.0, None, None] and [r.v for r in rows] == [True, True, True, False]
    s = df.limit(1).select(statistics(F.col("a")).alias("s")).first().s
    assert (s.low, s.high, s.mean, s.std, s.norm) == (3.0, 4.0, 3.5, 0.5, 5.0)


def test_analyzer(spark):
    assert TEXT.query("The the Red-ring 2") == ["the", "red", "ring", "2"]
    df = spark.createDataFrame([("Red ring!",), (None,)], "t string")
    assert [r.x for r in df.select(TEXT.tokens(F.col("t")).alias("x")).collect()] == [["red", "ring"], []]
    assert df.limit(1).select(edge_ngrams(TEXT.tokens(F.col("t"))).alias("x")).first().x == ["red", "rin", "ring"]


def test_decay_by_domain(spark):
    facts = spark.createDataFrame(
        [("france", 0.7, 1, 730.0, ["geography"]), ("water", 0.6, 1, 365.0, ["physics"]), ("conference", 0.5, 1, 60.0, ["temporary"]), ("password", 0.3, 1, 15.0, ["temporary"])],
        "k string, importance double, access_count long, ttl_days double, domains array<string>",
    )
    kept = {r.k: r for r in memory.decay_by_domain(facts, F.lit(30), F.col("domains"), ["geography", "physics"], 0.8).collect()}
    assert round(kept["france"].new_ttl, 4) == 728.5 and round(kept["france"].protection, 4) == 1.41
    assert round(kept["water"].new_ttl, 4) == 363.5
    plain = {r.k: r for r in memory.decay_by_domain(facts, F.lit(30), F.col("domains"), [], 0.8).collect()}
    assert round(plain["france"].new_ttl, 4) == 718.3 and round(plain["water"].new_ttl, 4) == 350.9
    assert plain["conference"].new_ttl == 0 and plain["conference"].status == "expired" and round(plain["password"].reduction, 4) == 108.9


def test_default_ttl_and_contradiction(spark):
    df = spark.createDataFrame([(1, 0.5, 2, 0.6), (2, 0.5, 1, 0.9), (3, 0.5, 0, 0.1)], "fact_id long, importance double, n_alternatives long, confidence double")
    assert df.select(memory.default_ttl(F.col("importance"))).first()[0] == 45
    assert {r.fact_id: round(r.contradiction, 6) for r in memory.contradictions(df).collect()} == {1: 0.8, 2: 0.1}


def test_upsert_and_remember(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, n int")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 4)], "k int, name string, n int")
    assert {tuple(r) for r in memory.upsert(old, new, "k").collect()} == {(1, "a", 1, "keep"), (2, "c", 2, "update"), (3, "d", 4, "insert")}


def test_history_gets_latest_only_if_new(spark):
    df = spark.createDataFrame([([(date(2024, 1, 1), 0.5)],), ([(date(2024, 1, 2), 0.5)],), (None,)], "h array<struct<at:date,confidence:double>>")
    latest = F.struct(F.lit("2024-01-02").cast("date").alias("at"), F.lit(0.9).alias("confidence"))
    assert [r.n for r in df.select(F.size(memory.history_with_latest(F.col("h"), latest)).alias("n")).collect()] == [2, 1, 1]


def test_inverse_types(spark):
    df = spark.createDataFrame([(t,) for t in graph.TYPES], "t string").select("t", graph.inverse_type(F.col("t")).alias("i"))
    pairs = {r.t: r.i for r in df.collect()}
    assert all(pairs[pairs[t]] == t for t in pairs) and pairs["causes"] == "caused_by" and pairs["similar"] == "similar"


def test_paths_use_no_edge_twice(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0)], "src int, dst int, strength double")
    got = {(r.vertex, r.depth, tuple(r.path)) for r in graph.paths(e, spark.createDataFrame([(1,)], "k int"), 4).collect()}
    assert got == {(2, 1, (1, 2)), (1, 2, (1, 2, 1)), (3, 2, (1, 2, 3))}
    pairs = spark.createDataFrame([(1, 3), (3, 1), (1, 9)], "a int, b int")
    got = {(r.a, r.b, r.distance, tuple(r.vertices), tuple(map(tuple, r.edges)), r.strength) for r in graph.shortest_path(e, pairs, 5).collect()}
    assert got == {(1, 3, 2, (1, 2, 3), ((1, 2), (2, 3)), 1.0), (3, 1, 2, (3, 2, 1), ((3, 2), (2, 1)), 1.0), (1, 9, -1, (), (), None)}


def test_edges_are_pruned_and_deleted_with_inverses(spark):
    e = spark.createDataFrame([(1, 2, "causes", 0.9), (2, 1, "caused_by", 0.9), (1, 3, "related", None)], "src int, dst int, type string, strength double")
    assert graph.prune_edges(e, 0.5).count() == 2
    assert [tuple(r) for r in graph.delete_edges(e, e.filter("type = 'causes'")).collect()] == [(1, 3, "related", None)]


def test_failing_sets(spark):
    from lodestrata.plans.relational_queries import run_sets

    runs = spark.createDataFrame([("1", "a", 0), ("1", "b", 0), ("1", "c", 1), ("2", "a", 1), ("2", "b", 0), ("2", "c", 0)], "run_id string, test_name string, passed int")
    assert [tuple(r) for r in run_sets(runs).orderBy("run_id").collect()][1] == ("2", "a", "c", "b")


def test_sections_and_terms(spark):
    df = spark.createDataFrame([(1, "before\n# A\nx\n## B\ny\n# A\nz"), (2, "# Only"), (3, "")], "k int, t string")
    got = {(r.k, r.title): r.body for r in corpus.section_table(df, "k", "t").collect()}
    assert got == {(1, "Overview"): "before", (1, "A"): "z", (1, "B"): "y", (2, "Only"): ""}
    t = spark.createDataFrame([("Can you explain what [TERM: Embedding | Converting words to vectors] means?",)], "t string")
    assert [tuple(x) for x in t.select(corpus.embedded_terms(F.col("t")).alias("x")).first().x] == [("Embedding", "Converting words to vectors")]


def test_chunks_keep_all_sentences(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(30))
    rows = corpus.chunk(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t", 20).orderBy("nth").collect()
    assert {r.of for r in rows} == {len(rows)} and rows[0].chunk.startswith("[CHUNK 1/")
    assert all(any(f"number {i} ends" in r.chunk for r in rows) for i in range(30))


def test_phrase_fusion_and_relaxation(spark):
    df = spark.createDataFrame([(1, "in the red ring"), (2, "the redder ring"), (3, None)], "k int, t string")
    assert [r.k for r in df.filter(retrieval.contains_phrase(F.col("t"), "Red ring")).collect()] == [1]
    a = spark.createDataFrame([(1, 1.0), (2, 0.5)], "k int, score double")
    b = spark.createDataFrame([(2, 1.0)], "k int, score double")
    assert [(r.k, r.hybrid) for r in retrieval.fuse({"a": a, "b": b}, "k", {"a": 0.5, "b": 0.5}, 0.6, 5).collect()] == [(2, 0.75)]
    assert [r.level for r in retrieval.relax(a, [F.col("score") > 5, F.col("score") > 0.7]).collect()] == [2]


def test_ordered_distinct(spark):
    df = spark.createDataFrame([(["b", "A", "a", "B", "c"],)], "x array<string>")
    assert df.select(relational.distinct_ignoring_case(F.col("x")).alias("y")).first().y == ["b", "A", "c"]


def test_python_names_and_docstrings(spark):
    df = spark.createDataFrame([("import os\nlen(os.path.join('a'))",), ("def (",), (None,)], "c string")
    got = {(r.kind, r.name) for r in df.lateralJoin(PythonNames(F.col("c").outer())).collect()}
    assert got == {("import", "os"), ("call", "len"), ("call", "join")}
    d = spark.createDataFrame([("Does.\n\nArgs:\n    size (int): how big\n\nReturns:\n    the thing\n\nRaises:\n    ValueError: no",)], "d string")
    p = d.select(docstring_parts(F.col("d")).alias("p")).first().p
    assert p.parameters == ["size"] and p.raises == ["ValueError"] and p.returns == "the thing"


def test_annotation_takes_plurals_and_is_appended_otherwise(spark):
    df = spark.createDataFrame([("Red Rings cost $5",), ("springs",), ("a ring",)], "t string")
    got = [r.x for r in df.select(corpus.annotate(F.col("t"), "ring", "a $ band").alias("x")).collect()]
    assert got == ["Red [TERM: ring | a $ band] cost $5", "springs [TERM: ring | a $ band]", "a [TERM: ring | a $ band]"]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "".join(map(chr, range(0x4E00, 0x4E00 + 300)))])
def test_pairs_of_texts_equal_the_plain_ratio(alphabet):
    """Also of empty and very short texts, of lengths around a word's, and where characters share a code."""
    rng = random.Random(5)
    texts = ["", "a", "ab" * 31, "ab" * 32, "a" * 63, "b" * 64]
    for _ in range(40):
        own = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300)))
        changed = "".join(rng.choice(alphabet) if rng.random() < rng.choice((0.05, 0.2, 0.25)) else c for c in own)
        texts += [own, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) + changed[: rng.randint(1, 300)]]
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and (abs(i - j) < 3 or rng.random() < 0.1)]
    for least in (60.0, 80.0, 95.0):
        want = [fuzzy.partial_ratio(texts[i], texts[j]) >= least for i, j in pairs]
        assert fuzzy.partly_alike(texts, *np.array(pairs).T, least).tolist() == want and 0 < sum(want) < len(want)


def test_unlike_pairs_are_ruled_out_without_their_ratio(monkeypatch):
    """Of 300 pairs of long texts of one language, 3 alike, the ratio is computed for a few only."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ou", "to")) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(60, 150))) for _ in range(600)]
    for i in (0, 2, 4):
        texts[i + 1] = "Well, " + texts[i].replace("th", "ht", 5)
    asked, plain = [], fuzzy.partial_ratio
    monkeypatch.setattr(fuzzy, "partial_ratio", lambda a, b, least=0.0: asked.append(1) or plain(a, b, least))
    got = fuzzy.partly_alike(texts, np.arange(0, 600, 2), np.arange(1, 600, 2), 80.0)
    assert np.flatnonzero(got).tolist() == [0, 1, 2] and len(asked) < 15
