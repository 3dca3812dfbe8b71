"""Corpus operators and text search against brute force and hand-made values."""

import random
import re
import time

import pytest

from pyspark.sql import functions as F

from lodestrata.functions import fuzzy as Z
from lodestrata.functions.analysis import TEXT
from lodestrata.functions.vectors import cosine, embed, with_prefix
from lodestrata.operators import catalog as K
from lodestrata.operators import corpus as C
from lodestrata.plans import service_queries as S


def plain_partial_ratio(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return max(Z.ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def test_partial_ratio_equals_all_windows():
    rng = random.Random(2)
    for _ in range(800):
        letters = "abcdef"[: rng.choice((2, 4, 6))]
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        if rng.random() < 0.3:
            b = b[:5] + "".join(c for c in a if rng.random() < 0.8) + b[5:]
        want = plain_partial_ratio(a, b)
        assert Z.partial_ratio(a, b) == pytest.approx(want)
        assert Z.partial_ratio(a, b, 80.0) == (pytest.approx(want) if want >= 80 else 0)


def made_up_pairs(seed):
    """Questions and answers of which some repeat others with words changed, cut or put around."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(60):
        q, a = [word() for _ in range(rng.randint(1, 14))], [word() for _ in range(rng.randint(1, 40))]
        rows.append([q, a])
        if i % 2:
            old = rng.choice(rows)
            side = rng.choice((0, 1))
            text = [word() if rng.random() < 0.08 else w for w in old[side]]
            rows[-1][side] = rng.choice((text, [word()] + text, text[: max(1, len(text) - 1)], text + [word(), word()]))
    return [(i, " ".join(q).capitalize() + "?", " ".join(a) + ".") for i, (q, a) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_pairs_equal_brute_force(spark, seed):
    rows = made_up_pairs(seed) + [(60, None, ""), (61, "", None), (62, "?!", "!!")]
    kept, text = [], lambda x: x or ""
    for i, q, a in rows:
        if not any(Z.partial_ratio(text(q), text(p)) >= 80 or Z.partial_ratio(text(a), text(b)) >= 80 for _, p, b in kept):
            kept.append((i, q, a))
    df = spark.createDataFrame(rows, "k long, q string, a string")
    links = C.partly_alike(df, "k", "q").unionByName(C.partly_alike(df, "k", "a"))
    got = {r.k for r in C.first_of_alike(df.select("k"), links, "k").collect()}
    want = {i for i, _, _ in kept}
    assert len(want) < 55 and len(got ^ want) <= 2 and len(got & want) >= 0.95 * len(want)
    assert {r.k for r in C.first_of_classes(df, "k", ["q", "a"]).collect()} == got


def test_candidates_find_nine_of_ten_links(spark):
    """Of all pairs of texts with a partial ratio of 80 or more, measured on made-up questions."""
    rows = [(i, q) for i, q, _ in made_up_pairs(9)]
    every = {(i, j) for i, x in rows for j, y in rows if i < j and Z.partial_ratio(x, y) >= 80}
    got = {(r.a, r.b) for r in C.partly_alike(spark.createDataFrame(rows, "k long, q string"), "k", "q").collect()}
    assert got <= every and len(got) >= 0.9 * len(every) > 10


def test_alike_texts_without_a_common_word_are_linked(spark):
    """One letter of each word is another, so that no word and no pair of words is the same."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(12)]
    rows = [(0, " ".join(words)), (1, " ".join(w[:4] + "z" + w[5:] for w in words)), (2, " ".join("xyz" + w[::-1] for w in words))]
    assert Z.partial_ratio(rows[0][1], rows[1][1]) >= 80 > Z.partial_ratio(rows[0][1], rows[2][1])
    got = C.partly_alike(spark.createDataFrame(rows, "k long, q string"), "k", "q").collect()
    assert [(r.a, r.b) for r in got] == [(0, 1)]


@pytest.mark.parametrize(("block", "shuffled"), [(1 << 22, 1 << 28), (700, 1), (100, 1)])
def test_all_alike_pairs_are_linked_once_in_any_blocks_and_rounds(spark, monkeypatch, block, shuffled):
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    monkeypatch.setattr(C, "ROUND_BYTES", shuffled)
    rows = [(i, q) for i, q, _ in made_up_pairs(7)][:40] + [(40, ""), (41, "?")]
    every = [(i, j) for i, x in rows for j, y in rows if i < j and Z.partial_ratio(x, y) >= 80]
    got = C.partly_alike(spark.createDataFrame(rows, "k long, q string"), "k", "q").collect()
    assert sorted((r.a, r.b) for r in got) == every and len(every) > 5


def test_a_round_shuffles_a_bounded_number_of_copies_of_the_texts(spark, monkeypatch):
    """Each distance of blocks in the ring copies a text twice, a round has ROUND_COPIES / 2 of them."""
    met, real = [], C._met
    monkeypatch.setattr(C, "_met", lambda t, blocks, first, end, least: met.append((blocks, first, end)) or real(t, blocks, first, end, least))
    monkeypatch.setattr(C, "BLOCK_BYTES", 100)
    monkeypatch.setattr(C, "ROUND_BYTES", 1)
    C.partly_alike(spark.createDataFrame([(i, f"{i} " * 15) for i in range(40)], "k long, q string"), "k", "q", 99.0)
    blocks = met[0][0]
    assert blocks > 8 and all(end - first <= C.ROUND_COPIES // 2 for _, first, end in met)
    assert [d for _, first, end in met for d in range(first, end)] == list(range(blocks // 2 + 1))


def test_equal_answers_are_compared_once(spark):
    """10,000 rows of one answer cost a row each, not a pair of rows each: one row stays of them."""
    rows = [(i, f"question number {i} of many others here", "always the same answer to them all") for i in range(10_000)] + [(10_000, "quite another thing", "with its own answer"), (10_001, None, None)]
    df = spark.createDataFrame(rows, "k long, q string, a string").repartition(4)
    links = C.partly_alike(C.text_classes(df, "k", "a").filter("k = first"), "k", "t")
    assert links.count() == 0
    assert sorted(r.k for r in C.first_of_classes(df.select("k", "a"), "k", ["a"]).collect()) == [0, 10_000, 10_001]


def test_the_first_of_linked_rows_stay(spark):
    """1-2-3-4 in a chain: 2 goes for 1, so 3 stays and 4 goes."""
    keys = spark.range(1, 7).select("id")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "a long, b long")
    assert sorted(r.id for r in C.first_of_alike(keys, links, "id").collect()) == [1, 3, 5]
    assert C.first_of_alike(keys, links.limit(0), "id").count() == 6


def test_all_definitions_with_nested_ones(spark):
    code = "import x\n\nclass A(B):\n    def f(self):\n        return 1\n\n    async def g(self):\n        pass\n\ndef h():\n    return 2\ny = 3"
    found = spark.createDataFrame([(code,), ("",), (None,)], "c string").select(F.explode(C.definitions(F.col("c"))).alias("d")).select("d.*").collect()
    got = {r.name: (r.kind, r.line, r.source) for r in found}
    assert set(got) == {"A", "f", "g", "h"} and got["h"] == ("def", 10, "def h():\n    return 2")
    assert got["f"][2].strip() == "def f(self):\n        return 1" and got["A"][2].startswith("class A(B):") and got["A"][2].rstrip().endswith("pass")


def _sources_by_brute_force(code):
    lines, out = code.split("\n"), []
    depth = lambda x: len(x) - len(x.lstrip(" "))
    for i, x in enumerate(lines):
        m = re.match(r"[ \t]*(?:async +)?(def|class) +([A-Za-z_][A-Za-z0-9_]*)", x)
        if m:
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip(" ") and depth(lines[j]) <= depth(x)), len(lines))
            out.append((m[2], m[1], i + 1, "\n".join(lines[i:end])))
    return out


def test_definitions_of_random_code_and_of_many_lines(spark):
    rng = random.Random(5)
    line = lambda: rng.choice(["", "   ", *[" " * rng.randrange(5) + rng.choice(["x = 1", "def f():", "class A:", "async def g(a):", "define"]) for _ in range(4)]])
    codes = ["\n".join(line() for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(codes)), "k long, c string")
    got = {r.k: [tuple(x) for x in r.d] for r in df.select("k", C.definitions(F.col("c")).alias("d")).collect()}
    assert got == {k: _sources_by_brute_force(c) for k, c in enumerate(codes)}
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda i: F.concat(F.lit("def f"), i.cast("string"), F.lit("():\n    pass"))), "\n").alias("c"))
    begin = time.monotonic()
    assert long.select(F.size(C.definitions(F.col("c"))).alias("n"), F.element_at(C.definitions(F.col("c")), -1)["source"].alias("s")).first()[:] == (50_000, "def f49999():\n    pass")
    assert time.monotonic() - begin < 30


CODE = '''class A:
    async def f(self, x: int, /, y=[1, (2,)], *, z, **more) -> "dict[str, int]":
        """Gets all. More.

        Args:
            x (int): the first
            more: and others

        Raises:
            ValueError: if bad

        >>> f(1)
        >>> f(2)
        """
        def inner():
            raise KeyError
        raise TypeError("no") from None

def g(): pass
'''


def test_methods_of_code_are_analysed(spark):
    df = spark.createDataFrame([(1, CODE), (2, "def broken("), (3, None), (4, "")], "k long, c string")
    methods = K.methods_of(df, "c").drop("c")
    got = {r.name: r for r in K.analysed(methods).collect()}
    assert set(got) == {"A.f", "A.f.inner", "g"} and all(r.k == 1 for r in got.values())
    f = got["A.f"]
    assert f.is_async and f.line == 2 and f.signature == "(self, x: int, /, y=[1, (2,)], *, z, **more)" and f.returns == "'dict[str, int]'" and f.summary == "Gets all."
    assert [tuple(p) for p in f.parameters] == [("x", "int", None, True, "the first"), ("y", None, "[1, (2,)]", False, None), ("z", None, None, True, None), ("more", None, None, False, "and others")]
    assert [tuple(e) for e in f.errors] == [("TypeError", None), ("ValueError", "if bad")]
    assert f.examples == ["f(1)", "f(2)"] and "read" in f.categories and "error_handling" in f.categories
    assert [e.type for e in got["A.f.inner"].errors] == ["KeyError"] and got["g"].summary == "." and not got["g"].parameters
    asked = spark.createDataFrame([("A.f",), ("A.f",), ("A.none",), (None,)], "n string")
    assert sorted((str(r.name), r.found) for r in K.deep_lookup(asked, "n", methods).collect()) == [("A.f", True), ("A.none", False), ("None", False)]
    assert [r.name for r in K.relevant_methods(methods, "GETS", ["k"]).collect()] == ["A.f"]


def test_languages_by_name_and_first_line(spark):
    rows = [("a/x.TSX", "", "tsx"), ("x.sh", "", "bash"), ("run", "#!/usr/bin/env python -u", "python"), ("run", "#!/bin/pythonic", "unknown"), ("GNUMakefile", "", "makefile"), ("a.b/Dockerfile.dev", "", "dockerfile"), (".vue", "", "unknown"), ("x.c++", "", "cpp")]
    df = spark.createDataFrame(rows, "p string, f string, want string")
    assert df.filter(C.language_of(F.col("p"), F.col("f")) != F.col("want")).count() == 0
    assert [r.b for r in spark.createDataFrame([("a\tb\n",), ("a\x00b",), ("é中",)], "c string").select(C.is_binary(F.col("c")).alias("b")).collect()] == [False, True, False]


def test_tokens_of_other_alphabets(spark):
    df = spark.createDataFrame([("Größe, año_2 ÉTÉ中文",)], "t string")
    assert df.select(TEXT.tokens(F.col("t")).alias("t")).first().t == ["größe", "año", "2", "été中文"] == TEXT.query("Größe, año_2 ÉTÉ中文")


def test_embedding_is_a_unit_vector_and_any_model_fits(spark):
    df = spark.createDataFrame([("blue bolt",), ("Bolt, blue!",), ("red ring",), ("",), (None,)], "t string")
    rows = df.select(embed(F.col("t")).alias("v"), cosine(embed(F.col("t")), embed(F.lit("search_query: blue bolt"))).alias("c")).collect()
    assert [len(r.v) for r in rows] == [64] * 5 and sum(x * x for x in rows[0].v) == pytest.approx(1)
    assert [r.c for r in rows[:2]] == [pytest.approx(1)] * 2 and rows[2].c < 0.9 and rows[3].c is None
    assert df.select(embed(F.col("t"), lambda x: F.array(F.length(x))).alias("v")).first().v == [len("search_document: blue bolt")]
    assert df.select(with_prefix(F.lit("search_query: x")).alias("v")).first().v == "search_query: x"


def test_unified_search_takes_the_first_kind(spark, small):
    rows = {r.term: r.match_type for r in S.QUERIES["r26_unified_search"](spark, small).collect()}
    assert rows["blue bolt"] == "embedded_exact" and set(rows.values()) <= {"embedded_exact", "fuzzy", "semantic", "semantic_exact", "related"}
    ratio = lambda t: Z.token_sort_ratio(S.ASKED, t)
    assert all(ratio(t) >= 30 for t, kind in rows.items() if kind == "fuzzy")


def test_completed_answers(spark):
    code = "def f(x):\n    return x + 1"
    rows = [("How does f work?", "It adds one to the number.", True), ("How does f work?", f"Like so: {code}", False), ("What is this?", "It adds one to the number.", False)]
    df = spark.createDataFrame([(q, a, "f(", w) for q, a, w in rows], "q string, a string, name string, want boolean").withColumns({"code": F.lit(code), "name": F.lit("f work")})
    out = C.complete_answers(df, "q", "a", "name", "code").collect()
    assert all((r.completed != r.a) == r.want and r.completed.startswith(r.a) for r in out) and code in out[0].completed


def test_templates_without_answers_are_left_out(spark):
    kind = "array<struct<name:string,description:string>>"
    rows = [("f", None, "Does.", [("a", "one"), ("b", None), ("c", "")], None, ["f(1)", "f(2)"], [("E", "bad")], "def f"), ("g", "(x)", "", [], "", [], None, None), (None, "()", "x", [], "y", [], [], "z"), ("", "()", "x", [], "y", [], [], "z")]
    df = spark.createDataFrame(rows, f"n string, s string, d string, p {kind}, r string, e array<string>, x array<struct<type:string,description:string>>, c string")
    got = [[(p.question, p.answer) for p in r.q] for r in df.select(C.function_pairs(*[df[c] for c in "nsdprexc"]).alias("q")).collect()]
    assert got == [
        [("What does the function `f()` do?", "Does."), ("What are the parameters of `f`?", "- `a`: one"), ("How do I use `f`? Show me an example.", "f(1)\nf(2)"), ("What errors can `f` raise?", "- `E`: bad"), ("Show me the implementation of `f`.", "def f")],
        [], [], [],
    ]
    assert [[(p.question, p.answer) for p in r.q] for r in df.select(C.class_pairs(df.n, df.d, df.c).alias("q")).collect()][0] == [("What is the purpose of the `f` class?", "Does."), ("Show me the implementation of the `f` class.", "def f")]


def test_code_of_one_file_is_parsed_by_all_cores(spark):
    code = spark.createDataFrame([(i, f'def f{i}():\n    """Rings {i}."""\n') for i in range(40)], "id long, code string").repartition(1)
    methods = K.methods_of(code, "code")
    assert methods.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    first = K.relevant_methods(methods, "ring", ["id"])
    assert sorted(r.name for r in first.collect()) == ["f0", "f1", "f10"]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "PythonUDTF" not in plan


def test_fuzzy_scores_of_one_file_are_spread(spark, small):
    from lodestrata.plans.catalogue import QUERIES

    plan = QUERIES["r30_query_analysis"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
