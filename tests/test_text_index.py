"""The stored index against the scan: scores, phrases, segments, blocks."""

import random
import re
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import text_index
from lodestrata.operators.retrieval import bm25
from lodestrata.operators.text_index import build_index, merge, refresh, vacuum
from lodestrata.sources.kept import folders, read_manifest, table_state
from lodestrata.sources.scratch import clear_scratch, made_once, scratch_root

ROWS = [(1, "red steel ring", "a ring, a RING"), (2, "", None), (3, None, "steel"), (4, "ring", "über ring über"), (5, "word " * 5000, "the end")]
SCHEMA = "id long, title string, body string"
FIELDS = {"title": 1.5, "body": 1.0}


def scanned(df, query, fields=FIELDS):
    return sorted((r.id, round(r.bm25, 9)) for r in bm25(df, fields, query).filter("bm25 > 0").collect())


def indexed(index, query, fields=FIELDS):
    return sorted((r.id, round(r.bm25, 9)) for r in index.search(fields, query).collect())


def root_of(spark):
    return f"{scratch_root(spark)}/test-{uuid.uuid4().hex}"


@pytest.mark.parametrize("query", [["ring"], ["steel", "ring", "über"], ["absent"], ["word", "end"]])
def test_index_scores_as_the_scan_does(spark, query):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert indexed(build_index(df, "id", list(FIELDS)), query) == scanned(df, query)


def test_empty_table_has_an_empty_index(spark):
    df = spark.createDataFrame([], "id long, title string")
    index = build_index(df, "id", ["title"])
    assert index.search({"title": 1.0}, ["ring"]).collect() == [] and index.top({"title": 1.0}, ["ring"], 3).collect() == [] and index.phrases("title", ["a ring"]).collect() == []


def test_index_is_read_by_terms(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    index = build_index(df, "id", ["title", "body"])
    for out in (index.search({"title": 1.0}, ["ring"]), index.search_from({"title": 1.0}, ["ring"], 0.1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "In(term, [ring])" in plan or "EqualTo(term,ring)" in plan
    assert re.search(r"\(block#\d+L = 0\)", out._jdf.queryExecution().optimizedPlan().toString()) and "positions" not in plan


def test_made_once_follows_the_files(spark, tmp_path):
    at = f"file://{tmp_path}/t.parquet"
    spark.range(3).write.parquet(at)
    made = []
    make = lambda: made.append(1) or len(made)
    assert [made_once(spark, at, "x", make) for _ in range(2)] == [1, 1]
    spark.range(300).write.mode("overwrite").parquet(at)
    assert made_once(spark, at, "x", make) == 2
    clear_scratch(spark)
    assert made_once(spark, at, "x", make) == 3


def some_texts(rng, n):
    words = "the of a ring steel red blue bolt über end word".split()
    return [(i, *[" ".join(rng.choices(words, k=rng.randrange(12))) if rng.random() < 0.9 else None for _ in "ab"]) for i in range(n)]


def count_phrase(text, phrase):
    w, p = (text or "").lower().split(), phrase.split()
    return sum(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1))


def test_phrases_equal_brute_force(spark):
    rows = some_texts(random.Random(1), 150) + [(999, "ring ring ring " * 300, None)]
    index = build_index(spark.createDataFrame(rows, SCHEMA), "id", ["title", "body"])
    phrases = ["of the", "ring", "ring ring", "the of a", "a ring a ring", "absent", "steel absent", "", "the the"]
    df = spark.createDataFrame(list(enumerate(phrases)), "p long, words string")
    got = sorted((r.p, r.id, r.hits) for r in index.match_phrases(df, "p", "words", "title").collect())
    assert got == sorted((p, i, n) for p, words in enumerate(phrases) for i, t, _ in rows if words and (n := count_phrase(t, words)))
    # One token is scored as a term; any of some phrases adds up.
    one = sorted((r.id, round(r.bm25, 9)) for r in index.phrases("title", ["ring"]).collect())
    assert one == indexed(index, ["ring"], {"title": 1.0})
    assert {r.id for r in index.phrases("title", ["of the", "a ring"]).collect()} == {i for i, t, _ in rows if count_phrase(t, "of the") or count_phrase(t, "a ring")}


@pytest.mark.parametrize("named", [2000, 1])
def test_phrases_shuffle_only_postings_of_their_tokens(spark, monkeypatch, named):
    """Every scan of the index is filtered by the phrases' tokens before a shuffle."""
    monkeypatch.setattr(text_index, "NAMED", named)
    index, plans, real = build_index(spark.createDataFrame(ROWS, SCHEMA), "id", list(FIELDS)), {}, text_index.stored
    monkeypatch.setattr(text_index, "stored", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or real(df, name))
    phrases = spark.createDataFrame([(1, "a ring"), (2, "the end"), (3, "ring"), (4, "absent")], "p long, words string")
    got = sorted((r.p, r.id, r.hits) for r in index.match_phrases(phrases, "p", "words", "body").collect())
    assert got == [(1, 1, 2), (2, 5, 1), (3, 1, 2), (3, 4, 1)]
    scans = [x for x in plans["phrase-hits"].split("\n") if "FileScan" in x and "positions" in x]
    if named > 1:
        assert scans and all("In(term" in x for x in scans)
    assert "SortMergeJoin [term" not in plans["phrase-hits"]


def test_segments_follow_the_rows(spark, monkeypatch):
    """New, changed and deleted rows, each against the scan; only changed rows are in the new segment."""
    rng, root = random.Random(2), root_of(spark)
    rows = {r[0]: r for r in some_texts(rng, 200)}
    frame = lambda: spark.createDataFrame(list(rows.values()), SCHEMA)
    index = refresh(frame(), root, "id", list(FIELDS), state="1")
    for step in range(3):
        changed = rng.sample(sorted(rows), 6)
        for i in changed[:2]:
            del rows[i]
        for i in changed[2:]:
            rows[i] = (i, "ring of the ring", f"new {step}")
        rows[1000 + step] = (1000 + step, "blue ring", "a new one")
        index = refresh(frame(), root, "id", list(FIELDS), state=str(step + 2))
        for query in (["ring", "of"], ["new", "blue"]):
            assert indexed(index, query) == scanned(frame(), query)
        last = index.postings.filter(F.col("segment") == step + 2).select("key").distinct().count()
        assert last <= 5 and len(read_manifest(spark, root)["segments"]) == step + 2
        hits = {r.id for r in index.phrases("title", ["of the ring"]).collect()}
        assert hits == {i for i, t, _ in rows.values() if count_phrase(t, "of the ring")}
    assert sorted(r.id for r in index.top(FIELDS, ["ring"], 5).collect()) == sorted(i for i, _ in sorted(scanned(frame(), ["ring"]), key=lambda x: (-x[1], x[0]))[:5])
    whole = merge(index, root)
    assert indexed(whole, ["ring", "of"]) == scanned(frame(), ["ring", "of"]) and whole.dead is None and len(read_manifest(spark, root)["segments"]) == 1
    before = set(folders(spark, root))
    assert len(vacuum(spark, root)) == len(before) - 2 and indexed(whole, ["new"]) == scanned(frame(), ["new"])
    monkeypatch.setattr(text_index, "MOST", 1)  # merged by itself
    rows[5000] = (5000, "ring", "late")
    assert indexed(refresh(frame(), root, "id", list(FIELDS), state="9"), ["late", "ring"]) == scanned(frame(), ["late", "ring"])
    assert len(read_manifest(spark, root)["segments"]) == 1


def test_a_second_session_builds_nothing(spark, tmp_path):
    root, at = root_of(spark), f"file://{tmp_path}/t.parquet"
    spark.createDataFrame(some_texts(random.Random(3), 50), SCHEMA).write.parquet(at)
    df = spark.read.parquet(at)
    first = refresh(df, root, "id", list(FIELDS), state=table_state(spark, at))
    before, version = set(folders(spark, root)), read_manifest(spark, root)["version"]
    # A frame that cannot be read shows that it is not.
    unread = df.withColumn("title", F.raise_error(F.lit("read")).cast("string"))
    second = refresh(unread, root, "id", list(FIELDS), state=table_state(spark, at))
    assert indexed(second, ["ring"]) == indexed(first, ["ring"]) and set(folders(spark, root)) == before
    # Files written again with the same rows: compared, but nothing is built.
    df.coalesce(1).write.parquet(f"file://{tmp_path}/u.parquet")
    third = refresh(df, root, "id", list(FIELDS), state=table_state(spark, f"file://{tmp_path}/u.parquet"))
    assert set(folders(spark, root)) == before and read_manifest(spark, root)["version"] == version + 1 and indexed(third, ["ring"]) == indexed(first, ["ring"])


def test_blocks_that_cannot_win_are_not_read(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["rare"] * (1 + i // 65 if i % 197 == 0 else 0) + ["word"] * rng.randrange(200, 220)), None) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    index, fields = build_index(df, "id", ["title"]), {"title": 1.0}
    every = sorted(((round(-r.bm25, 9), r.id) for r in index.search(fields, ["rare", "word"]).collect()))
    reads = {}
    for k in (1, 10, 1000):
        assert [(round(-r.bm25, 9), r.id) for r in index.top(fields, ["rare", "word"], k).collect()] == every[:k]
        reads[k] = index.reads(fields, ["rare", "word"], k).first()
    assert reads[1]["read"] < reads[10]["read"] < reads[1000]["read"] <= reads[1]["postings"] and reads[1]["kept"] < reads[1]["blocks"] == 62
    least = -every[20][0]
    assert sorted(r.id for r in index.search_from(fields, ["rare", "word"], least - 1e-7).collect()) == sorted(i for s, i in every if -s >= least - 1e-7)


def test_texts_are_dealt_in_bounded_parts(spark, monkeypatch):
    """More tasks for more texts, and in Python a bounded part of them at a time."""
    monkeypatch.setattr(text_index, "TASK", 2000)
    monkeypatch.setattr(text_index, "HELD", 500)
    rng = random.Random(5)
    words = ["ring", "steel", "über", "the", *[f"w{i}" for i in range(40)]]
    said = lambda most: " ".join(rng.choices(words, k=rng.randint(0, most)))
    rows = [(i, said(5), "" if i % 50 == 0 else "the " + said(30)) for i in range(600)] + [(600, "_", "the ring " * 900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(1)
    index = build_index(df, "id", list(FIELDS))
    assert indexed(index, ["ring", "the", "w7"]) == scanned(df, ["ring", "the", "w7"])
    assert len(index.postings.inputFiles()) > 5
    got = index.summary.groupBy("field", "term").agg(F.sum("n").alias("n"))
    want = index.postings.filter("term <> ''").groupBy("field", "term").agg(F.count(F.lit(1)).alias("n"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    held = [len(x) for x in text_index._pieces(pa.RecordBatch.from_pydict({"t0": ["x" * 200] * 30}), 1)]
    assert sum(held) == 30 and max(held) <= 3


def test_lines_are_the_tokens(spark):
    texts = ["", None, " ", "a_b-c", "İSTANBUL ΣΑΣ Straße", "x²½ Ⅷ 日本語１２", "\t\n..a.. b c", "no", "été"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for analyzer in (text_index.TEXT, text_index.Analyzer(("no", "a"))):
        assert df.filter(F.array_join(analyzer.tokens(F.col("t")), " ") != analyzer.line(F.col("t"))).isEmpty()


def test_postings_come_sorted_and_with_their_summary(spark, tmp_path):
    """Without a sort of Spark's; each file is in stored order, and the first posting of a term in a block has
    the block's summary, by the means of the whole table. So also after a merge."""
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 7)), None if i % 5 else "w1 w1 rare") for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t string, u string").repartition(3)
    made = text_index._postings(df, "k", ["t", "u"], text_index.TEXT, 4)
    assert "Sort" not in made._jdf.queryExecution().executedPlan().toString()
    index = refresh(df, f"file://{tmp_path}/index", "k", ["t", "u"])
    for now in (index, merge(index, f"file://{tmp_path}/index")):
        assert now.means == pytest.approx({"t": sum(i % 7 for i in range(300)) / 300, "u": 0.6})
        postings = [r for r in now.postings.collect() if r.term]
        part = lambda r: r.tf * 2.2 / (r.tf + 1.2 * (0.25 + 0.75 * r.length / now.means[r.field]))
        want, got = {}, {}
        for r in postings:
            n, most, least, impact = want.get((r.field, r.term, r.block), (0, 0, 1 << 30, 0.0))
            want[r.field, r.term, r.block] = n + 1, max(most, r.tf), min(least, r.length), max(impact, part(r))
        for r in now.summary.collect():
            assert r.mean == pytest.approx(now.means[r.field])
            n, most, least, impact = got.get((r.field, r.term, r.block), (0, 0, 1 << 30, 0.0))
            got[r.field, r.term, r.block] = n + r.n, max(most, r.most), min(least, r.least), max(impact, r.impact)
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
        files = now.postings.select("term", "field", "block", "key", F.input_file_name().alias("file")).collect()
        for file in {r.file for r in files}:
            own = [(r.term, r.field, r.block, r.key) for r in files if r.file == file]
            assert own == sorted(own)
