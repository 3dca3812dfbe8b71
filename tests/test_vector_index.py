"""Inverted lists against all pairs."""

import inspect

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.operators import vector_index
from lodestrata.operators.graph import nearest_edges
from lodestrata.operators.vector_index import build_vector_index, fit_centres, recall_of, unit_rows
from lodestrata.plans import entities


def exact(vectors, asking, k):
    ids, m = list(vectors), unit_rows(list(vectors.values()))
    out = {}
    for q in asking:
        score = m @ unit_rows([vectors[q]])[0]
        out[q] = {i for _, i in sorted((-s, i) for s, i in zip(score, ids) if i != q)[:k]}
    return out


@pytest.fixture(scope="module")
def grouped(spark):
    """Vectors around forty directions, a third of them equal."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    vectors = {i: ([1.0] + [0.5] * 15 if i % 3 == 0 else (base[i % 40] + 0.2 * rng.normal(size=16)).tolist()) for i in range(1200)}
    return vectors, spark.createDataFrame(list(vectors.items()), "id long, v array<double>")


def test_probes_find_the_neighbours_of_grouped_vectors(spark, grouped):
    vectors, df = grouped
    index = build_vector_index(df, "id", "v", lists=30)
    assert len(index.centres) == 30 and index.sizes.sum() == len(vectors) and index.probes <= 6 and index.recall >= 0.95
    asking = [i for i in vectors if i % 7 == 0 and i % 3]
    found = {}
    for r in index.neighbours(df.filter("id % 7 = 0 AND id % 3 <> 0"), "id", "v", 5, same=False).collect():
        found.setdefault(r["query"], set()).add(r.id)
    want = exact(vectors, asking, 5)
    assert sum(len(want[q] & found[q]) for q in asking) >= 0.9 * 5 * len(asking)
    assert index.compared(df, "id", "v") < 0.8 * len(vectors) ** 2


def test_all_lists_are_exact(spark, grouped):
    vectors, df = grouped
    index = build_vector_index(df, "id", "v", lists=10)
    rows = index.neighbours(df.filter("id % 3 = 1"), "id", "v", 3, same=False, probes=10).collect()
    want = exact(vectors, [i for i in vectors if i % 3 == 1], 3)
    got = {}
    for r in rows:
        got.setdefault(r["query"], set()).add(r.id)
    assert got == want
    one = index.search(vectors[1], 4, probes=10).collect()
    assert {r.id for r in one} == want[1] | {1} and abs(one[0].similarity - 1) < 1e-9


def test_a_search_reads_its_lists_only(grouped):
    vectors, df = grouped
    index = build_vector_index(df, "id", "v", lists=30)
    plan = index.search(vectors[1], 3)._jdf.queryExecution().executedPlan().toString()
    assert "list#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    read = index.lists.filter(f"list IN ({', '.join(map(str, index.nearest_lists(vectors[1])))})")
    assert 0 < len(read.inputFiles()) and read.count() == index.sizes[index.nearest_lists(vectors[1])].sum() < len(vectors)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [2.0, 0.1]), (6, [2.0, 0.1]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = build_vector_index(df, "id", "v")
    assert index.sizes.sum() == 4
    got = sorted((r["query"], r.id) for r in index.neighbours(df.filter("id < 6"), "id", "v", 3, 0.5).collect())
    assert got == [(1, 1), (1, 6), (1, 6)]
    none = build_vector_index(df.filter("id = 2"), "id", "v")
    assert none.search([1.0, 0.0], 3).count() == 0 and none.neighbours(df, "id", "v", 3).count() == 0


def test_centres_of_few_rows():
    assert fit_centres(unit_rows([[1.0, 0.0]] * 5), 3).shape == (3, 2)


def test_recall_on_the_embeddings(spark):
    """At least nine of ten true neighbours, for both searches."""
    at = "/root/testdata/sf0.1"
    index, e = entities.vector_index(spark, at), entities.frame(spark, at, "embeddings")
    asking = e.filter("vec_id % 20 = 0")
    full = index.neighbours(asking, "vec_id", "embedding", 10, same=False, probes=len(index.centres))
    report = recall_of(index.neighbours(asking, "vec_id", "embedding", 10, same=False), full, "query", "vec_id").first()
    assert report.wanted == 1000 and report.recall >= 0.9
    edges = nearest_edges(e, "vec_id", "embedding", 5, 0.35).selectExpr("src AS query", "dst AS vec_id")
    assert recall_of(index.neighbours(e, "vec_id", "embedding", 5, 0.35, same=False), edges, "query", "vec_id").first().recall >= 0.9


def test_probing_copies_a_bounded_part(spark, grouped, monkeypatch):
    """A batch is not copied for all its lists at once, and each vector still goes to each of its lists."""
    vectors, df = grouped
    index = build_vector_index(df, "id", "v", lists=20)
    monkeypatch.setattr(vector_index, "COPIES", 100)
    made = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: made.append(run) or self)
    index._probing(df.select("id", "v"), 20)
    batch = pa.RecordBatch.from_pydict({"id": list(vectors)[:50], "v": list(vectors.values())[:50]})
    out = list(made[0]([batch]))
    assert sum(map(len, out)) == 50 * 20 and max(map(len, out)) <= 100 and len({(i, n) for b in out for i, n in zip(b["id"].to_pylist(), b["list"].to_pylist())}) == 1000


def test_nearest_edges_of_many_blocks_equal_one(spark, grouped):
    """Blocks of 4,096 rows as a default: a vector is shuffled an eighth as often as with 512."""
    _, df = grouped
    found = [sorted((r.src, r.dst) for r in nearest_edges(df.filter("id % 3 <> 0"), "id", "v", 5, 0.35, *rows).collect()) for rows in ((), (100,))]
    assert found[0] == found[1] and found[0]
    assert "4096" in str(inspect.signature(nearest_edges))


def test_blocks_and_groups_of_lists_give_the_same_rows(spark, grouped, monkeypatch):
    """Lists that are cut, several of them in a group, and blocks of queries."""
    _, df = grouped
    df = df.filter("id % 3 <> 0")  # equal vectors have cosines that differ in their last bit
    index, found = build_vector_index(df, "id", "v", lists=12), []
    for block, scores, rows in ((4096, 1 << 22, 1 << 21), (100, 500, 300)):
        monkeypatch.setattr(vector_index, "BLOCK", block)
        monkeypatch.setattr(vector_index, "SCORES", scores)
        monkeypatch.setattr(vector_index, "FOUND", rows)
        found.append(sorted((r["query"], r.id) for r in index.neighbours(df, "id", "v", 4, 0.3, same=False, probes=5).collect()))
    assert found[0] == found[1] and len(found[0]) > 2000


def test_the_best_of_rows_and_of_parts_with_ties():
    score = np.random.default_rng(4).integers(0, 6, (30, 200)) / 6
    want = [(i, int(j)) for i in range(30) for j in np.argsort(-score[i], kind="stable")[:3] if score[i, j] >= 0.5]
    assert list(zip(*(x.tolist() for x in vector_index.best_of_rows(score, 3, 0.5)))) == want
    best = vector_index.Best(3)
    for at in (50, 150, 100, 0):
        i, j = np.nonzero(score[:, at : at + 50] >= 0.5)
        best.add(i, j + at, score[i, j + at])
    assert list(zip(*(x.tolist() for x in best.all()[:2]))) == want


def test_a_vector_is_copied_for_a_bounded_number_of_blocks():
    """615,000 vectors were cut into 151 blocks of 4,096, and each was shuffled 302 times."""
    assert vector_index.blocks_of(615_000, 4096) <= 10 and vector_index.blocks_of(5000, 4096) == 2 and vector_index.blocks_of(0, 4096) == 1
