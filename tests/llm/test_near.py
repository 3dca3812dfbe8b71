"""SimHash components and similar texts against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import similar, simhash


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def closure(n, pairs):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def wanted(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = closure(len(rows), pairs)
    smallest = defaultdict(list)
    for (i, _), r in zip(rows, root):
        if i is not None:
            smallest[r].append(i)
    return sorted([(i, f"{f:016x}", min(smallest[r], default=None)) for (i, _), f, r in zip(rows, fps, root)], key=str)


def test_components_equal_brute_force(docs, texts):
    got = sorted([tuple(r) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == wanted(list(texts.items()))


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in simhash.near_duplicates(odd_docs).collect()], key=str) == wanted(rows)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({c for _, _, c in wanted(rows)})


@pytest.mark.parametrize("most", [4096, 8])
def test_links_join_all_that_are_close(spark, most):
    """Also where buckets are larger than allowed and are filed again."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:6]:
        for _ in range(60):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = simhash.components(simhash.links(df, 3, 6, most))
    root = {r.node: r.root for r in found.collect()}
    want = closure(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    groups = lambda label: sorted(sorted(g) for g in _grouped(label).values())
    assert groups({signed(x): root.get(signed(x), signed(x)) for x in fps}) == groups({signed(x): w for x, w in zip(fps, want)})


def _grouped(label):
    out = defaultdict(list)
    for k, v in label.items():
        out[v].append(k)
    return out


def test_long_chains_become_one_component(spark):
    edges = spark.range(306).select((F.col("id") * 7 % 307).alias("a"), ((F.col("id") + 1) * 7 % 307).alias("b"))
    rows = simhash.components(edges).collect()
    assert {r.root for r in rows} == {0} and len({r.node for r in rows}) == len(rows) == 307


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {b" ".join(w)}


def similar_survivors(rows):
    sets = [shingles(t) for _, t in rows]
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    root = closure(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    groups = defaultdict(list)
    for (i, _), r in zip(rows, root):
        groups[r].append(i)
    return sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=str)


def made_up(seed, families, size, changes):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice(changes)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("families, size, changes", [(30, 3, (0, 1, 2, 3)), (1, 60, (1, 2, 3, 4, 5))])
def test_similar_texts_equal_brute_force(spark, families, size, changes):
    rows = made_up(5, families, size, changes)
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == similar_survivors(rows)


def test_extended_and_trimmed_copies_equal_brute_force(spark):
    """Also at a similarity of 0.8 itself, and just below it."""
    rng = random.Random(7)
    rows = []
    for i in range(150):
        shingles_kept = rng.choice((76, 156, 396))
        base = [f"{i}w{j}" for j in range(shingles_kept + 4)]
        more = [f"{i}m{j}" for j in range(shingles_kept // 4 + i % 3 - 1)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + more if i % 2 else more + base))]
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    want = similar_survivors(rows)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want and len(want) == 150 + 50


@pytest.mark.parametrize("block", [similar.BLOCK, 16])
def test_chains_with_dissimilar_ends_equal_brute_force(spark, monkeypatch, block):
    """Families that drift word by word, with ends that are not similar and words common to all."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(11)
    rows = []
    for family in range(6):
        words = [f"{family}w{j}" for j in range(120)]
        steps = []
        for i in range(30):
            at = 4 * i
            words = [f"{family}s{i}x{j}" if at <= j < at + 4 else w for j, w in enumerate(words)]
            steps.append(" ".join(words))
        rng.shuffle(steps)
        rows += [(len(rows) + k, s) for k, s in enumerate(steps)]
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == similar_survivors(rows)


def test_similar_texts_whose_smallest_hashes_differ_are_found(spark):
    """Shingles that only one text has are chosen to have small hashes, so that sketches share next to nothing."""
    rng = random.Random(3)
    core = [f"c{j}" for j in range(404)]

    def extended(name):
        words = list(core)
        while len(words) < 449:
            word = f"{name}{rng.randrange(10**9)}"
            if similar.shingle_hashes(" ".join([*words[-4:], word]).encode(), 5)[0] % 2**32 < 2**32 * 0.05:
                words.append(word)
        return " ".join(words)

    rows = [(0, extended("a")), (1, extended("b")), (2, " ".join(core[:300]) + " and another end")]
    x, y = ([np.unique(similar.shingle_hashes(t.encode(), 5).astype("<u4"))[: similar.SKETCH].tobytes()] for _, t in rows[:2])
    assert similar.sketch_shares(similar._sketch_table(x), similar._sketch_table(y))[0] < 0.4
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == similar_survivors(rows) == [0, 2]


def test_signatures_rule_out_no_similar_sets():
    rng = np.random.default_rng(2)
    for size in (1, 4, 60, 1000, 5000):
        for _ in range(50):
            x = np.unique(rng.integers(0, 2**32, size).astype("<u4"))
            y = np.unique(np.concatenate([x[: rng.integers(len(x) // 2, len(x) + 1)], rng.integers(0, 2**32, rng.integers(0, size // 3 + 1)).astype("<u4")]))
            may = similar._may_by_bits(*similar._signatures([similar.signature(x), similar.signature(y)]), len(x), len(y), 0.8)
            assert may or not similar._alike(x, y, 0.8)
    other = [similar.signature(rng.integers(0, 2**32, 300).astype("<u4")) for _ in range(2)]
    assert not similar._may_by_bits(*similar._signatures(other), 300, 300, 0.8)


def test_two_groups_meet_only_in_their_dropped_members(spark):
    """a0~a1, b0~b1 and a1~b1 are similar and other pairs with them are not; a1 and b1 meet in large buckets only."""
    span = lambda name, k: [f"{name}{j}" for j in range(k)]
    core = span("core", 44)
    a1, b1 = core + span("p", 8), core + span("q", 2)
    a0, b0 = span("z", 3) + core + span("p", 14), span("v", 3) + core + span("q", 8)
    others = [core + span("common", 60) + [f"u{k}"] for k in range(7)]
    rows = [(i, " ".join(t)) for i, t in enumerate([a0, b0, *others, a1, b1])]
    sets = [shingles(t) for _, t in rows]
    alike = {(i, j) for j in range(11) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert {x for x in alike if set(x) & {0, 1, 9, 10}} == {(0, 9), (1, 10), (9, 10)}
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == similar_survivors(rows) == [0, 2]


def test_similar_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    kept = similar.drop_similar(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == similar_survivors(rows)
    assert similar.drop_similar(no_docs).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        pairs = []
        for _ in range(60):
            n = int(400 * share)
            both, a, b = (rng.integers(0, 1 << 32, k, dtype=np.uint32) for k in (n, (400 - n) // 2, (400 - n) // 2))
            pairs.append([np.unique(np.concatenate([both, z]))[: similar.SKETCH].astype("<u4").tobytes() for z in (a, b)])
        errors = similar.sketch_shares(*[similar._sketch_table(side) for side in zip(*pairs)]) - share
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_sketches_of_small_sets_are_exact():
    part = lambda *x: np.array(x, "<u4").tobytes()
    x, y = [part(1, 2, 3, 4), part(5), part()], [part(2, 3, 4, 2**32 - 1), part(6), part()]
    assert similar.sketch_shares(similar._sketch_table(x), similar._sketch_table(y)).tolist() == [0.6, 0.0, 0.0]


def test_tables_of_the_steps_are_deleted(spark, docs):
    """Only the numbered rows and the numbers of dropped ones stay, which the result reads."""
    import os

    from lodestrata.llm._shared import scratch_root

    at = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    kept = similar.drop_similar(docs)
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - before) == ["similar-dropped", "similar-rows"]
    assert kept.count() > 0
