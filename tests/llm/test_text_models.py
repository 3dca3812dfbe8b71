"""Packing, quality, language model, decontamination, URLs, HTML and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import decontaminate, html, lm, packing, quality, queries, urls


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.word_bpe_path()
    whole = Tokenizer.from_file(path)
    rng = random.Random(1)
    parts = [*"ab'st Zé́\u00a0\u2003\x1c\x85\n\tΣς12ǅİ中.,!?&%$*#|", " ", "the", "The", "<|endoftext|>", "'s", "\u0301", "!!", "word.", "WORD!!"]
    for cached in (3, 10_000):
        encoder = packing.WordEncoder(path, cached=cached)
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
        for at in range(0, len(texts), 50):
            batch = texts[at : at + 50]
            for t, ids in zip(batch, encoder.encode_all([x.encode() for x in batch])):
                assert np.frombuffer(ids, encoder.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def check_pieces(rows, texts, length):
    """Each document's ids lie once in gapless pieces, and sequences are gapless and full but the last."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_bpe_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in texts.items():
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    assert sum(sum(r.length for r in p) < length for p in by_sequence.values()) <= 1


def test_packing_round_trip(spark, small, texts):
    rows = queries.op1_packing(spark, small).collect()
    check_pieces(rows, texts, packing.SEQUENCE)
    pieces = packing.pack(spark.read.parquet(f"{small}/documents.parquet"), queries.word_bpe_path())
    made = packing.sequences(pieces).collect()
    assert sum(r.n_tokens for r in made) == sum(r.length for r in rows) and {len(r.ids) for r in made} == {packing.SEQUENCE}


def test_packing_odd_rows(odd_docs, no_docs):
    unique = odd_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = packing.pack(unique, queries.word_bpe_path(), length=64).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(rows, {r.doc_id: r.text for r in unique.select("doc_id", "text").collect()}, 64)
    assert packing.pack(no_docs, queries.word_bpe_path()).count() == 0
    assert packing.pack(odd_docs, queries.word_bpe_path()).select("sequence_id", "offset").distinct().count() >= odd_docs.count()


def test_quality_against_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    rows = queries.op3_quality(spark, sf).join(labels, "doc_id").select("label", "kept").collect()
    kept = {v: [r.kept for r in rows if r.label == v] for v in (0, 1)}
    assert np.mean(kept[1]) > 0.98 and np.mean(kept[0]) < 0.1


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(4)
    n, right = 20_000, np.array([0.95, 0.8, 0.7, 0.9, 0.6, 0.85])
    truth = rng.random(n) < 0.7
    votes = np.where((rng.random((n, 6)) < right) == truth[:, None], 1, -1) * (rng.random((n, 6)) < 0.8)
    votes = np.concatenate([votes, np.zeros((n, len(quality.LABELLERS) - 6), int)], axis=1)
    patterns, times = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, times.astype(float))
    assert abs(model.good - 0.7) < 0.03
    assert np.abs(np.array(list(model.accuracies().values()))[:6] - right).max() < 0.04


def test_quality_sample_is_bounded_on_repeated_rows(spark, small):
    """A row that is a third of the table is one row of the sample, with a weight."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    hot = docs.filter("doc_id = 0").crossJoin(spark.range(5000).select(F.lit(1).alias("one"))).select("doc_id", "text")
    seen = []
    plain = quality.fit_scorer
    try:
        quality.fit_scorer = lambda x, q, times, **kw: seen.append((len(x), times.sum())) or plain(x, q, times, **kw)
        quality.fit(docs.unionByName(hot), sample=10**6)
    finally:
        quality.fit_scorer = plain
    n = docs.count()
    assert seen == [(n, n + 5000)]


def test_quality_odd_rows(odd_docs, no_docs):
    rows = quality.classify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.quality == 0 and not r.kept for r in rows if r.doc_id in (3, 4, 5))
    assert quality.classify(no_docs).count() == 0
    kept = quality.keep_good(odd_docs, threshold=0.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_language_model_scores(spark, small, texts):
    rows = queries.op4_lm_scoring(spark, small).collect()
    tokens = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_model_probabilities_sum_to_one():
    shape = lm.Shape(top=20, tail=10, dim=4)
    model = lm.Model.start(shape, np.log(np.full(30, 1 / 30)))
    rng = np.random.default_rng(2)
    model.train(rng.integers(0, 31, (5000, 4)), rng.integers(0, 30, 5000), np.log(np.full(30, 1 / 30)), rng)
    x = np.repeat(rng.integers(0, 31, (5, 4)), 30, axis=0)
    p = np.exp(model.log_probabilities(x, np.tile(np.arange(30), 5))).reshape(5, 30)
    assert np.abs(p.sum(1) - 1).max() < 1e-5
    model.values[1] *= 1000
    assert np.isfinite(model.log_probabilities(x, np.tile(np.arange(30), 5))).all()


def test_scoring_takes_exponentials_of_tables_not_of_tokens(monkeypatch):
    """Probabilities equal the plain formula, near and far; the exponentials do not grow with the tokens."""
    shape = lm.Shape(top=20, tail=10, dim=4)
    model = lm.Model.start(shape, np.log(np.full(30, 1 / 30)))
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 31, (20_000, 4)), rng.integers(0, 30, 20_000)
    model.train(x, y, np.log(np.full(30, 1 / 30)), rng)
    plain, taken = np.exp, []
    for times in (1, 20, 100):
        model.values[1] *= times
        inputs, outputs, places, bias = (v.astype("f8") for v in model.values)
        scores = np.einsum("bnd,nd->bd", inputs[x], places) @ outputs.T + bias
        most = scores.max(1)
        want = scores[np.arange(len(y)), y] - most - np.log(plain(scores - most[:, None]).sum(1))
        with monkeypatch.context() as m:
            m.setattr(np, "exp", lambda v, *a, **k: taken.append(np.size(v)) or plain(v, *a, **k))
            got = model.log_probabilities(x, y)
        assert got == pytest.approx(want, rel=1e-5, abs=1e-5)
        # The last scores lie so far apart that tokens need exponentials of their own.
        assert (sum(taken) <= 4 * 31 * 30) == (times < 100)
        taken.clear()
    assert len(model.log_probabilities(x[:0], y[:0])) == 0


@pytest.mark.parametrize("context", [1, 2, 4])
def test_training_step_follows_the_plain_gradient(context):
    shape = lm.Shape(top=20, tail=10, dim=4, context=context, noise=8)
    log_share = np.log(np.full(30, 1 / 30, "f4"))
    model = lm.Model.start(shape, log_share)
    rng = np.random.default_rng(6)
    x, y, noise = rng.integers(0, 25, (50, context)).astype("u2"), rng.integers(0, 25, 50).astype("u2"), rng.integers(0, 30, 8)
    inputs, outputs, places, bias = values = [v.astype("f8") for v in model.values]
    grads = [np.zeros(v.shape) for v in values]
    for xs, true in zip(x, y):
        p = (inputs[xs] * places).sum(0)
        back = np.zeros(4)
        for k, (w, sign) in enumerate([(true, 1), *((w, -1) for w in noise)]):
            up = sign / (1 + np.exp(sign * (p @ outputs[w] + bias[w] - log_share[w] - np.log(8))))
            grads[1][w] += up * p
            grads[3][w] += up
            back += up * outputs[w]
        for j, w in enumerate(xs):
            grads[0][w] += back * places[j]
            grads[2][j] += back * inputs[w]
    model.step(x, y, log_share, noise)
    for i, (v, g) in enumerate(zip(values, grads)):
        g = g / 50 if i == 2 else g / 50**0.5
        want = v + 0.1 * (0.1 if i == 2 else 1) * g / np.sqrt(1e-2 + g * g)
        assert model.values[i] == pytest.approx(want, rel=1e-3, abs=1e-5)
    assert np.isfinite(model.log_probabilities(x, y)).all()


def test_words_are_split_and_numbered_as_by_bytes():
    """All white space and only that, any bytes; a slice at a time; places, outcomes and rare words by number."""
    rng = random.Random(1)
    some = [b"a", b"B", b"Zz", b" ", b"\t", b"\x0b\x0c", b"\n", b"\r", b"\x1c", b"\xff", "\u00c4".encode(), b"\x00", b"\xa0", b"\x85"]
    texts = [b"".join(rng.choice(some) for _ in range(rng.choice((0, 1, 5, 40)))) for _ in range(300)]
    every = [[*t.lower().split(), b""] for t in texts]
    shape, known = lm.Shape(top=5, tail=7), sorted({w for t in every for w in t})[::2]
    outcome = {w: i if i < 5 else 5 + zlib.crc32(w[-2:]) % 7 for i, w in enumerate(known)}
    for kind in (lm.pa.binary(), lm.pa.large_binary()):
        rows = lm.pa.array([b"none", *texts], kind).slice(1)
        assert [t for part in lm._slices(rows, 50) for t in part.to_pylist()] == texts
        place, out, token, words, sizes = lm.Lexicon(shape, known, np.arange(len(known))).read(rows)
        words, flat = words.to_pylist(), [w for t in every for w in t]
        assert sizes.tolist() == [len(t) for t in every] and [words[i] for i in token] == flat
        assert place.tolist() == [known.index(w) if w in known else -1 for w in flat]
        assert out.tolist() == [outcome.get(w, 5 + zlib.crc32(w[-2:]) % 7) for w in flat]


def test_counts_beyond_what_a_task_holds(spark, monkeypatch):
    texts = [f"w{i % 97} W{i} same" for i in range(3000)] + ["", " "]
    monkeypatch.setattr(lm, "HELD", 500)
    df = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    got = {bytes(r.word): r.c for r in lm.count_words(df).collect()}
    assert got == Counter(w for t in texts for w in [*t.encode().lower().split(), b""])
    assert lm.count_words(df.limit(0)).count() == 0


def test_language_model_odd_rows(odd_docs, no_docs):
    rows = lm.score_texts(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm.score_texts(no_docs).count() == 0


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_overlap(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOW))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = WORDS.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    found |= names
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16 << 20, 600])
def test_overlap_equals_brute_force(spark, small, docs, texts, block):
    """Also with the test set in many blocks."""
    tests = spark.read.parquet(f"{small}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "the of"), (901, None), (902, "..."), (903, "the of")], "item_id long, text string"))
    items = [(r.item_id, r.text) for r in tests.collect()]
    got = decontaminate.find_overlap(docs, tests, block_bytes=block).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got], key=str) == plain_overlap(texts.items(), items)


def longest_by_hand(doc, tests, window):
    best = None
    d = [w.decode() for w in decontaminate.words_of(doc.encode())]
    for name, text in tests:
        t = [w.decode() for w in decontaminate.words_of(text.encode())]
        for i in range(len(d)):
            for j in range(len(t)):
                k = 0
                while i + k < len(d) and j + k < len(t) and d[i + k] == t[j + k]:
                    k += 1
                if k and k >= min(window, len(t)):
                    best = min(best or (0, 0, "", 0), (-k, i, name, j))
    return best and (-best[0], best[2], best[3], best[1])


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 40])
def test_longest_matches_equal_brute_force(spark, block):
    rng = random.Random(4)
    some = lambda k, n: " ".join(rng.choice("abcd"[:k]) for _ in range(n))
    tests = [(f"i{j}", some(rng.choice((1, 2, 3)), rng.choice((2, 5, 9, 20, 40)))) for j in range(12)] + [("none", ""), ("words", "x y")]
    docs = [(i, some(rng.choice((1, 2, 4)), rng.choice((1, 6, 30, 60)))) for i in range(40)] + [(40, "p x y q"), (41, None)]
    found = decontaminate.find_overlap(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id string, text string"), window=4, longest=True, block_bytes=block)
    got = {r.doc_id: tuple(r.longest) if r.longest else None for r in found.collect()}
    want = {i: longest_by_hand(t or "", tests, 4) for i, t in docs}
    if block == 40:  # which of equally long matches at one place is named depends on the blocks
        got, want = ({i: m and (m[0], m[3]) for i, m in x.items()} for x in (got, want))
    assert got == want


def test_a_worker_builds_a_test_set_once():
    class Items:
        value = [("a", b"x y")]

    first = decontaminate._test_set("one", Items, 10)
    assert decontaminate._test_set("one", Items, 10) is first and decontaminate._test_set("two", Items, 10) is not first
    assert len(decontaminate._built) == 1


def test_long_items_need_memory_for_their_words_only():
    import tracemalloc

    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(50_000)]
    tracemalloc.start()
    test = decontaminate.TestSet([("long", " ".join(words).encode()), ("same", b"w1 " * 3000)], 10)
    shard = decontaminate.Shard([" ".join(words[100:40_000]).encode(), b"w1 " * 5000], test)
    size, (keys, owners) = 10, test.windows[10]
    low, high = shard.ranges(keys, size)
    assert (high > low).sum() == 39_891 + 1
    begin = int(shard.begin[0])
    assert test.longest(shard.words[begin : begin + shard.n_words[0]]) == (39_900, 0, 100)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_overlap_odd_rows(spark, odd_docs, no_docs):
    tests = spark.createDataFrame([(1, "small text here"), (None, "word5 and5"), (3, "")], "item_id long, text string")
    want = plain_overlap([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()], [(1, "small text here"), ("null", "word5 and5")])
    got = decontaminate.find_overlap(odd_docs, tests).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got], key=str) == want
    kept = decontaminate.drop_contaminated(odd_docs, tests)
    assert kept.columns == odd_docs.columns and kept.count() == sum(x[2] == 0 for x in want)
    in_blocks = decontaminate.drop_contaminated(odd_docs, tests, block_bytes=8)
    assert in_blocks.columns == odd_docs.columns and sorted(map(str, in_blocks.collect())) == sorted(map(str, kept.collect()))
    assert decontaminate.find_overlap(no_docs, tests).count() == 0
    assert decontaminate.drop_contaminated(odd_docs, tests.limit(0)).count() == odd_docs.count()


URLS = [
    (1, "http://www.Example.COM/en/7?x"), (2, "https://a.example.net/de/81#y"), (3, "http://b.net/de/5"), (4, "http://x.org/es/"), (5, "http://xorg/es/"), (6, None), (7, "no scheme/en/"),
    (8, "http://example.com"), (9, "http://q.com?/en/"), (10, "a://b.com/en/7://c.org/es/"), (11, ""), (None, "http://K.com/en/1"), (1, "http://www.Example.COM/en/7?x"), (12, "http://\u212a.com/en/"),
]
RULED = {1: ("www.example.com", "/en/7", "example.com/en/7", "allow"), 2: ("a.example.net", "/de/81", "example.net/de/8", "block"), 3: ("b.net", "/de/5", "net/de/", "allow"), 4: ("x.org", "/es/", "org/es/", "block"), 5: ("xorg", "/es/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("example.com", "", None, "allow"), 9: ("q.com", "", None, "allow"), 10: ("b.com", "/en/7://c.org/es/", "com/en/", "block"), 11: ("", "", None, "allow"), None: ("k.com", "/en/1", "com/en/", "block"), 12: ("\u212a.com", "/en/", "com/en/", "block")}


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, None, "clash") for i, u in URLS], "page_id long, url string, bad int, host string")
    rows = urls.filter_urls(df, queries.URL_RULES).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == RULED[r.page_id]
    assert urls.filter_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_language_model_has_256_words_and_128_tail_classes():
    words = [f"{i}".encode() for i in range(5000)]
    outcome = lm.Lexicon(lm.Shape(), words, np.ones(5000)).outcome
    assert outcome[:256].tolist() == list(range(256)) and outcome[256:].min() >= 256 and len(set(outcome[256:].tolist())) > 50
    assert lm.Shape().outcomes == 256 + 128


def test_bad_templates_are_rejected(spark):
    rows = [(i, f"http://h.com/{'spam' if i % 3 == 0 else 'news'}/{i}/page", int(i % 3 == 0) if i % 2 else None) for i in range(600)]
    rows += [(1000 + i, f"http://even.com/{'a' if i % 2 else 'b'}/{i}", (i // 2) % 4 // 3) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    judged = {r.page_id: r.verdict for r in urls.filter_urls(df, []).collect()}
    assert all(judged[i] == ("block" if i % 3 == 0 else "allow") for i in range(600)) and all(judged[1000 + i] == "allow" for i in range(200))
    merged = {r.template for r in urls.template_verdicts(df).filter("host = 'even.com'").collect()}
    assert merged == {"/*/*"}


def test_small_bad_sections_keep_their_template(spark):
    """One of 25 equal sections, and one of 4 % in a large host."""
    rows = [(f"http://many.com/s{chr(97 + k)}/x{i}", int(k == 7)) for k in range(25) for i in range(40)]
    rows += [(f"http://large.com/{'spam' if i < 80 else 'news'}/x{i}", int(i < 80)) for i in range(2000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad int")
    judged = {r.page_id: r.verdict for r in urls.filter_urls(df, []).collect()}
    assert [judged[i] == "block" for i in range(len(rows))] == [bool(b) for _, b in rows]


def test_html_blocks_and_references():
    page = (
        "<html><head><title>t</title><script>if (a<b) document.write('<p>no</p>')</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies.</div>"
        "<article><h1>Head &amp; tail</h1><p>First  line\n of text, long enough to be read.<p>Second &lt;one&gt;&nbsp;here, and it goes on for a while.<br>More.<div class=ad>Buy now, cheap.</div><ul><li>item one of the list.<li>item two of it.</ul>"
        "<form><label>Name</label><input></form><div class='comments'><p>Nice post, I liked it.</p></div></article><footer>&copy; me</footer></body></html>"
    )
    got = html.extract_all([page], html.trained_trees())[0]
    assert got == "Head & tail\n\nFirst line of text, long enough to be read.\n\nSecond <one> here, and it goes on for a while. More.\n\nitem one of the list.\n\nitem two of it."


def test_node_classifier_on_unseen_pages():
    x, y = html.training_nodes(60, 99)
    assert (((html.trained_trees().chance(x) > 0.5) == y).mean()) > 0.99


def test_decoding_is_consistent():
    parent = [-1, 0, 1, 2, 0]
    assert html.decode(parent, np.array([0.1, 0.9, 0.01, 0.99, 0.2])) == [False, False, False, True, False]
    assert html.decode(parent, np.array([0.1, 0.9, 0.01, 0.6, 0.2])) == [False, True, False, False, False]


SENTENCES = "The first sentence of the article is here, and it is long. A second one follows it, too."


@pytest.mark.parametrize(
    "page, want",
    [
        ('<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>T</h1><p>{s}</p><script>if(a<b && c=="x){{}}</script><p>{s}</p></article></body></html>', "T\n\n{s}\n\n{s}"),
        ("<html><body><script>var s='<!--';</script><article><h1>T</h1><p>{s}</p><!-- c --><p>{s}</p></article></body></html>", "T\n\n{s}\n\n{s}"),
        ("<html><body><article><h1>T</h1><p>{s}</p><table><tr><td>Alpha</td><td>12</td></tr></table><p>{s}</p></article><footer>c</footer></body></html>", "T\n\n{s}\n\nAlpha\n\n12\n\n{s}"),
        ("<article><h1>T</h1><p>{s}</p></article>", "T\n\n{s}"),
        ("<article><h1>T</h1><p>{s}</p><dl><dt>Term</dt><dd>What it means is told here.</dd></dl><p>{s}</p></article>", "T\n\n{s}\n\nTerm\n\nWhat it means is told here.\n\n{s}"),
        ("<body><main><p>5 < 6 and a <b it's>bold</b> word. It is so, and remains so for long.</p><p>{s}</p></main></body>", "5 < 6 and a bold word. It is so, and remains so for long.\n\n{s}"),
        ('<body><div class="content"><h1>T</h1><p a="b>{s}</p><p>{s}</p></div></body>', "T\n\n{s}\n\n{s}"),
    ],
)
def test_html_hard_pages(page, want):
    """Markup inside scripts, tables and lists, short articles, quotes that do not close."""
    assert html.extract_all([page.format(s=SENTENCES)], html.trained_trees()) == [want.format(s=SENTENCES)]


def test_html_of_a_megabyte_of_open_tags():
    import time

    began = time.time()
    html.extract_all(["<article>" + "</div><b>" * 110_000 + SENTENCES], html.trained_trees())
    assert time.time() - began < 10


def test_html_equals_article_text(spark, small):
    from html import unescape

    def truth(h):
        m = re.search(r"<article>(.*?)(</article>|\Z)", h, re.S)
        parts = re.split(r"<(?:/?p|/?h1|/?article)>", m[1]) if m else []
        clean = (" ".join(unescape(re.sub(r"<[^>]*(>|\Z)", lambda k: " " if k[0].startswith("<br") else "", p)).split()) for p in parts)
        return "\n\n".join(p for p in clean if p)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.op9_html_extraction(spark, small).collect():
        assert r.text == truth(pages[r.page_id]) and r.n_chars == len(r.text)


def test_html_odd_rows(spark):
    deep = "<div>" * 3000 + "<p>deep text of some length, with a few words.</p>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text"), (4, "u", "<p"), (5, "u", deep), (None, "u", "<article><p>Some text, it is long enough to be seen."), (6, "u", "<a href='x"), (7, "u", "&amp &am <"), (6, "u", "<a href='x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract_text(df)
    assert got.count() == len(rows) and html.extract_text(df.limit(0)).count() == 0
    assert {r.page_id: r.text for r in got.collect()}[2] == ""


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    seen = set(docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert set(out.columns) == seen, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == last


def test_pipeline_over_no_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
