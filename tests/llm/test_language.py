"""Language identification: held-out accuracy, and a plain naive Bayes over the same cells."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import language
from lodestrata.llm.language import FEATURES, MIX, ORDERS, PLACES, SMOOTHING, identify_languages, pieces


def cells_of(text):
    """Hashed n-grams one by one."""
    folded, out = "", Counter()
    for c in text:
        c = (c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " "
        if c != " " or folded[-1:] != " ":
            folded += c
    x = "  " + (folded if folded[:1] != " " else folded[1:])
    x += "" if x.endswith(" ") and len(x) > 2 else " "
    if x == "   ":
        x = "  "
    for end in range(2, len(x)):
        for n in range(ORDERS):
            h = (sum(ord(x[end - k]) * PLACES[k] for k in range(n + 1)) + n) % 2**32
            h = ((h ^ h >> 15) * MIX) % 2**32
            out[h >> (32 - FEATURES.bit_length() + 1)] += 1
    return out


def brute_force(rows):
    """id, text, lang: prediction and posterior of each."""
    counts, texts = defaultdict(Counter), Counter()
    for i, t, lang in rows:
        if t is not None and lang is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2:
            counts[lang] += cells_of(t)
            texts[lang] += 1
    out = []
    for i, t, _ in rows:
        if t is None or not any(unicodedata.category(c)[0] == "L" for c in t) or not texts:
            out.append((i, t, "und", 0.0))
            continue
        own, score = cells_of(t), {}
        for lang in sorted(texts):
            total = counts[lang].total() + SMOOTHING * FEATURES
            score[lang] = math.log((texts[lang] + 1) / (texts.total() + len(texts))) + sum(k * math.log((counts[lang][c] + SMOOTHING) / total) for c, k in own.items())
        best = max(score, key=score.get)
        out.append((i, t, best, 1 / sum(math.exp(s - score[best]) for s in score.values())))
    return out


TEXTS = [
    (1, "the cat sat on the mat", "en"), (2, "die Katze saß auf der Matte", "de"), (3, "le chat est sur le tapis", "fr"), (4, "a", None), (5, "Das Haus", "de"), (6, "THE HOUSE!", "en"),
    (7, "123 456", "en"), (8, "", "fr"), (9, None, "fr"), (None, "une maison", "fr"), (None, "the end", None), (10, "été ŐÜ ß ΑΒΓ", "xx"), (11, "ΑΒΓ αβγ", None), (1, "the cat sat on the mat", "en"), (12, "ü", None), (13, "\0 \0a", ""), (14, "İ i", "tr"), (15, " x", "tr"), (16, "𝔘𝔫𝔦", "tr"),
]


def check(df, rows):
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in df.collect()), key=repr)
    want = sorted(((i, lang, s) for i, _, lang, s in brute_force(rows)), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-6 and 0 <= g[2] <= 1 for g, w in zip(got, want))


def test_predictions_equal_brute_force(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").repartition(3)
    check(identify_languages(df), TEXTS)
    monkeypatch.setattr(language, "BLOCK", 2)  # several blocks of languages
    check(identify_languages(df), TEXTS)


@pytest.mark.parametrize("step", [1, 2, 3, 7])
def test_pieces_of_a_long_text_make_the_same_ngrams(monkeypatch, step):
    text = "A  b,, ćd 12 é\n" * 5
    whole = list(pieces(text))
    monkeypatch.setattr(language, "STEP", step)
    parts = list(pieces(text))
    assert np.array_equal(np.concatenate([whole[0][:2], *[p[2:] for p in parts]]), whole[0])
    ends = np.concatenate([[32, 32], *[p[2:] for p in parts]])
    seen = 0
    for p in parts:  # each has in front what stands before it
        assert np.array_equal(p[:2], ends[seen : seen + 2])
        seen += len(p) - 2


def test_held_out_documents_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right >= 0.99 * n


def test_labels_of_held_out_rows_change_nothing(spark, docs):
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(identify_languages(docs).collect()) == sorted(identify_languages(wrong).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.select("doc_id", "text", "lang").collect()]
    check(identify_languages(odd_docs), rows)
    assert identify_languages(no_docs).columns == ["doc_id", "held_out", "lang_pred", "score"] and identify_languages(no_docs).count() == 0
    none = identify_languages(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(none) == len(rows) and {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
