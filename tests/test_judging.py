"""A pluggable judge: validation, further attempts, defaults."""

from lodestrata.operators.judging import CONFIDENCE, ask, faults_of, judged


def test_faults():
    assert faults_of({"confidence": 1}, CONFIDENCE) == [] and faults_of(None, CONFIDENCE) == ["the answer has no fields"]
    for bad in ({}, {"confidence": "0.5"}, {"confidence": 1.5}, {"confidence": True}, {"confidence": float("nan")}):
        assert faults_of(bad, CONFIDENCE) == ["confidence must be a number from 0.0 to 1.0"]


def test_a_judge_is_told_what_was_wrong():
    seen = []

    def judge(claim, evidence, faults):
        seen.append(faults)
        return {"confidence": 2.0} if len(faults) < 2 else {"confidence": 0.25}

    assert ask(judge, "a", "b", CONFIDENCE, 3, 0.5) == ([0.25], 3, None)
    assert [len(f) for f in seen] == [0, 1, 2]
    assert ask(judge, "a", "b", CONFIDENCE, 2, 0.5) == ([0.5], 2, "confidence must be a number from 0.0 to 1.0")


def test_rows_with_errors_nulls_and_repetitions(spark):
    def judge(claim, evidence, faults):
        return {"confidence": 1 / len(evidence) if claim else 0.0}

    rows = [(1, "x", "abcd"), (1, "x", "abcd"), (2, None, "a"), (3, "x", None), (None, "x", "ab")]
    df = spark.createDataFrame(rows, "k long, c string, e string")
    got = sorted(((r.k, r.confidence, r.attempts, r.error) for r in judged(df, ["k"], "c", "e", judge, CONFIDENCE).collect()), key=repr)
    assert got == sorted([(1, 0.25, 1, None)] * 2 + [(2, 0.0, 1, None), (3, 0.5, 3, "ZeroDivisionError: division by zero"), (None, 0.5, 1, None)], key=repr)
    assert judged(df.limit(0), ["k"], "c", "e", judge, CONFIDENCE).count() == 0
