"""Tolerant JSON: round trips, and broken inputs by hand."""

import json
import random

import pytest

from lodestrata.functions.lenient_json import parse, question_answers, question_answers_of

Q, A = "What is a widget, then?", 'A "thing" of [steel], {red}:\nsmall.'
PAIR = {"question": Q, "answer": A}


@pytest.mark.parametrize(
    "text",
    [
        json.dumps([PAIR]), json.dumps(PAIR), f"Sure!\n```json\n{json.dumps([PAIR], indent=2)}\n```\nBye.", f"```\n{json.dumps([PAIR])}", f"It is {json.dumps([PAIR])} I think.",
        json.dumps([PAIR])[:-2], json.dumps([PAIR])[:-1], json.dumps([PAIR])[:-2] + ",},]", json.dumps([PAIR]).replace('"question"', "question").replace('"answer"', "answer"),
        "[" + json.dumps(PAIR) + " " + json.dumps({"question": "short", "answer": A}), json.dumps([PAIR]).replace("\\n", "\n"), "\u201cx\u201d " + json.dumps({"a": 1, **PAIR, "n": [1, {"b": None}]}),
    ],
)
def test_broken_inputs_give_the_pair(text):
    assert question_answers(text) == [(Q, A)]


def test_other_quotes_and_inner_ones():
    assert question_answers("{'question': 'It\\'s what it is?', 'answer': 'It's a thing, you see.'}") == [("It's what it is?", "It's a thing, you see.")]
    assert question_answers('{"question": "He said "so" to me?", "answer": "True enough, I say"}') == [('He said "so" to me?', "True enough, I say")]
    assert question_answers('[{"question": "What was cut off?", "answer": "This one was, in the mid') == [("What was cut off?", "This one was, in the mid")]


def test_nothing_found():
    for text in (None, "", "no json here", "[]", "{}", "[1, 2", "{]", "[[[[", "]", '{"question": 12345678901, "answer": "abcdefghijk"}', '{"question": "abcdefghi", "answer": "abcdefghijk"}', "[" * 5000, "{" * 5000):
        assert question_answers(text) == []


def test_right_json_is_read_as_such_and_cuts_never_fail():
    rng = random.Random(1)

    def made(depth):
        kinds = [lambda: rng.randrange(99), lambda: "".join(rng.choices("ab\"'\\\\,:[]{} é\n", k=rng.randrange(9))), lambda: None, lambda: True]
        if depth:
            kinds += [lambda: [made(depth - 1) for _ in range(3)], lambda: {str(i): made(depth - 1) for i in range(3)}]
        return rng.choice(kinds)()

    for _ in range(300):
        value = [made(3)]
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5)
        assert parse("so: " + text) == value
        parse(text[: rng.randrange(len(text) + 1)])


def test_column(spark):
    rows = spark.createDataFrame([(1, json.dumps([PAIR, PAIR])), (2, None), (3, "none")], "i long, t string")
    got = {r.i: [(p.question, p.answer) for p in r.p] for r in rows.select("i", question_answers_of(rows.t).alias("p")).collect()}
    assert got == {1: [(Q, A)] * 2, 2: [], 3: []}
