"""JSON as language models write it: in prose or fences, cut off, with bare keys, stray commas and quotes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"```(?:json)?\s*(.*?)(?:```|\Z)", re.S)
#: Nesting that is followed; what lies deeper is dropped.
DEPTH = 100
QUOTES = {'"': '"', "'": "'", "“": "”"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def json_part(text: str) -> str:
    """What of a text is meant as JSON: a fence's content, else all from the first bracket on."""
    if m := FENCE.search(text):
        return m[1].strip()
    m = re.search(r"[\[{]", text)
    return text[m.start() :] if m else ""


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self, depth: int = 0):
        c = self.peek()
        if c and c in "[{" and depth < DEPTH:
            return self.many(c, depth)
        return self.string() if c in QUOTES else self.bare()

    def many(self, opening: str, depth: int):
        """A list or an object, up to its end, a bracket that closes something else, or the text's end."""
        self.at += 1
        out: list | dict = [] if opening == "[" else {}
        while (c := self.peek()) and c not in "]}":
            before = self.at
            if c == ",":
                self.at += 1
                continue
            if opening == "[":
                out.append(self.value(depth + 1))
            else:
                name = self.string() if c in QUOTES else self.bare(":")
                if self.peek() == ":":
                    self.at += 1
                    out[str(name)] = self.value(depth + 1)
            if self.at == before:
                self.at += 1  # a sign that starts nothing
        if c == {"[": "]", "{": "}"}[opening]:
            self.at += 1
        elif c and depth == 0:
            self.at += 1
        return out

    def string(self) -> str:
        """Up to the quote that ends it: one with a separator, a bracket or nothing after it."""
        ends, out = QUOTES[self.text[self.at]], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                n = self.text[self.at + 1]
                if n == "u" and (m := re.match(r"[0-9a-fA-F]{4}", self.text[self.at + 2 : self.at + 6])):
                    out.append(chr(int(m[0], 16)))
                    self.at += 6
                else:
                    out.append(ESCAPES.get(n, n))
                    self.at += 2
                continue
            self.at += 1
            if c == ends and re.match(r"\s*(?:[,:\]}]|\Z)", self.text[self.at : self.at + 64]):
                break
            out.append(c)
        return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def bare(self, more: str = ""):
        m = re.compile(rf"[^,\]}}\n{more}]*").match(self.text, self.at)
        self.at = m.end()
        word = m[0].strip()
        try:
            return json.loads(word)
        except ValueError:
            return {"True": True, "False": False, "None": None}.get(word, word)


def parse(text: str):
    """The value that a text holds or begins to hold; None if there is none. Right JSON is read as such."""
    part = json_part(text)
    if not part:
        return None
    try:
        return json.loads(part)
    except (ValueError, RecursionError):
        return _Reader(part).value()


def question_answers(text: str | None, least: int = 10) -> list[tuple[str, str]]:
    """Question-answer pairs in a text, both of `least` characters or more; a lone one counts as a list."""
    found = parse(text) if text else None
    pairs = [(p.get("question"), p.get("answer")) for p in (found if isinstance(found, list) else [found]) if isinstance(p, dict)]
    return [(q, a) for q, a in pairs if isinstance(q, str) and isinstance(a, str) and len(q) >= least and len(a) >= least]


def question_answers_of(text: Column, least: int = 10) -> Column:
    """question_answers() as an array of structs; a null text has none."""

    @F.pandas_udf("array<struct<question:string,answer:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"question": q, "answer": a} for q, a in question_answers(t, least)])

    return run(text)
