"""Text and corpus operators: markdown, languages, terms, question-answer pairs, chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.fuzzy import alike_pairs, partial_ratio_column, token_sort_ratio_column  # noqa: F401
from lodestrata.operators.relational import distinct_ignoring_case
from lodestrata.sources.scratch import stored

# Languages by file extension.
LANGUAGES = {
    "python": "py pyw", "jupyter": "ipynb", "javascript": "js mjs cjs", "jsx": "jsx", "typescript": "ts", "tsx": "tsx", "vue": "vue", "svelte": "svelte",
    "html": "html htm xhtml", "css": "css", "scss": "scss", "sass": "sass", "less": "less", "c": "c h", "cpp": "cpp cc cxx hpp hxx c++ h++",
    "csharp": "cs", "java": "java", "kotlin": "kt kts", "scala": "scala sc", "groovy": "groovy", "ruby": "rb rake", "erb": "erb", "php": "php phtml", "go": "go", "rust": "rs", "swift": "swift",
    "bash": "sh bash zsh", "fish": "fish", "batch": "bat cmd", "powershell": "ps1", "yaml": "yaml yml", "json": "json", "toml": "toml", "ini": "ini", "xml": "xml", "csv": "csv",
    "markdown": "md markdown", "rst": "rst", "tex": "tex", "text": "txt", "sql": "sql", "r": "r", "perl": "perl pl", "lua": "lua", "dart": "dart", "fortran": "f f77 f90",
    "haskell": "hs lhs", "elm": "elm", "clojure": "clj", "elixir": "ex exs",
}
# Languages by the interpreter that a first line names, in order.
INTERPRETERS = {"python": "python", "ruby": "ruby", "node": "javascript", "bash": "bash", "zsh": "bash", "sh": "bash", "perl": "perl", "php": "php"}
# File names that hold these words, and categories of languages.
FILE_NAMES = ("makefile", "dockerfile")
CATEGORIES = {
    "code": "python javascript typescript java cpp c csharp ruby go rust", "documentation": "markdown rst tex text", "data": "json yaml toml xml csv ini",
    "web": "html css scss sass less", "script": "bash batch powershell fish",
}


def section_table(docs: DataFrame, key: str, content: str) -> DataFrame:
    """key, level, title, body: sections by header lines, those inside fences too. What comes before
    the first header is "Overview"; of equal titles the last one counts."""
    lines = docs.select(key, F.posexplode(F.split(content, "\n")).alias("at", "line"))
    header = F.col("line").rlike("^#{1,6}[ ]+[^ ]")
    in_order = Window.partitionBy(key).orderBy("at")
    marked = lines.withColumn("header", header).withColumn("nth", F.sum(F.col("header").cast("int")).over(in_order))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("header"), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    title = F.max(F.when(F.col("header"), F.regexp_extract("line", "^#+[ ]+(.*)$", 1)))
    level = F.max(F.when(F.col("header"), F.length(F.regexp_extract("line", "^(#+)", 1))))
    parts = marked.groupBy(key, "nth").agg(F.coalesce(title, F.lit("Overview")).alias("title"), F.coalesce(level, F.lit(0)).alias("level"), body.alias("body"))
    parts = parts.filter("nth > 0 OR trim(body) <> ''")
    return parts.groupBy(key, "title").agg(F.max_by(F.struct("level", "body"), "nth").alias("s")).select(key, "title", "s.level", "s.body")


def code_blocks(content: Column) -> Column:
    """Fenced blocks as (language, content); "text" where none is named."""
    pattern = F.lit("(?s)```([A-Za-z0-9_+-]*)\n(.*?)```")
    languages = F.transform(F.regexp_extract_all(content, pattern, F.lit(1)), lambda x: F.when(x == "", "text").otherwise(x))
    return F.arrays_zip(languages.alias("language"), F.regexp_extract_all(content, pattern, F.lit(2)).alias("content"))


def language_of(path: Column, first_line: Column | None = None) -> Column:
    """By extension, then the first line's interpreter, then the file's name; else "unknown"."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    extension = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    out = F.lit("unknown")
    for word in reversed(FILE_NAMES):
        out = F.when(name.contains(word), F.lit(word)).otherwise(out)
    if first_line is not None:
        for word, language in reversed(INTERPRETERS.items()):
            out = F.when(first_line.rlike(rf"^#!.*\b{word}\b"), F.lit(language)).otherwise(out)
    by_extension = F.create_map(*[F.lit(x) for language, names in LANGUAGES.items() for e in names.split() for x in (e, language)])
    return F.coalesce(F.try_element_at(by_extension, extension), out)


def category_of(language: Column) -> Column:
    out = F.lit("unknown")
    for category, names in CATEGORIES.items():
        out = F.when(language.isin(names.split()), category).otherwise(out)
    return out


def is_binary(content: Column) -> Column:
    """Whether the first 1024 characters hold one that is neither printable nor white space."""
    return F.substring(content, 1, 1024).rlike(r"[\p{C}&&[^\t-\r\x1C-\x1F\x85]]")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def definitions(content: Column) -> Column:
    """Functions and classes of indented code, nested ones too, as (name, kind, line, source). The
    source goes up to the next line that is not empty and not indented more deeply.

    Of the lines that are indented no more than a head, itself included, the next one ends its
    source. So lines are read once for each depth that heads have: that is linear in them but for
    nesting, and as lines of depth d are longer than d, depths are few in any text.
    """
    depth = lambda x: F.length(x) - F.length(F.ltrim(x))
    head = r"^[ \t]*(?:async +)?(def|class) +([A-Za-z_][A-Za-z0-9_]*)"

    def numbered(lines: Column) -> Column:
        every = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.when(F.trim(x) != "", depth(x)).alias("depth"), x.rlike(head).alias("head")))
        return F.filter(every, lambda n: n["depth"].isNotNull())

    def of_depth(lines: Column, at: Column, d: Column) -> Column:
        return _let(F.filter(at, lambda n: n["depth"] <= d), lambda some: F.filter(F.transform(some, lambda n, j: F.when(n["head"] & (n["depth"] == d), one(lines, n["i"], F.coalesce(F.get(some, j + 1)["i"], F.size(lines))))), lambda x: x.isNotNull()))

    def one(lines: Column, i: Column, end: Column) -> Column:
        x = F.get(lines, i)
        source = F.array_join(F.slice(lines, i + 1, end - i), "\n")
        return F.struct(F.regexp_extract(x, head, 2).alias("name"), F.regexp_extract(x, head, 1).alias("kind"), (i + 1).alias("line"), source.alias("source"))

    def of_lines(lines: Column, at: Column) -> Column:
        depths = F.array_distinct(F.transform(F.filter(at, lambda n: n["head"]), lambda n: n["depth"]))
        found = F.flatten(F.transform(depths, lambda d: of_depth(lines, at, d)))
        in_order = F.array_sort(F.transform(found, lambda f: F.struct(f["line"].alias("line"), f.alias("f"))))
        return F.transform(in_order, lambda x: x["f"])

    return _let(F.split(content, "\n"), lambda lines: _let(numbered(lines), lambda at: of_lines(lines, at)))


def terms_of(text: Column, least: int = 3) -> Column:
    """Words of some length and phrases of capitalised words, each once without regard to case."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{%d,}" % least), F.lit(0))
    phrases = F.regexp_extract_all(text, F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0))
    return distinct_ignoring_case(F.concat(words, phrases))


def embedded_terms(text: Column) -> Column:
    """[TERM: term | definition] annotations as (term, definition)."""
    pattern = F.lit("\\[TERM: *([^|\\]]*[^|\\] ]) *\\| *([^\\]]*[^\\] ]) *\\]")
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("term"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("definition"))


def annotate(text: Column, term: str, definition: str) -> Column:
    """The text with the term's first occurrence (also a plural) annotated, or the annotation appended."""
    note = f"[TERM: {term} | {definition}]"
    pattern = f"(?is)^(.*?(?:^|[^A-Za-z0-9])){re.escape(term)}(?:s|es)?([^A-Za-z0-9].*)?$"
    quoted = note.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, f"$1{quoted}$2")).otherwise(F.concat(text, F.lit(" " + note)))


def truncate_middle(tokens: Column, most: int) -> Column:
    """The tokens with the middle left out if there are more than `most`."""
    head = most // 2
    tail = most - head
    cut = F.concat(F.slice(tokens, 1, head), F.array(F.lit("...")), F.slice(tokens, -tail, tail))
    return F.when(F.size(tokens) > most, cut).otherwise(tokens)


def shorten(text: Column, most: int) -> Column:
    """Data URIs by their first thirty and last ten characters, other long texts by their start."""
    uri = text.startswith("data:") & (F.length(text) > 40)
    return F.when(uri, F.concat(F.substring(text, 1, 30), F.lit("..."), F.substring(text, -10, 10))).when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def sentences(text: Column) -> Column:
    """Cut after . ! or ? and white space."""
    return F.filter(F.split(F.regexp_replace(text, "([.!?])[ \n\t]+", "$1\u0001"), "\u0001"), lambda x: F.trim(x) != "")


def chunk(docs: DataFrame, key: str, text: str, most_tokens: int, overlap: float = 0.1) -> DataFrame:
    """key, nth, of, chunk: runs of whole sentences under a token cap, each beginning with the last
    sentences of the one before, worth a share of the cap, and a mark of its place."""
    source = docs.select(F.col(key).alias("k"), sentences(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    kind = source.schema["k"].dataType.simpleString()

    def cut(parts: list[str]) -> list[str]:
        chunks: list[list[str]] = []
        now: list[str] = []
        size = 0
        for p in parts:
            n = len(p.split())
            if now and size + n > most_tokens:
                chunks.append(now)
                back: list[str] = []
                kept = 0
                for q in reversed(now):
                    m = len(q.split())
                    if kept + m > overlap * most_tokens:
                        break
                    back.insert(0, q)
                    kept += m
                now, size = back, kept
            now.append(p)
            size += n
        if now:
            chunks.append(now)
        return [" ".join(c) for c in chunks]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i + 1, len(c), f"[CHUNK {i + 1}/{len(c)}] {x}") for k, s in zip(f.k, f.s) for c in [cut(list(s))] for i, x in enumerate(c)]
            yield pd.DataFrame(rows, columns=["k", "nth", "of", "chunk"])

    return source.mapInPandas(run, f"k {kind}, nth int, of int, chunk string").withColumnRenamed("k", key)


def function_questions(name: Column, parameters: Column, summary: Column) -> Column:
    """Question and answer pairs from templates, those without an answer left out."""
    qa = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    pairs = F.array(
        qa(F.concat(F.lit("What does the function "), name, F.lit(" do?")), summary),
        qa(F.concat(F.lit("Which parameters does "), name, F.lit(" take?")), F.when(parameters != "", F.concat(name, F.lit(" takes: "), parameters))),
        qa(F.concat(F.lit("How is "), name, F.lit(" called?")), F.concat(name, F.lit("("), parameters, F.lit(")"))),
    )
    return F.filter(pairs, lambda p: p["answer"].isNotNull())


def _filled(template: str, **parts: Column) -> Column:
    """A template with its {names} put in."""
    return F.concat(*[parts[x[1:-1]] if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x])


def _bullets(items: Column, name: str) -> Column:
    """A line for each item that has a description; null without one."""
    told = F.filter(items, lambda x: F.coalesce(x["description"], F.lit("")) != "")
    lines = F.transform(told, lambda x: F.concat(F.lit("- `"), x[name], F.lit("`: "), x["description"]))
    return F.when(F.size(told) > 0, F.array_join(lines, "\n"))


# The question templates of functions and of classes, in their order.
FUNCTION_QUESTIONS = (
    "What does the function `{name}{signature}` do?",
    "What are the parameters of `{name}`?",
    "What does `{name}` return?",
    "How do I use `{name}`? Show me an example.",
    "What errors can `{name}` raise?",
    "Show me the implementation of `{name}`.",
)
CLASS_QUESTIONS = ("What is the purpose of the `{name}` class?", "Show me the implementation of the `{name}` class.")


def _asked(templates: tuple[str, ...], answers: list[Column], **parts: Column) -> Column:
    """Pairs of those templates that have an answer; none without a name."""
    text = lambda a: F.when(a != "", a)
    pairs = F.array(*[F.struct(_filled(t, **parts).alias("question"), text(a).alias("answer")) for t, a in zip(templates, answers)])
    named = F.coalesce(parts["name"], F.lit("")) != ""
    return F.when(named, F.filter(pairs, lambda p: p["answer"].isNotNull())).otherwise(F.filter(pairs, lambda p: F.lit(False)))


def function_pairs(name: Column, signature: Column, doc: Column, parameters: Column, returns: Column, examples: Column, exceptions: Column, source: Column) -> Column:
    """Question and answer pairs of a function by the six templates: what it does (its docstring), its
    parameters (array of name, description), what it returns, examples (array), what it raises (array
    of type, description), its source. A missing signature reads `()`."""
    answers = [doc, _bullets(parameters, "name"), returns, F.array_join(examples, "\n"), _bullets(exceptions, "type"), source]
    return _asked(FUNCTION_QUESTIONS, answers, name=name, signature=F.coalesce(signature, F.lit("()")))


def class_pairs(name: Column, doc: Column, content: Column) -> Column:
    """Question and answer pairs of a class by the two templates: its purpose and its implementation."""
    return _asked(CLASS_QUESTIONS, [doc, content], name=name)


def valid_pairs(df: DataFrame, question: str = "question", answer: str = "answer", least_q: int = 10, least_a: int = 15) -> DataFrame:
    return df.filter((F.length(F.trim(F.col(question))) >= least_q) & (F.length(F.trim(F.col(answer))) >= least_a))


# Words that mark a question as one about an implementation.
IMPLEMENTATION = ("implementation", "how is", "how does", "code for", "source code", "how would you implement", "how to implement", "show me", "example of")


def complete_answers(df: DataFrame, question: str, answer: str, name: str, code: str, least: float = 80.0) -> DataFrame:
    """df with column completed: the answer, with the code appended where the question names the
    function and the answer does not hold its code by partial ratio. Null code appends nothing."""
    about = F.contains(F.lower(F.col(question)), F.lower(F.col(name)))
    whole = F.concat(F.col(answer), F.lit("\n\nHere is the complete implementation:\n\n```\n"), F.col(code), F.lit("\n```"))
    lacking = about & (partial_ratio_column(F.col(code), F.col(answer)) < least)
    return df.withColumn("completed", F.when(lacking, whole).otherwise(F.col(answer)))


def text_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, t (the text, null as empty) and first, the least key of all rows with that text."""
    t = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return t.join(t.groupBy("t").agg(F.min("k").alias("first")), "t").select("k", "t", "first")


#: Bytes of texts in a block, about; bytes of texts that one round shuffles at least, and as copies of all.
BLOCK_BYTES, ROUND_BYTES, ROUND_COPIES = 1 << 22, 1 << 28, 4


def partly_alike(df: DataFrame, key: str, text: str, least: float = 80.0) -> DataFrame:
    """Links (a, b) of keys, a < b: all pairs of rows whose texts have a partial ratio of `least` or more.
    Whole texts are compared, null as empty. Rows of one text are linked too, so that many of them are
    better given once, see text_classes().

    Texts are in blocks by a hash of their numbers, and every block meets every other once. A cell, two
    blocks, is one group's work in bounded memory, and holds each text once. Of B blocks in a ring, block x meets
    those up to half the ring on, so all distances have as many cells. A round has the cells of some
    distances: a text is shuffled twice for each, and the files go at the round's end, so the disk is
    that of a few copies of the texts. Time is quadratic in the texts.
    """
    t = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("id"))
    t = stored(t, "texts")  # with numbers that stay
    size = t.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(-(-size // BLOCK_BYTES), int((8 * t.sparkSession.sparkContext.defaultParallelism) ** 0.5))
    each = max(1, max(ROUND_BYTES, ROUND_COPIES * size) // max(1, 2 * size))
    far = blocks // 2 + 1
    rounds = [_met(t.select("id", "t"), blocks, d, min(d + each, far), least) for d in range(0, far, each)]
    links = reduce(DataFrame.unionByName, [stored(r, "alike") for r in rounds])
    end = lambda c: t.select(F.col("id").alias(c), F.col("k").alias(f"k{c}"))
    return links.join(end("a"), "a").join(end("b"), "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))


def _met(t: DataFrame, blocks: int, first: int, end: int, least: float) -> DataFrame:
    """Pairs (a, b) of numbers of alike texts t (id, t) whose blocks are `first` up to `end` apart in the ring."""
    own = t.select("id", "t", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    far = own.select("*", F.explode(F.sequence(F.lit(first), F.lit(end - 1))).alias("d"))
    before = F.pmod(F.col("block") - F.col("d"), F.lit(blocks))
    cells = far.select("id", "t", "d", F.explode(F.when(F.col("d") == 0, F.array("block")).otherwise(F.array(F.col("block"), before))).alias("x"), "block")
    cells = cells.filter((F.col("d") * 2 < blocks) | (F.col("x") * 2 < blocks))  # opposite blocks would meet twice

    def compare(table: pa.Table) -> pa.Table:
        ids, left = table.column("id").to_numpy(), table.column("block").to_numpy() == table.column("x").to_numpy()
        here = np.flatnonzero(left)
        found = list(alike_pairs(table.column("t").to_pylist(), here, np.flatnonzero(~left) if table.column("d")[0].as_py() else here, least))
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    # Few groups, each of which takes long: one a task, which Spark would make few.
    return cells.repartition(blocks * (end - first), "x", "d").groupBy("x", "d").applyInArrow(compare, "a long, b long")


def first_of_alike(keys: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """The keys that stay if each, in order, is dropped when linked to one that stayed before it.

    links: (a, b), a < b. A round decides all keys whose earlier neighbours are decided, so the
    rounds are as many as the longest chain of links needs, and each reads only open links.
    """
    open_links = stored(links.distinct(), "links")
    dropped = keys.select(F.col(key).alias("k")).limit(0)
    while not open_links.isEmpty():
        later = open_links.select(F.col("b").alias("k")).distinct()
        stay = open_links.select(F.col("a").alias("k")).distinct().join(later, "k", "left_anti")
        gone = stored(open_links.join(stay, open_links["a"] == stay["k"], "left_semi").select(F.col("b").alias("k")).distinct(), "dropped")
        dropped = dropped.unionByName(gone)
        left = open_links.join(gone, open_links["a"] == gone["k"], "left_anti").join(gone, F.col("b") == gone["k"], "left_anti")
        open_links = stored(left, "links")
    return keys.join(dropped, keys[key] == dropped["k"], "left_anti")


def first_of_classes(df: DataFrame, key: str, texts: list[str], least: float = 80.0) -> DataFrame:
    """The keys that stay if each row, in order, is dropped when one of its texts is partly alike, by
    partly_alike(), to the same column's text of a row that stayed before it, or equal to it.

    Rows of one text are a class, and classes are linked, not rows, so that n equal texts cost n. A
    round keeps every open row that is the first of all open rows in its own and linked classes, and
    drops the others of these; the rounds are as many as the longest chain of such rows. Null texts
    count as empty; keys have to be unique.
    """
    rows, near = df.select(F.col(key).alias("k")), []
    for i, text in enumerate(texts):
        own = text_classes(df, key, text)
        rows = rows.join(own.select("k", F.col("first").alias(f"c{i}")), "k")
        links = partly_alike(own.filter("k = first"), "k", "t", least)
        itself = own.select(F.col("first").alias("a"), F.col("first").alias("b")).distinct()
        near.append(stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(itself), "class-links"))
    rows = stored(rows, "class-rows")
    kept = rows.select("k").limit(0)
    while not rows.isEmpty():
        told = rows
        for i, links in enumerate(near):
            first = rows.groupBy(F.col(f"c{i}").alias("b")).agg(F.min("k").alias("least"))
            around = links.join(first, "b").groupBy(F.col("a").alias(f"c{i}")).agg(F.min("least").alias(f"least{i}"))
            told = told.join(around, f"c{i}")
        mine = [F.col("k") == F.col(f"least{i}") for i in range(len(near))]
        stay = stored(told.filter(reduce(lambda a, b: a & b, mine)).select("k", *[f"c{i}" for i in range(len(near))]), "stay")
        kept = kept.unionByName(stay.select("k"))
        for i, links in enumerate(near):
            gone = links.join(stay.select(F.col(f"c{i}").alias("b")), "b").select(F.col("a").alias(f"c{i}")).distinct()
            rows = rows.join(gone, f"c{i}", "left_anti")
        rows = stored(rows, "class-rows")
    return kept.withColumnRenamed("k", key)


def latest_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    last = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(key).agg(last).select("r.*")


def normalised(text: Column) -> Column:
    """Without tags and other than ASCII letters, digits and single spaces."""
    bare = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), "[^a-zA-Z0-9 ]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def without_punctuation(text: Column) -> Column:
    """Lower-cased, without ASCII punctuation."""
    return F.lower(F.regexp_replace(text, r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", ""))
