"""Metadata: schemas, foreign keys, method categories, docstrings and calls."""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.analysis import TEXT
from lodestrata.operators.relational import first_n, spread
from pyspark.sql.functions import udtf

from lodestrata.functions.vectors import embed
from lodestrata.sources.scratch import stored

# Keyword sets of method categories.
CATEGORIES = {
    "create": "create insert add new init", "read": "get fetch retrieve find search list", "update": "update modify change set", "delete": "delete remove clear",
    "bulk": "bulk batch many multiple", "validation": "validate check verify ensure", "utility": "format convert parse helper", "error_handling": "raise except error handle",
}


def schema_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """collection, field, type of each table; as many rows as the tables have columns."""
    rows = [(n, f.name, f.dataType.simpleString()) for n, df in sorted(tables.items()) for f in df.schema]
    return spark.createDataFrame(rows, "collection string, field string, type string")


def foreign_keys(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """Candidates (table, column, target, key): columns ending in key that share their name, apart
    from the table's prefix, with the first column of another table."""
    bare = lambda c: c.split("_", 1)[-1]
    first = {bare(df.columns[0]): (n, df.columns[0]) for n, df in tables.items() if df.columns[0].endswith("key") and not df.columns[0].startswith("l_")}
    return [(n, c, *first[bare(c)]) for n, df in sorted(tables.items()) for c in df.columns if c.endswith("key") and bare(c) in first and first[bare(c)][0] != n]


def verified_keys(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The candidates with the number of rows whose target is missing."""
    out = None
    for n, c, target, key in foreign_keys(tables):
        missing = tables[n].filter(F.col(c).isNotNull()).join(tables[target].select(F.col(key).alias(c)), c, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
        row = missing.select(F.lit(n).alias("collection"), F.lit(c).alias("field"), F.lit(target).alias("target"), F.lit(key).alias("target_field"), "missing")
        out = row if out is None else out.unionByName(row)
    return out


def categories_of(text: Column, raises: Column | None = None) -> Column:
    """Categories of which the text, a method's name and summary, holds a word as a part; a method
    that raises errors handles them."""
    low = F.lower(text)
    found = [F.when(low.rlike("|".join(words.split())), name) for name, words in CATEGORIES.items()]
    if raises is not None:
        found.append(F.when(raises, "error_handling"))
    return F.array_distinct(F.array_compact(F.array(*found)))


def summary_of(text: Column, most: int = 100) -> Column:
    first = F.concat(F.regexp_extract(text, "(?s)^([^.]*)", 1), F.lit("."))
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 3), F.lit("..."))).otherwise(first)


def docstring_parts(doc: Column) -> Column:
    """Parameters, raised errors and return text of a docstring in the common section style."""
    return F.struct(
        F.regexp_extract_all(doc, F.lit("(?m)^ *([a-z_]+) ?(?:\\([^)]*\\))?: "), F.lit(1)).alias("parameters"),
        F.regexp_extract_all(doc, F.lit("([A-Z][A-Za-z]*Error)"), F.lit(1)).alias("raises"),
        F.trim(F.regexp_extract(doc, "(?s)Returns?: *\n? *([^\n]*)", 1)).alias("returns"),
    )


def relevance(required: Column, in_example: Column, documented: Column) -> Column:
    return F.when(required, 3).otherwise(0) + F.when(in_example, 2).otherwise(0) + F.when(documented, 1).otherwise(0)


@udtf(returnType="kind string, name string, line int")
class PythonNames:
    """Imports and calls of a piece of Python code; nothing for code that does not parse."""

    def eval(self, code: str):
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError):
            return
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    yield "import", a.name, node.lineno
            elif isinstance(node, ast.ImportFrom):
                yield "import", node.module or "", node.lineno
            elif isinstance(node, ast.Call):
                f = node.func
                yield "call", f.id if isinstance(f, ast.Name) else getattr(f, "attr", ""), node.lineno


@udtf(returnType="name string, line int, is_async boolean, signature string, doc string, parameters array<struct<name:string,annotation:string,default:string,required:boolean>>, returns string, raises array<string>")
class PythonMethods:
    """Functions of a piece of Python code, nested ones by their dotted names, with what their heads,
    docstrings and own raise statements say, each error once in order; nothing for code that does not parse."""

    def eval(self, code: str):
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        todo = [(tree, "")]
        while todo:
            node, within = todo.pop()
            for x in ast.iter_child_nodes(node):
                named = isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
                todo.append((x, f"{within}{x.name}." if named else within))
                if named and not isinstance(x, ast.ClassDef):
                    yield within + x.name, x.lineno, isinstance(x, ast.AsyncFunctionDef), f"({ast.unparse(x.args)})", ast.get_docstring(x) or "", _parameters(x.args), ast.unparse(x.returns) if x.returns else None, _raised(x)


def _parameters(a: ast.arguments) -> list[tuple[str, str | None, str | None, bool]]:
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + a.defaults
    given = [*zip(plain, defaults), *zip(a.kwonlyargs, a.kw_defaults)]
    text = lambda x: ast.unparse(x) if x is not None else None
    out = [(p.arg, text(p.annotation), text(d), d is None) for p, d in given if p.arg not in ("self", "cls")]
    return out + [(p.arg, text(p.annotation), None, False) for p in (a.vararg, a.kwarg) if p]


def _raised(function: ast.AST) -> list[str]:
    """Errors that a function raises itself, not those of functions within it."""
    found: dict[str, None] = {}
    todo = list(ast.iter_child_nodes(function))[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            continue
        if isinstance(x, ast.Raise) and x.exc is not None:
            found.setdefault(ast.unparse(x.exc.func if isinstance(x.exc, ast.Call) else x.exc))
        todo += list(ast.iter_child_nodes(x))[::-1]
    return list(found)


def methods_of(df: DataFrame, code: str) -> DataFrame:
    """df with a row for each function of its code: the columns of PythonMethods. A few large files are
    read by all cores, as parsing takes far longer than reading."""
    return spread(df).lateralJoin(PythonMethods(F.col(code).outer()))


def analysed(methods: DataFrame) -> DataFrame:
    """methods_of() with summary, categories, examples (lines after >>>), errors (those raised or named by
    the docstring, each with what that says of it) and parameters with their descriptions in the docstring."""
    doc = F.col("doc")
    said = lambda pattern: F.arrays_zip(*[F.regexp_extract_all(doc, F.lit(pattern), F.lit(i)).alias(c) for i, c in ((1, "name"), (2, "text"))])
    methods = methods.withColumn("_said", said(r"(?m)^[ \t]*\*{0,2}([A-Za-z_][A-Za-z0-9_.]*) ?(?:\([^)\n]*\))?:[ \t]+([^\n]+)$"))
    first = lambda name: F.trim(F.get(F.filter("_said", lambda x: x["name"] == name), F.lit(0))["text"])
    parameters = F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["annotation"].alias("annotation"), p["default"].alias("default"), p["required"].alias("required"), first(p["name"]).alias("description")))
    named = F.transform(F.filter("_said", lambda x: x["name"].rlike("^[A-Z][A-Za-z.]*(Error|Exception)$")), lambda x: x["name"])
    errors = F.transform(F.array_distinct(F.concat("raises", named)), lambda e: F.struct(e.alias("type"), first(e).alias("description")))
    more = {
        "parameters": parameters, "errors": errors, "summary": summary_of(doc), "examples": F.regexp_extract_all(doc, F.lit(r"(?m)^[ \t]*>>> ([^\n]*)$"), F.lit(1)),
        "categories": categories_of(F.concat_ws(" ", "name", "doc"), F.size("raises") > 0),
    }
    return methods.withColumns(more).drop("_said", "raises")


def relevant_methods(methods: DataFrame, wanted: str, key: list[str], most: int = 3) -> DataFrame:
    """analysed() of the first methods, in order of name and key, whose summary holds the wanted words, in
    either case; only those are analysed. They are written first: under a projection Spark would sort all
    methods, parsing twice, instead of keeping the first of each task."""
    hit = F.contains(F.lower(summary_of(F.col("doc"))), F.lit(wanted.lower()))
    return analysed(stored(methods.filter(hit).orderBy("name", *key).limit(most), "relevant-methods"))


def deep_lookup(asked: DataFrame, name: str, methods: DataFrame) -> DataFrame:
    """For each distinct asked dotted name the methods of that name, analysed; none, a row of nulls. found
    says which."""
    names = asked.select(F.col(name).alias("_asked")).distinct()
    found = analysed(names.join(methods, F.col("_asked") == methods["name"]))
    out = names.join(found.withColumn("found", F.lit(True)), "_asked", "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False))).drop("name").withColumnRenamed("_asked", "name")


def method_lookup(asked: DataFrame, name: str, catalogue: DataFrame, method: str, summary: str, close: int = 3) -> DataFrame:
    """For each distinct asked name: exists, entries and the first summary in order, of the methods of
    this very name; close, the methods that share most of its words if it does not exist, `close` at most.

    Names are matched exactly, closeness by shared words: both by equi joins, so that no name meets
    the whole catalogue. A null name exists nowhere and is close to nothing.
    """
    names = asked.select(F.col(name).alias("name")).distinct()
    known = catalogue.groupBy(F.col(method).alias("name")).agg(F.count(F.lit(1)).alias("entries"), F.min(summary).alias("summary"))
    found = names.join(known, "name", "left")
    words = lambda df: df.select("name", F.explode(F.array_distinct(TEXT.tokens(F.col("name")))).alias("word"))
    missing = found.filter("entries IS NULL").select("name")
    shared = words(missing).join(words(known).withColumnRenamed("name", "other"), "word").groupBy("name", "other").agg(F.count(F.lit(1)).alias("n"))
    best = first_n(shared, "name", [F.desc("n"), F.col("other")], close).groupBy("name").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "other"))).alias("c"))
    out = found.join(best, "name", "left")
    return out.select("name", F.col("entries").isNotNull().alias("exists"), F.coalesce("entries", F.lit(0)).alias("entries"), "summary", F.coalesce(F.transform("c", lambda x: x["other"]), F.array().cast("array<string>")).alias("close"))


def define(spark: SparkSession, schema: dict, table: Callable[[str], DataFrame], edges: DataFrame, prefix: str = "") -> DataFrame:
    """Temporary views for a schema's collections, edge collections, graphs and search views, and the
    list of all definitions: kind, name, detail, n (rows).

    schema: collections (names), edges (name to the collections at both ends), graphs (name to edge
    names), views (name to collections with their fields), analyzers (name to what they give).
    edges: src_collection, src_key, dst_collection, dst_key, relationship_type.
    """
    made: list[tuple[str, str, str, DataFrame | None]] = [("collection", n, "", table(n)) for n in schema.get("collections", [])]
    kinds = {n: edges.filter((F.col("relationship_type") == n) & (F.col("src_collection") == a) & (F.col("dst_collection") == b)) for n, (a, b) in schema.get("edges", {}).items()}
    made += [("edge", n, ">".join(schema["edges"][n]), df) for n, df in kinds.items()]
    made += [("graph", n, ",".join(of), reduce(DataFrame.unionByName, [kinds[e] for e in of])) for n, of in schema.get("graphs", {}).items()]
    for n, of in schema.get("views", {}).items():
        parts = [table(c).select(F.lit(c).alias("collection"), F.to_json(F.struct(*fields)).alias("document")) for c, fields in of.items()]
        made.append(("view", n, ",".join(f"{c}({','.join(fields)})" for c, fields in of.items()), reduce(DataFrame.unionByName, parts)))
    made += [("analyzer", n, what, None) for n, what in schema.get("analyzers", {}).items()]
    rows = []
    for kind, name, detail, df in made:
        if df is not None:
            df.createOrReplaceTempView(prefix + name)
        counted = spark.range(1).select(F.lit(0).cast("long").alias("n")) if df is None else df.agg(F.count(F.lit(1)).alias("n"))
        rows.append(counted.select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(detail).alias("detail"), "n"))
    return reduce(DataFrame.unionByName, rows)


def scenario_faults(df: DataFrame) -> DataFrame:
    """df with the required fields that a scenario lacks, and those whose value has another type: the
    criteria must be a JSON list, the priority a whole number. All fields are texts."""
    required = ("title", "description", "query_example", "expected_result_type", "validation_criteria", "priority")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))
    a_list = F.from_json("validation_criteria", "array<string>").isNotNull() & F.col("validation_criteria").rlike(r"^\s*\[")
    whole = F.col("priority").cast("string").rlike("^-?[0-9]+$")
    mistyped = F.array_compact(F.array(F.when(~a_list, "validation_criteria"), F.when(~whole, "priority")))
    return df.withColumns({"missing": missing, "mistyped": mistyped})


# Packages of the standard library and common helpers, which are not analysed.
STANDARD_PACKAGES = "os sys json time datetime math random collections itertools functools typing pathlib shutil tempfile io re".split()
COMMON_PACKAGES = "numpy pandas requests pytest unittest logging loguru click typer rich".split()


def worth_analysing(package: Column) -> Column:
    return ~package.isin(STANDARD_PACKAGES + COMMON_PACKAGES) & ~package.startswith("_")


# Buckets of lint messages by category, and advice by symbol.
BUCKETS = {"Critical Error": "type_issues", "Warning": "quality_issues", "Method/Attribute Issue": "method_issues", "Style Issue": "style_issues"}
ADVICE = {
    "broad-exception-caught": "Replace 'except Exception:' with specific exception types",
    "wrong-import-order": "Place standard library imports before third-party imports",
    "missing-module-docstring": "Add a module-level docstring to describe the module's purpose",
    "trailing-whitespace": "Remove trailing whitespace from all lines",
    "missing-final-newline": "Add a newline at the end of the file",
}


def lint_bucket(category: Column) -> Column:
    """Other categories count as matters of quality."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair]), category), F.lit("quality_issues"))


def lint_advice(symbol: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair]), symbol)


# Types that a described field may have.
FIELD_TYPES = "string number boolean array object date unknown".split()


def field_faults(description: str, kind: str, citation: str, most_words: int = 30) -> Column:
    """What is wrong with the description of a field: its length, presence, type and citation."""
    text = F.coalesce(F.col(description), F.lit(""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.array_compact(
        F.array(
            F.when(words > most_words, "description too long"),
            F.when(text == "", "description missing"),
            F.when(~F.coalesce(F.col(kind).isin(FIELD_TYPES), F.lit(False)), "type invalid"),
            F.when(F.coalesce(F.col(citation), F.lit("")) == "", "citation missing"),
        )
    )


def reformatted(df: DataFrame, term: str, definition: str, vector: str) -> DataFrame:
    """Rows with a term and a definition, their vector made again from both and its format named."""
    whole = df.filter((F.coalesce(F.col(term), F.lit("")) != "") & (F.coalesce(F.col(definition), F.lit("")) != ""))
    return whole.withColumns({vector: embed(F.concat_ws(": ", term, definition)), "format": F.lit("search_document")})
