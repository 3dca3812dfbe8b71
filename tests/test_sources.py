"""File sources on small inline files."""

import json

from lodestrata.sources import files


def test_rules(spark, tmp_path):
    (tmp_path / "012-naming.mdc").write_text("---\nglobs: x\n---\n# Names\nUse clear names.\n\n## More\nrest")
    r = files.rules(spark, str(tmp_path)).first()
    assert (r.rule_number, r.title, r.description) == ("012", "Names", "Use clear names.") and r.content.endswith("rest")


def test_glossary_skips_incomplete_entries(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"term": "a", "definition": "b"}, {"term": "c"}, {"definition": "d"}, {"term": "", "definition": "x"}]))
    assert [r.term for r in files.glossary(spark, str(tmp_path / "g.json")).collect()] == ["a"]


def test_scenarios_report_what_is_missing(spark, tmp_path):
    whole = {f: "x" for f in files.SCENARIO_FIELDS}
    (tmp_path / "s.json").write_text(json.dumps([whole, {"title": "t", "description": "d"}]))
    good, bad = files.scenarios(spark, str(tmp_path / "s.json"))
    assert good.count() == 1 and bad.first().missing == ["query_example", "expected_result_format"]


def test_error_lists(spark, tmp_path):
    (tmp_path / "e.csv").write_text('# comment\nNO_ERROR,0,"No error","ok"\nBAD,x,"no","code"\n')
    assert [tuple(r)[:2] for r in files.error_catalogue(spark, str(tmp_path / "e.csv")).collect()] == [("NO_ERROR", 0)]
    text = spark.createDataFrame([('A,1,"first"\n## Network\n# note\nB,2,"second, with comma"\n## Disk\nC,3,third',)], "value string")
    assert [tuple(r) for r in files.error_lines(text).orderBy("code").collect()] == [("A", 1, "first", "General"), ("B", 2, "second, with comma", "Network"), ("C", 3, "third", "Disk")]


def test_repository(spark, tmp_path):
    (tmp_path / "a" / "skip").mkdir(parents=True)
    (tmp_path / "a" / "x.py").write_text("print(1)")
    (tmp_path / "a" / "y.md").write_text("# y")
    (tmp_path / "a" / "skip" / "z.py").write_text("no")
    got = files.repository(spark, str(tmp_path), ("py",), ignore="/skip/").collect()
    assert [r.content for r in got] == ["print(1)"]
    assert files.markdown_files(spark, str(tmp_path)).count() == 1
    assert files.repository(spark, str(tmp_path), most=2).count() == 2


def test_pairs_are_written_as_json_lines(spark, tmp_path):
    files.write_pairs(spark.createDataFrame([("q?", "a.")], "question string, answer string"), str(tmp_path / "out"))
    assert [tuple(r) for r in files.json_lines(spark, str(tmp_path / "out"), "instruction string, output string").collect()] == [("q?", "a.")]
