"""Readers on small hand-written files (layouts of the reference's inputs)."""

import json
import os

import pytest

from gradebook.sources import readers as RD


def test_rating_sheets_and_goals(spark, tmp_path):
    d = tmp_path / "ratings" / "model=m1" / "evaluator=user1"
    d.mkdir(parents=True)
    (d / "sheet.csv").write_text("1,5,4,3,2,1,extra\n2,x,4,,2,1,\n")
    df = RD.read_rating_sheets(spark, str(tmp_path / "ratings"), [f"metric{i}" for i in range(1, 6)])
    rows = {(r.case_id, r.metric): r.score for r in df.collect()}
    assert rows[(1, "metric1")] == 5.0 and rows[(2, "metric1")] is None and rows[(2, "metric3")] is None
    assert {r.model for r in df.collect()} == {"m1"} and df.first().source_file == "sheet.csv"
    g = tmp_path / "goals.csv"
    g.write_text(",0\n001,Know the dose\n002,\n")
    goals = {r.case_key: r.goal for r in RD.read_goals(spark, str(g)).collect()}
    assert goals == {"001": "Know the dose", "002": ""}


def test_pretty_printed_json_maps(spark, tmp_path):
    root = tmp_path / "out"
    root.mkdir()
    (root / "m0_promptID_001_output_3.json").write_text(json.dumps({"001": "START q END a", "002": "b"}, indent=4))
    df = RD.read_generations(spark, str(root))
    rows = sorted((r.model, r.prompt_id, r.experiment_id, r.case_key, r.text) for r in df.collect())
    assert rows == [("m0", "001", 3, "001", "START q END a"), ("m0", "001", 3, "002", "b")]
    qb = tmp_path / "qb"
    qb.mkdir()
    (qb / "bank.json").write_text(json.dumps({"007": {"case": "c", "question": "q", "options": "A. x", "answer": "A. x",
                                                       "explanation": "e", "labs": "Yes", "table": "No"}}, indent=2))
    q = RD.read_question_bank(spark, str(qb)).first()
    assert (q.case_key, q.case_id, q.labs, q.table) == ("007", 7, "Yes", "No")


def test_articles_flat_layout_and_sink(spark, tmp_path):
    p = tmp_path / "arts" / "pmc" / "2021"
    p.mkdir(parents=True)
    (p / "42.xml").write_text("<article><body><p>x</p></body></article>")
    a = RD.read_articles(spark, str(tmp_path / "arts")).first()
    assert (a.db, a.year, a.doc_id) == ("pmc", 2021, 42)
    out = str(tmp_path / "sink")
    RD.write_table(RD.read_articles(spark, str(tmp_path / "arts")), out, fmt="csv")
    assert any(f.endswith(".csv") for f in os.listdir(out))


def test_narrow_sheet_of_the_same_file_name_is_left_out(spark, tmp_path):
    for model, line in (("a", "1,2,3,4"), ("b", '1,"x, y",3,4,5,5')):
        folder = tmp_path / f"model={model}" / "evaluator=e"
        folder.mkdir(parents=True)
        (folder / "sheet.csv").write_text(line + "\n")
    (tmp_path / "model=c" / "evaluator=e").mkdir(parents=True)
    (tmp_path / "model=c" / "evaluator=e" / "sheet.csv").write_text('1,"a, b",2,"c,""d"", e",3\n')
    got = RD.read_checked_rating_sheets(spark, str(tmp_path), ["m1", "m2", "m3", "m4", "m5"]).collect()
    assert {r.model for r in got} == {"b"} and len(got) == 5
    assert sorted((r.file_path.split("model=")[1][0], r.n_columns) for r in RD.narrow_sheets(spark, str(tmp_path)).collect()) == [("a", 4), ("c", 5)]


@pytest.mark.parametrize("text,want", [('{"a":1}{"a":2}', ["{\"a\":1}", '{"a":2}']), ('\n{"a": {"b": "}{"}}\n\n {"a":"\\\\"}', ['{"a": {"b": "}{"}}', '{"a":"\\\\"}']),
                                       ('{"a":"\\"}{"} {"a":', ['{"a":"\\"}{"}', '{"a":']), ("", []), (" \n", []), ('{"a":"cut off {', ['{"a":"cut off {'])])
def test_concatenated_objects_are_cut_at_brace_depth(text, want):
    assert RD.split_concatenated(text) == want


def test_concatenated_json_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted" } { \\ text\n', [1, 2]), (2, None, []), (3, "é😀", None)]
    df = spark.createDataFrame(rows, "id long, t string, xs array<int>").coalesce(1)
    RD.write_concatenated_json(df, str(tmp_path / "out"))
    got = RD.read_concatenated_json(spark, str(tmp_path / "out"), df.schema).orderBy("place").collect()
    assert [(r.id, r.t, r.xs) for r in got] == rows and all(r.ok for r in got)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"id": 1}{"id": "no"}{"id": 3, ')
    bad = RD.read_concatenated_json(spark, str(tmp_path / "bad"), "id long").orderBy("place").collect()
    assert [(r.id, r.ok) for r in bad] == [(1, True), (None, False), (None, False)]
