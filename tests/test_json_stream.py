"""Entries of large JSON objects and objects one behind the other, with splits of a few bytes."""

import json
import random

import pytest

from gradebook.sources import readers as RD
from gradebook.sources.json_stream import read_items


@pytest.fixture
def tiny_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "150b")
    yield
    spark.conf.set(key, before)


def text(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", " ", "\n", "a", "é", "😀", '\\"', "\\\\", "},{"]) for _ in range(rng.randrange(0, 60)))


def test_map_entries_equal_a_whole_parse(spark, tmp_path, tiny_splits):
    rng = random.Random(2)
    want = {}
    for n, indent in enumerate([None, 0, 2, 4, None, None]):
        m = {f"{k}{text(rng)}": text(rng) for k in range([40, 40, 30, 25, 1, 0][n])}
        (tmp_path / f"m{n}_promptID_001_output_{n}.json").write_text(json.dumps(m, indent=indent, ensure_ascii=n % 2 == 0) + "\n" * (n % 2), encoding="utf-8")
        want |= {(n, k): v for k, v in m.items()}
    (tmp_path / "m9_promptID_001_output_9.json").write_text("")
    df = RD.read_generations(spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == len(want) and {(r.experiment_id, r.case_key): r.text for r in rows} == want
    assert read_items(spark, str(tmp_path), ",", 1).rdd.getNumPartitions() > 20


def test_nested_values_in_splits(spark, tmp_path, tiny_splits):
    rng = random.Random(4)
    bank = {f"{k:03d}": {f: text(rng) for f in RD.QUESTION_FIELDS} for k in range(30)}
    (tmp_path / "bank.json").write_text(json.dumps(bank, indent=2))
    got = {r.case_key: {f: r[f] for f in RD.QUESTION_FIELDS} for r in RD.read_question_bank(spark, str(tmp_path)).collect()}
    assert got == bank


def test_objects_in_splits_equal_brace_depth(spark, tmp_path, tiny_splits):
    rng = random.Random(7)
    want = []
    for n in range(4):
        objects = [json.dumps({"id": k, "t": text(rng), "inner": {"x": [{}, {"y": text(rng)}]}}, indent=rng.choice([None, 3])) for k in range(25)]
        whole = rng.choice(["", "\n ", "} junk "]).join(["", *objects]) + ["", "\n", '{"id": 99, "t": "cut', ' }} {"id": 7}'][n]
        (tmp_path / f"{n}.json").write_text(whole)
        for place, piece in enumerate(RD.split_concatenated(whole)):
            try:
                o = json.loads(piece)
                want.append((n, place, True, o["id"], o.get("t")))
            except json.JSONDecodeError:
                want.append((n, place, False, None, None))
    df = RD.read_concatenated_json(spark, str(tmp_path), "id long, t string")
    got = sorted(((int(r.file_path[-6]), r.place, r.ok, r.id, r.t) for r in df.collect()), key=lambda r: r[:2])
    assert got == want


def test_one_item_over_many_splits(spark, tmp_path, tiny_splits):
    m = {"a": "x, {" * 500, "b": "", "c": 'y"}, ' * 300}
    (tmp_path / "m_promptID_001_output_1.json").write_text(json.dumps(m))
    assert {r.case_key: r.text for r in RD.read_generations(spark, str(tmp_path)).collect()} == m
