"""Quoted records over many splits against Python's own reader, rejected rows with their line and fault."""

from __future__ import annotations

import csv
import io
import random

import pytest

from veritab.sources import files, lines


@pytest.fixture
def small_splits(spark):
    """A session whose files are cut into splits of 500 bytes."""
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "500")
    session.conf.set("spark.sql.files.openCostInBytes", "500")
    return session


@pytest.mark.parametrize("line, opened, want", [("a,b", False, False), ('a,"b', False, True), ('a,"b"",c', False, True), ('a,"b"""', False, False), ('b",c', True, False), ("b,c", True, True), ('b"",c', True, True), ('5" pipe,x', False, False), ('x,"",y', False, False), ('x","y', True, True), ("", True, True), ('"', False, True), ('""', False, False)])
def test_quotes_open_at_the_end(line, opened, want):
    assert lines.ends_open(line, opened, ",") is want


def random_value():
    kinds = ["plain", "with, comma", 'say "hi"', "two\nlines", "x" * 120, 'a "quoted\n\nblock", ends', "é ü", "0", "line\nbreak\n" * 3]
    return random.choice(kinds)


@pytest.mark.parametrize("seed", range(3))
def test_rows_over_many_splits_equal_pythons(small_splits, tmp_path, seed):
    random.seed(seed)
    rows = [["id", "a b", "c"], *([str(i), random_value(), random_value()] for i in range(300))]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    path = tmp_path / "r.csv"
    path.write_text(text.getvalue(), encoding="utf-8")
    df, report = files.read_csv(small_splits, str(path))
    assert df.columns == ["id", "a_b", "c"] and report.warnings == []
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows[1:]))
    assert lines.raw_lines(small_splits, str(path)).rdd.getNumPartitions() > 20
    one, _ = files.read_csv(small_splits, str(path), delimiter=",")
    starts = {r["line"] for r in lines.records(small_splits, str(path), ",", lines.layout(small_splits, str(path), ",")).collect()}
    want, at = set(), 1
    for row in rows:
        want.add(at)
        at += 1 + sum(v.count("\n") for v in row)
    assert starts == want and one.count() == 300


def test_rejected_rows_have_their_line_and_fault(small_splits, tmp_path):
    body = "".join(f'{i},"some\nvalue {i}",x\n' for i in range(1, 101))
    (tmp_path / "f.csv").write_text('a,b,c\n1,2,3,4\n"5\n6",7\n' + body + '8,9\n10,"never closed,\nand on\n')
    df, report = files.read_csv(small_splits, f"{tmp_path}/f.csv")
    assert df.count() == 100
    found = [(r["line"], r["error"]) for r in report.rejected.orderBy("line").collect()]
    assert found == [(2, "TOO MANY COLUMNS"), (3, "MISSING COLUMNS"), (205, "MISSING COLUMNS"), (206, "UNCLOSED QUOTE")]
    code, _, n, examples = report.warnings[0]
    assert (code, n, examples[0]) == ("rejected_rows", 4, "2: TOO MANY COLUMNS: 1,2,3,4")


def test_a_record_that_never_ends_is_not_gathered(small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "MAX_CHARS", 2000)
    body = "".join(f"{i},x\n" for i in range(2000))
    (tmp_path / "u.csv").write_text('a,b\n1,y\n2,"never closed\n' + body)
    df, report = files.read_csv(small_splits, f"{tmp_path}/u.csv")
    assert [tuple(r) for r in df.collect()] == [("1", "y")]
    assert [(r["line"], r["error"], r["record"]) for r in report.rejected.collect()] == [(3, "UNCLOSED QUOTE", '2,"never closed')]


def test_survey_file(spark, tmp_path):
    path = tmp_path / "survey.csv"
    rows = [f"{i};{30 + i};{'F' if i < 10 else 'M'};{-999 if i in (3, 7) else 50000 + i};2024-01-{i:02};{i % 5};0123{i % 10}" for i in range(1, 11)]
    path.write_text("Respondent ID;Age (yrs);gender;income;joined;score;zip\n" + "\n".join(rows) + "\n11;36;F;1;2024-03-11;4;01234;extra\n")
    df, report = files.load(spark, str(path))
    assert df.count() == 10 and df.dtypes[1] == ("age_yrs", "bigint") and dict(df.dtypes)["zip"] == "string"
    assert report.warnings == [("rejected_rows", None, 1, ["12: TOO MANY COLUMNS: 11;36;F;1;2024-03-11;4;01234;extra"])]


def test_odd_files(small_splits, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.csv").write_text("﻿a,b\r\n1,\"x\r\ny\"\r\n\r\n", encoding="utf-8")
    (tmp_path / "d" / "2.csv").write_text("a,b\n2,z", encoding="utf-8")
    df, report = files.read_csv(small_splits, f"{tmp_path}/d")
    assert sorted(map(tuple, df.collect())) == [("1", "x\ny"), ("2", "z")] and report.warnings == []
    (tmp_path / "e.csv").write_text("")
    assert files.read_csv(small_splits, f"{tmp_path}/e.csv")[0].columns == []
    (tmp_path / "h.csv").write_text('"a\nb",c\n')
    df, _ = files.read_csv(small_splits, f"{tmp_path}/h.csv")
    assert df.columns == ["a_b", "c"] and df.count() == 0
