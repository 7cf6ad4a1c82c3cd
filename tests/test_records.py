"""CSV records with line breaks: cut across splits of any size, held against a plain parser; bytes that are no text; the level reached."""

import csv
import random

import pytest
from pyspark.sql import types as T

from tidemark.sources import readers, records

_BYTES = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    """Splits of a few lines each."""
    before = spark.conf.get(_BYTES)
    conf = {_BYTES: "900b", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "100"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    spark.conf.set(_BYTES, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.files.minPartitionNum")


def odd_fields(rng, n):
    parts = ["a", "b c", '"', '""', "\n", "\n\n", ",", ",\n", 'x"\n"y', "é", "7", "\r\n", "-", "long " * 30, "\n" * 40]
    return [[str(k), "".join(rng.choice(parts) for _ in range(rng.randint(0, 5))), "".join(rng.choice(parts) for _ in range(rng.randint(0, 3))), str(k / 4)] for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_records_against_a_plain_parser(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    rows = odd_fields(rng, 60)
    for f in range(2):
        with open(tmp_path / f"{f}.csv", "w", newline="") as out:
            w = csv.writer(out, lineterminator="\r\n" if seed % 2 else "\n", quoting=csv.QUOTE_ALL if seed == 2 else csv.QUOTE_MINIMAL)
            w.writerows([["id", "s", "t", "x"], *rows[f::2]])
    lines = records.lines(spark, str(tmp_path))
    assert len({(r["file"], r["start"]) for r in lines.collect()}) > 8
    df = readers.read_csv(spark, str(tmp_path))
    assert [f.dataType for f in df.schema] == [T.LongType(), T.StringType(), T.StringType(), T.DoubleType()]
    token = lambda s: None if s in ("", "-nan") or s in readers.null_tokens.__globals__["NULL_TOKENS"] else s
    want = {int(r[0]): (token(r[1]), token(r[2]), float(r[3])) for r in rows}
    assert {r["id"]: (r["s"], r["t"], r["x"]) for r in df.collect()} == want


def test_line_breaks_keep_columns_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,s,x\n1,"two\nlines",3\n2,one,4\n')
    report = readers.Report()
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), report=report)
    assert [f.dataType for f in df.schema] == [T.LongType(), T.StringType(), T.LongType()]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "two\nlines", 3), (2, "one", 4)] and report == readers.Report()


def test_a_header_over_two_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"a\nb"\n1,2\n')
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "a\nb"] and [tuple(r) for r in df.collect()] == [(1, 2)]


def test_stray_quotes_swallow_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,s,x\n1,5" pipe,3\n2,"a\nb",4\n3,c,5\n')
    assert sorted((r["id"], r["x"]) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()) == [(1, 3), (2, 4), (3, 5)]


def test_bytes_that_are_no_text_are_counted_and_replaced(spark, tmp_path):
    for name, body in (("a", b"k,s\n1,caf\xe9\n2,caf\xc3\xa9\n"), ("b", b'k,s\n1,caf\xe9\n2,"caf\xc3\xa9\n"\n')):
        (tmp_path / f"{name}.csv").write_bytes(body)
        report = readers.Report()
        rows = sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path / f"{name}.csv"), report=report).collect())
        assert (report.level, report.damaged, report.no_text) == ("LOSSY", 0, 1)
        assert rows == [(1, "caf�"), (2, "café" + "\n" * (name == "b"))]
    (tmp_path / "c.csv").write_bytes(b"k,s\n1,caf\xe9\n2\n")
    report = readers.Report()
    readers.read_csv(spark, str(tmp_path / "c.csv"), report=report)
    assert (report.level, report.damaged, report.no_text) == ("PERMISSIVE", 1, 1)


def test_malformed_records_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,s,v\n1,"a\nb",2\n2,"c\nd"\n\n3,"e\nf",4,5\n')
    report = readers.Report()
    rows = sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), report=report).collect())
    assert rows == [(1, "a\nb", 2), (2, "c\nd", None), (3, "e\nf", 4)] and (report.level, report.damaged) == ("PERMISSIVE", 2)


def test_an_open_quote_ends_with_the_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,s\n1,a\n2,"never\nclosed\n')
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect())[0] == (1, "a")


def test_line_states():
    walk = records.walker()
    cases = {
        "a,b": (False, True), 'a,"b': (True, False), '"a""': (True, False), 'a""b,c': (False, True), 'x" y': (False, False), '","': (False, True), '"': (True, False), 'b","c': (True, True),
        "": (False, True), 'q"",z': (False, True), '"a"",': (True, False), ',"",""': (False, True),
    }
    for line, (outside, within) in cases.items():
        assert (walk(line.encode(), False), walk(line.encode(), True)) == (outside, within), line


def test_splits_that_moved_are_seen(spark, tmp_path, small_splits):
    with open(tmp_path / "a.csv", "w", newline="") as out:
        csv.writer(out).writerows([["id", "s"], *[[k, "a\nb" * 40] for k in range(50)]])
    lines = records.lines(spark, str(tmp_path / "a.csv"))
    with pytest.raises(RuntimeError, match="splits differ"):
        records.records(lines, [("elsewhere", 0, 1)], tries=1)
    done = records.records(lines, [("elsewhere", 0, 1)], tries=2)
    assert done.count() == 51 and done.where("first").count() == 1
