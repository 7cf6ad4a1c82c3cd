"""Reading, aligning, and a whole run from CSV files to exported tables."""

import csv
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import pipeline
from tidemark.sources import readers


def write(path, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows(rows)
    return str(path)


def test_types_and_null_tokens(spark, tmp_path):
    path = write(tmp_path / "a.csv", [["i", "d", "s", "b", "e"], ["1", "1.5", "x", "true", ""], ["NA", "nan", "null", "false", "None"], ["3", "2", "007a", "true", "N/A"]])
    df = readers.read_csv(spark, path)
    assert [f.dataType for f in df.schema] == [T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.StringType()]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, "x", True, None), (None, None, None, False, None), (3, 2.0, "007a", True, None)]


def test_damaged_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"k,s\n1,caf\xe9\n2\n3,a,b,c\n")
    assert [r["k"] for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [1, 2, 3]
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))


def test_reading_falls_back_and_reports(spark, tmp_path):
    good = write(tmp_path / "good.csv", [["k", "v"], ["1", "2"]])
    report = readers.Report()
    readers.read_csv(spark, good, report=report)
    assert (report.level, report.damaged, report.misfits) == ("FAILFAST", 0, {})
    (tmp_path / "bad.csv").write_bytes(b"k,v\n1,2\n2\n3,4,5\n")
    rows = readers.read_csv(spark, str(tmp_path / "bad.csv"), report=report).collect()
    assert (report.level, report.damaged) == ("PERMISSIVE", 2) and [r["k"] for r in rows] == [1, 2, 3]
    lost = readers.Report()
    test = readers.read_csv(spark, write(tmp_path / "test.csv", [["k", "v"], ["1", "x"], ["NA", "3"]]), {"v": T.LongType(), "k": T.LongType()}, lost)
    assert lost.misfits == {"v": 1} and [r["v"] for r in test.collect()] == [None, 3]


def test_outputs_come_from_the_first_folder_that_has_them(spark, tmp_path):
    for n, rank in (("a", None), ("b", 1), ("c", 2)):
        (tmp_path / n).mkdir()
        if rank:
            write(tmp_path / n / "feature_importance.csv", [["rank", "feature", "importance"], [rank, "x", 0.5]])
    found = readers.load_outputs(spark, *(str(tmp_path / n) for n in "abc"))
    assert set(found) == {"feature_importance"} and found["feature_importance"].first()["rank"] == 1


def test_empty_file(spark, tmp_path):
    assert readers.read_csv(spark, write(tmp_path / "a.csv", [["a", "b"]])).count() == 0


def test_late_values_decide_types(spark, tmp_path):
    early = 100_000
    path = write(tmp_path / "a.csv", [["i", "d", "b"], *[["1", "1.5", "true"]] * early, ["2.5", "n/k", "maybe"]])
    df = readers.read_csv(spark, path)
    assert [f.dataType for f in df.schema] == [T.DoubleType(), T.StringType(), T.StringType()]
    assert [tuple(r) for r in df.where("i = 2.5").collect()] == [(2.5, "n/k", "maybe")] and df.where("i IS NOT NULL AND d IS NOT NULL AND b IS NOT NULL").count() == early + 1


def test_only_text_of_a_types_shape_is_cast_to_it(spark):
    """Failing casts throw, so texts that no cast takes must be told by their shape; and the shape must let all through that a cast takes."""
    core = ["", "17", "17.0", "-1", "+", ".5", "1.", "1e5", "1E-5d", "1e", "0x1p3", "NaN", "+nan", "-Infinity", "infinit", "N", "R", "no", "tRuE", "y", "2024-01-01", "1 2", "1.2x", "0x1", "007", "true story"]
    rows = spark.createDataFrame([(a + c + b,) for c in core for a in ("", " ", "\t", "\x1f") for b in ("", " ", "\r", "\x7f")], "x string")
    x = F.col("x")
    first = F.substring(F.ltrim("x"), 1, 1).isin(*"0123456789+-.nNiI")
    castable = lambda t: x.try_cast(t).isNotNull() | (x.try_cast("bigint").isNotNull() if t == "double" else F.lit(False))
    for t, begins in (("bigint", first), ("double", first), ("boolean", F.length(F.trim("x")) <= 5)):
        told = rows.select("x", (begins & castable(t)).alias("cast"), (begins & x.rlike(readers._SHAPES[t])).alias("shape"), readers._taken(x)[t].alias("taken")).collect()  # noqa: SLF001
        assert any(r["cast"] for r in told) and [r["x"] for r in told if r["taken"] != r["cast"]] == []
        assert sum(r["shape"] and not r["cast"] for r in told) <= 0.1 * len(told)


def test_ingest_needs_the_id(spark, tmp_path):
    a = write(tmp_path / "a.csv", [["CustomerID", "x", "ChurnStatus"], ["1", "2.5", "Yes"]])
    b = write(tmp_path / "b.csv", [["CustomerID", "x"], ["9", "3"]])
    _, test = readers.ingest(spark, a, b)
    assert test.columns == ["CustomerID", "x"] and test.first()["x"] == 3.0  # the target is not made up
    with pytest.raises(ValueError):
        readers.ingest(spark, a, write(tmp_path / "c.csv", [["x"], ["1"]]))


def test_whole_run(spark, tmp_path):
    random.seed(4)
    names = ["CustomerID", "Month", "ChurnStatus", "charge", "plan", "refunds", "city"]

    def rows(n, late):
        for k in range(n):
            plan = random.choice(["One-Year", "one_year", "Monthly"] if not late else ["Monthly", "monthly ", "One Year"])
            charge = random.gauss(50 + 40 * late, 10)
            churn = "Yes" if random.random() < (0.7 if plan.lower().startswith("m") else 0.2) else "No"
            refund = random.random() * 5 if random.random() < (0.3 if late else 0.1) else 0
            yield [f"{'T' if late else 'C'}{k}", random.choice(["25-Nov", "25-Dec"] if late else ["25-Jan", "25-Feb", "25-Mar"]), churn, round(charge, 2), plan, round(refund, 2), f"city {random.randrange(150)}"]

    a, b = (write(tmp_path / f"{n}.csv", [names, *rows(800, late)]) for n, late in (("a", 0), ("b", 1)))
    out = str(tmp_path / "out")
    done = pipeline.run(spark, *readers.ingest(spark, a, b), out=out)
    ranked = {r["feature"]: r["drift_severity"] for r in done.ranked.collect()}
    assert ranked["charge"] == "SEVERE" and "refunds" in ranked
    assert 0 < done.au_prc_train <= 1 and done.au_prc_test is not None
    assert done.scored.count() == 800
    parts = readers.load_outputs(spark, out)
    assert {"drift_results", "ranked_features", "feature_importance", "prediction", "pipeline_meta"} == set(parts)
    assert parts["pipeline_meta"].first()["n_train"] == 800
    assert {r["feature"]: r["mitigation"] for r in parts["drift_results"].collect()}["charge"] == "quantile_binning"
