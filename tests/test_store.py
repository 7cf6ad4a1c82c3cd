"""Kept results: made anew where files, settings or code change, and only there."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.sources import store


def jobs(spark, name, f):
    spark.sparkContext.setJobGroup(name, "")
    try:
        out = f()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_files_settings_and_code_name_a_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "_results", lambda s: str(tmp_path / "kept"))
    path, made = str(tmp_path / "t"), []
    spark.range(5).write.parquet(path)

    def get(config=1):
        def make():
            made.append(config)
            return spark.read.parquet(path).agg(F.sum("id").alias("s"))

        return store.kept(spark, "sum", [path], config, make)

    first, n = jobs(spark, "a", get)
    assert n and first.first()["s"] == 10 and made == [1]
    again, n = jobs(spark, "b", get)
    assert n == 0 and again.first()["s"] == 10 and again.schema == first.schema and made == [1]
    get(2)
    assert made == [1, 2]
    spark.range(7).write.mode("append").parquet(path)
    assert get().first()["s"] == 31 and made == [1, 2, 1]
    monkeypatch.setattr(store, "code_version", lambda: "other code")
    get()
    assert made == [1, 2, 1, 1]
    store.forget(spark)
    get()
    assert len(made) == 5
    with pytest.raises(FileNotFoundError):
        store.kept(spark, "sum", [str(tmp_path / "none")], 1, get)


def test_a_run_that_broke_off_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "_results", lambda s: str(tmp_path / "kept"))
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).cast("int").alias("x"))
    with pytest.raises(Exception, match="broken"):
        store.kept(spark, "x", [path], 0, lambda: bad)
    assert store.kept(spark, "x", [path], 0, lambda: spark.range(1).select("id")).count() == 1


def test_changed_files_give_new_verdicts(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "_results", lambda s: str(tmp_path / "kept"))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    seen = lambda: {r["column"]: r["drift_detected"] for r in catalog.queries()["detect_notes"] and catalog._verdicts(spark, str(tmp_path)).collect()}
    before = seen()
    assert before["shifted"] and jobs(spark, "again", lambda: catalog._verdicts(spark, str(tmp_path)))[1] == 0
    late = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    moved = orders.withColumn("o_totalprice", F.when(late, F.col("o_totalprice") * 3 + 50_000).otherwise(F.col("o_totalprice")))
    moved.write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    after = seen()
    assert after["o_totalprice"] and not before["o_totalprice"]
