"""Closed-form cases and properties of the statistics."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions import special, text
from tidemark.functions.scalars import cut, present, severity_of
from tidemark.operators import cumulative, detect, drift, frequency, mitigate, model, months, profile
from tidemark.operators.rank import rank_drift


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(("raw", "normal"), [("  Bank-Withdrawal__X ", "bank withdrawal x"), ("-abc ", " abc"), ("A\t\nB", "a b"), ("", ""), (None, None)])
def test_normalise(spark, raw, normal):
    assert one(spark.createDataFrame([(raw,)], "x string").select(text.normalise(F.col("x")))) == normal


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert [r[0] for r in df.select(cut(F.col("x"), F.array(F.lit(2.0), F.lit(3.0)))).collect()] == [0, 0, 1, 2, 0]


def freq(spark, shares, n=1000, feature="f"):
    return spark.createDataFrame([(feature, c, int(s * n), float(s)) for c, s in shares.items()], "feature string, category string, n long, freq double")


def test_divergences(spark):
    a, b = freq(spark, {"x": 0.5, "y": 0.5}), freq(spark, {"u": 0.5, "v": 0.5})
    assert drift.psi(a, a).first()["psi"] == 0
    assert drift.psi(a, b).first()["psi"] == pytest.approx(drift.psi(b, a).first()["psi"])
    assert drift.js(a, a).first()["js"] == pytest.approx(0, abs=1e-12)
    assert drift.js(a, freq(spark, {"x": 0.5, "y": 0.2, "z": 0.3})).first()["js"] > 0
    assert drift.l1(a, b).first()["l1"] == pytest.approx(2)
    assert drift.chi2(a, freq(spark, {"x": 0.6, "y": 0.4})).first()["chi2"] == pytest.approx(40)
    assert drift.chi2(freq(spark, {"x": 1.0}), freq(spark, {"x": 1.0})).first()["chi2"] is None


def test_js_of_disjoint_sides(spark):
    a = spark.createDataFrame([("f", "x", 1.0, 0.0), ("f", "y", 0.0, 1.0)], "feature string, category string, p double, q double")
    assert drift.js_of(a).first()["js"] == pytest.approx(1, abs=1e-6)


def test_ks(spark):
    lo, hi = (spark.range(k, k + 50).select(F.col("id").cast("double").alias("x")) for k in (0, 1000))
    assert drift.ks(lo, hi, ["x"]).first()["ks"] == 1
    assert drift.ks(lo, lo, ["x"]).first()["ks"] == 0
    both = [df.select((F.col("x") ** 3 + 5).alias("x")) for df in (lo, lo.where("x < 30"))]
    assert drift.ks(*both, ["x"]).first()["ks"] == pytest.approx(drift.ks(lo, lo.where("x < 30"), ["x"]).first()["ks"])
    assert drift.ks(lo, lo.where("false"), ["x"]).first()["ks"] is None


def test_ks_ignores_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,)], "x double")
    assert drift.ks(df, df, ["x"]).first().asDict() == {"feature": "x", "ks": 0.0, "n_train": 2, "n_test": 2}


def test_tails():
    assert special.chi2_upper(5, 2) == pytest.approx(math.exp(-2.5))
    assert special.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.chi2_upper(0, 3) == 1
    assert special.chi2_upper(200, 100) == pytest.approx(1.3e-8, rel=0.2)
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert special.ks_two_sample(1.0, 3, 3) == pytest.approx(2 / 20)  # two of the paths of 3 + 3 steps touch the corner
    assert special.ks_two_sample(1.36 * math.sqrt(2 / 5000), 5000, 5000) == pytest.approx(0.049, abs=0.002)


def test_finite_sample_law_has_published_values():
    """Marsaglia, Tsang and Wang (2003) give the first four, tables of critical values the others."""
    for d, n, want in ((0.274, 10, 0.6284796154565), (0.04, 2000, 0.99676943191713676985), (0.06, 2000, 0.99999893956930568118), (0.016, 16000, 0.99945234913828052085)):
        assert 1 - special.kolmogorov_upper(d, n) == pytest.approx(want, abs=1e-9)
    for n, d, p in ((5, 0.56328, 0.05), (10, 0.40925, 0.05), (20, 0.29408, 0.05), (100, 0.13403, 0.05), (10, 0.48893, 0.01), (20, 0.35241, 0.01)):
        assert special.kolmogorov_upper(d, n) == pytest.approx(p, abs=2e-5)


def test_ways_to_the_finite_sample_law_agree():
    """Matrix against expansion, matrix against the tail, and the law against all orders of a few values."""
    for t in (0.45, 0.7, 1.0, 1.36, 1.7, 1.95):
        assert special._pelz_good(t / 50, 2500) == pytest.approx(special._durbin(t / 50, 2500), abs=5e-8)
    for n in (30, 3000):
        assert 2 * special._smirnov_upper(2 / math.sqrt(n), n) == pytest.approx(1 - special._durbin(2 / math.sqrt(n), n), rel=1e-8)
    assert 2 * special._smirnov_upper(2.2e-3, 10**6) == pytest.approx(1 - special._pelz_good(2.2e-3, 10**6), rel=1e-6)
    for n in (1, 2, 7, 40):
        values = [special.kolmogorov_upper(k / 200, n) for k in range(201)]
        assert values == sorted(values, reverse=True) and values[0] == 1 and values[-1] == 0
    rng = np.random.default_rng(2)
    for n in (3, 8):
        u = np.sort(rng.random((200_000, n)), 1)
        far = np.maximum((np.arange(1, n + 1) / n - u).max(1), (u - np.arange(n) / n).max(1))
        for d in (0.1, 0.25, 0.4, 0.6, 0.9):
            assert special.kolmogorov_upper(d, n) == pytest.approx((far >= d).mean(), abs=0.005)


def test_large_samples_use_the_finite_law():
    assert special.ks_two_sample(0.3, 20_000, 30) == special.kolmogorov_upper(0.3, 30)
    assert all(type(special.kolmogorov_upper(t / math.sqrt(n), n)) is float for t in (0.5, 1.0, 2.5) for n in (3, 400, 30_000, 10**7))  # rows take no other numbers
    assert special.ks_two_sample(0.01, 10**12, 10**12) == 0 and 0 < special.ks_two_sample(1e-6, 10**12, 10**12) < 1


@given(st.integers(2, 12), st.integers(2, 12))
def test_exact_ks_is_a_probability(n, m):
    values = [special.ks_two_sample(k / 10, n, m) for k in range(1, 11)]
    assert all(0 <= v <= 1 for v in values)
    assert values == sorted(values, reverse=True)


def test_proportions(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x double") for xs in ([1.0] * 30 + [0.0] * 70, [1.0] * 50 + [None] * 50))
    z = drift.proportion_test(a, b, ["x"]).first()
    assert (z["rate_train"], z["rate_test"]) == (0.3, 0.5)
    assert z["z"] == pytest.approx(-0.2 / math.sqrt(0.4 * 0.6 * 0.02))
    assert drift.proportion_test(a, b.where("false"), ["x"]).first()["z"] == 0


@given(st.floats(0, 10))
def test_severity_has_half_open_bounds(x):
    c = DEFAULT.z
    assert severity_of(x, c) == ("NONE" if x < 2 else "MILD" if x < 3.5 else "MODERATE" if x < 5 else "SEVERE")
    assert [severity_of(v, c) for v in (2.0, 3.5, 5.0)] == ["MILD", "MODERATE", "SEVERE"]


def test_running_sums_do_not_depend_on_buckets(spark):
    df = spark.createDataFrame([("f", float(k * 7 % 101), 1) for k in range(101)] + [("g", 1.0, 5)], "feature string, x double, n long")
    for buckets in (1, 3, 64):
        got = {(r["feature"], r["x"]): r["cum_n"] for r in cumulative.running_sums(df, ["n"], buckets=buckets).collect()}
        assert got == {("f", float(k)): k + 1 for k in range(101)} | {("g", 1.0): 5}
        down = {(r["feature"], r["x"]): r["cum_n"] for r in cumulative.running_sums(df, ["n"], descending=True, buckets=buckets).collect()}
        assert down[("f", 100.0)] == 1 and down[("f", 0.0)] == 101


def test_top_and_rest(spark):
    a = freq(spark, {f"c{k}": 0.1 for k in range(10)})
    got = {r["category"]: (r["p"], r["q"]) for r in frequency.top_other(a, freq(spark, {"c0": 0.5, "new": 0.5}), 3).collect()}
    assert set(got) == {"c0", "c1", "c2", "__OTHER__"}
    assert got["__OTHER__"] == (pytest.approx(0.7), pytest.approx(0.5))


# ---- months ----
def labels(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "month string")


JAN_TO_OCT = [f"25-{m}" for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct")]


def test_month_order(spark):
    df = labels(spark, *JAN_TO_OCT)
    assert {r["month"]: r["rank"] for r in months.month_rank(df, "month").collect()} == {m: k for k, m in enumerate(JAN_TO_OCT)}
    assert {r[0] for r in months.recent_months(df, "month").collect()} == {"25-Sep", "25-Oct", "25-May"}
    assert [r[0] for r in months.month_rank(labels(spark, "b", "a"), "month").orderBy("rank").select("month").collect()] == ["a", "b"]


def test_recency_factor(spark):
    from dataclasses import replace

    assert one(months.recency_factor(labels(spark, "25-Jan", "25-Jan"), "month")) == pytest.approx(1)
    flat = replace(DEFAULT, decay=0.0)
    assert one(months.recency_factor(labels(spark, *JAN_TO_OCT), "month", flat)) == pytest.approx(0.1)


def test_segments(spark):
    m = lambda rows: spark.createDataFrame([("f", k, v) for k, v in rows], "feature string, month string, mean double")
    got = months.drifted_months(m([("a", 10.0), ("b", 12.0)]), m([("c", 11.0), ("e", 50.0), ("d", 2.0)])).first()
    assert (got["stable"], got["months"]) == (False, "d,e")
    assert months.drifted_months(m([("a", 10.0)]), m([("c", 11.0)])).count() == 0  # one month makes no range


def test_signed_scores_rank_last_unless_switched(spark):
    from dataclasses import replace

    df = spark.createDataFrame([("a", "sparse", "z", -9.0, "SEVERE"), ("b", "numerical", "ks", 0.1, "MILD")], "feature string, col_type string, test_used string, raw_score double, drift_severity string")
    serve = labels(spark, "25-Jan")
    first = lambda c: rank_drift(df, serve, "month", c).orderBy("drift_rank").first()["feature"]
    assert (first(DEFAULT), first(replace(DEFAULT, abs_score=True))) == ("b", "a")


# ---- profiles ----
def test_null_counts_as_a_value_and_as_a_zero(spark):
    df = spark.createDataFrame([(1,), (None,), (2,), (0,)], "x int")
    assert profile.cardinality(df, ["x"]).first()["n_unique"] == 4
    assert profile.null_zero_rates(df, ["x"]).first()["zero_rate"] == 0.5
    empty = profile.profile(df.where("false")).first()
    assert (empty["n_unique"], empty["null_rate"], empty["feature_type"]) == (0, 0.0, "constant")


def test_types_in_order(spark):
    rows = [(k, f"id{k}", "25-Jan" if k % 2 else "25-Feb", k % 3, None if k % 5 else 1.0, f"c{k % 150}", 7, float(k), k % 2 == 0) for k in range(400)]
    df = spark.createDataFrame(rows, "n long, id string, m string, cat int, rare double, city string, same int, num double, flag boolean")
    types = profile.manifest(profile.profile(df, {"n": "metadata"}))
    assert types == {"n": "metadata", "id": "metadata", "m": "time", "cat": "categorical", "rare": "sparse", "city": "high_cardinality", "same": "constant", "num": "numerical", "flag": "categorical"}


def test_bounded_cardinality_gives_the_same_types(spark, sf):
    from dataclasses import replace

    df = spark.read.parquet(f"{sf}/orders.parquet")
    loose = replace(DEFAULT, cardinality="bounded")
    assert profile.manifest(profile.profile(df)) == profile.manifest(profile.profile(df, config=loose))


def test_quartile_of_zero_counts_as_missing(spark):
    a = spark.createDataFrame([(float(x),) for x in (0, 0, 0, 10)], "x double")
    assert drift.numeric_prescreen(a, a, ["x"]).first()["iqr_gap"] > 0  # its own lower quartile gives way to the mean


# ---- encoders and scores ----
def test_unseen_levels_and_laplace(spark):
    train = spark.createDataFrame([("a", "Yes"), ("a", "No"), ("b", None), (None, "Yes")], "c string, y string")
    test = spark.createDataFrame([(1, "A "), (2, "zz"), (3, None)], "k int, c string")
    assert one(mitigate.unseen_rates(train, test, ["c"]).select("rate")) == pytest.approx(2 / 3)
    rate = mitigate.global_rate(train, "y", "Yes")
    codes = mitigate.target_codes(train, "c", "y", "Yes", rate)
    got = {r["k"]: r["c"] for r in mitigate.with_codes(test, "c", codes, rate).collect()}
    assert got[2] == pytest.approx(rate)
    assert got[1] == pytest.approx((2 * 0.5 + 10 * rate) / 12)
    counts = {r["k"]: r["c"] for r in mitigate.with_codes(test, "c", mitigate.frequency_codes(train, "c"), 0).collect()}
    assert counts == {1: 2, 2: 0, 3: 1}


def test_train_codes_do_not_depend_on_test(spark):
    train = spark.range(100).select(F.col("id").cast("double").alias("x"))
    fits = [mitigate.Mitigator().fit(train, spark.range(k, k + 50).select(F.col("id").cast("double").alias("x")), {"x": "numerical"}).breaks for k in (0, 500)]
    assert fits[0] == fits[1]


def test_pruned_columns_become_null(spark):
    train = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit("a").alias("c"))
    test = spark.range(100).select(F.lit(3.0).alias("x"), F.lit("b").alias("c"))
    fitted = mitigate.Mitigator().fit(train, test, {"x": "numerical", "c": "high_cardinality"})
    assert sorted(fitted.pruned) == ["c", "x"]
    assert fitted.transform(test).where("x IS NOT NULL OR c IS NOT NULL").count() == 0
    assert fitted.transform(test).columns == test.columns


def test_presence(spark):
    df = spark.createDataFrame([(0.0, "a"), (None, None), (2.0, "")], "x double, s string")
    assert [tuple(r) for r in df.select(present(df, "x"), present(df, "s")).collect()] == [(False, True), (False, False), (True, True)]


def test_average_precision_groups_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, p double")
    assert one(model.average_precision(df, "y", "p")) == pytest.approx((1 + 2 / 3) / 2)
    flat = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert one(model.average_precision(flat, "y", "p")) == pytest.approx(0.5)


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    got = model.confusion(df, "y", "p").first()
    assert (got["precision"], got["recall"], got["f1"], got["specificity"]) == (0, 0, 0, 1)


def test_label(spark):
    assert text.positive_label(["No", "Yes"]) == "Yes"
    assert text.positive_label(["0", "1"]) == "1"
    with pytest.raises(ValueError):
        text.positive_label(["a", "b", "c"])


def test_every_severity_is_reached(spark):
    train = spark.range(4000).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"), F.col("id").cast("double").alias("z"), F.lit("m").alias("month"))
    test = train.select(*[(F.col(c) + 4000 * s).alias(c) for c, s in (("x", 0.07), ("y", 0.15), ("z", 0.5))], "month")
    got = {r["column"]: r["drift_severity"] for r in detect.Detector({c: "numerical" for c in "xyz"}).detect(train, test).collect()}
    assert got["z"] == "SEVERE" and got["y"] == "MODERATE"


def test_date_rates_use_every_distinct_value(spark):
    n = 1501
    df = spark.range(n).select(F.when(F.col("id") % 5 < 4, F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")).otherwise(F.concat(F.lit("v"), "id")).alias("x"))
    dates = sum(k % 5 < 4 for k in range(n))
    assert one(profile.date_parse_rates(df, ["x"]).select("date_rate")) == pytest.approx(dates / n, abs=1e-12)
    twice = df.union(df)  # under the share of distinct values that makes a column metadata
    assert profile.manifest(profile.profile(twice)) == {"x": "time"}
    assert profile.manifest(profile.profile(twice.union(spark.createDataFrame([("w1",), ("w2",), ("w3",)], "x string")))) == {"x": "high_cardinality"}


# ---- what the reference's rules ask for where it is easy to be wrong ----
def test_l1_uses_the_shares_of_whole_tables(spark):
    """A category among one side's first is held against its share on the other side, however rare it is there."""
    from dataclasses import replace

    a, b = freq(spark, {"x": 0.5, "y": 0.3, "z": 0.2}), freq(spark, {"z": 0.5, "x": 0.3, "y": 0.2})
    assert one(drift.l1(a, b, replace(DEFAULT, l1_top=1)).select("l1")) == pytest.approx(0.2 + 0.3)  # x and z
    assert one(drift.l1(a, b, replace(DEFAULT, l1_top=3)).select("l1")) == pytest.approx(0.2 + 0.1 + 0.3)


def test_paired_tables_equal_two_tables(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), (None, 2), ("x", 3)], "c string, d int")
    b = spark.createDataFrame([("x", 1), ("z", 9)], "c string, d int")
    cols = ["feature", "category", "n_train", "n_test", "p", "q"]
    two = frequency.aligned(frequency.category_freq(a, ["c", "d"]), frequency.category_freq(b, ["c", "d"]))
    assert sorted(map(tuple, frequency.paired(a, b, ["c", "d"]).select(*cols).collect())) == sorted(map(tuple, two.select(*cols).collect()))
    empty = frequency.paired(a, b.where("false"), ["c"]).agg(F.sum("q"), F.sum("p")).first()
    assert tuple(empty) == (0.0, 1.0)


def test_chi_square_without_test_rows_ran_and_confirms_nothing(spark):
    got = drift.category_tests(frequency.paired(spark.range(100).select((F.col("id") % 2).cast("string").alias("c")), spark.range(20).select(F.lit("other").alias("c")), ["c"])).first()
    assert math.isnan(got["chi2"]) and got["cells"] == 2


def test_temporal_means(spark):
    train = spark.createDataFrame([("25-Jan", 1.0)] * 6 + [("25-Feb", 4.0), ("25-Feb", None), (None, 10.0)], "m string, x double")
    test = spark.createDataFrame([("25-May", 2.0)] * 3 + [("25-Jun", 8.0), ("25-Jul", None), (None, 5.0)], "m string, x double")
    got = months.temporal_means(train, test, ["x"], "m", ["25-Feb"]).first()
    assert got["full"] == pytest.approx(20 / 8)  # all rows, also those without a month
    assert got["near"] == 4 and got["then"] == pytest.approx((2 + 8 + 5) / 3)  # a month without values is skipped
    assert months.temporal_means(train, test, ["x"], "m", ["25-Dec"]).first()["near"] == got["full"]
    assert {r["month"]: r["mean"] for r in months.monthly_means(test, ["x"], "m").collect()} == {"25-May": 2, "25-Jun": 8, "25-Jul": 0, None: 5}


@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6)), max_size=60), st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0, 0.333]), min_size=1, max_size=3))
@settings(max_examples=15, deadline=None)
def test_exact_quantiles(spark, values, probs):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    got = profile.exact_quantiles(df, {"x": F.col("x")}, probs, {"n": F.count})["x"]
    known = [float(v) for v in values if v is not None]
    assert got[1] == [len(known)]
    assert got[0] is None if not known else got[0] == pytest.approx(np.quantile(known, probs).tolist())


def test_exact_quantiles_of_many_rows(spark):
    df = spark.range(200_000).select(((F.col("id") * 7919) % 200_003).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.lit(5.0)).otherwise(F.col("id")).cast("double").alias("y"), (F.col("id") % 7).alias("z"))
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = profile.exact_quantiles(df, {c: F.col(c).cast("double") for c in "xyz"}, probs)
    rows = df.toPandas()
    for c in "xyz":
        assert got[c][0] == pytest.approx(np.quantile(rows[c], probs).tolist())


def test_quantiles_where_the_sketch_is_of_no_use(spark, monkeypatch):
    """Brackets that miss their rank only cost another run."""
    real = F.percentile_approx
    monkeypatch.setattr(profile.F, "percentile_approx", lambda c, p, a: real(c, [0.9] * len(p), a))
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert profile.exact_quantiles(df, {"x": F.col("x")}, [0.1, 0.5])["x"][0] == pytest.approx([99.9, 499.5])


def test_large_brackets_are_cut_down(spark, monkeypatch):
    """10^7 distinct values, and a value that nearly all rows share beside many that they do not, with few values a task."""
    monkeypatch.setattr(profile, "BRACKET", 4000)
    n = 10_000_000
    df = spark.range(n).select((F.col("id") * 7919 % 10_000_019).cast("double").alias("x"))
    jobs = []
    real = profile._narrowed
    monkeypatch.setattr(profile, "_narrowed", lambda d, v, w, large: jobs.append(len(large)) or real(d, v, w, large))
    got = profile.exact_quantiles(df, {"x": F.col("x")}, [0.25, 0.5])["x"][0]
    values = np.sort(np.arange(n, dtype=np.int64) * 7919 % 10_000_019)
    assert got == pytest.approx(np.quantile(values, [0.25, 0.5]).tolist()) and jobs == [2]


@pytest.mark.parametrize("limit", [20, 300])
def test_narrowing_passes_ties(spark, monkeypatch, limit):
    monkeypatch.setattr(profile, "BRACKET", limit)
    monkeypatch.setattr(profile, "ACCURACY", 40)
    n = 60_000
    rng = np.random.default_rng(limit)
    tied = np.where(rng.random(n) < 0.9, 5.0, 5 + rng.random(n))
    twice = np.where(rng.random(n) < 0.45, 0.0, np.where(rng.random(n) < 0.8, 1.0, rng.random(n)))
    df = spark.createDataFrame(zip(tied.tolist(), twice.tolist(), rng.normal(size=n).round(2).tolist(), strict=True), "x double, y double, z double").repartition(4)
    probs = [0.0, 0.3, 0.5, 0.899, 0.95, 1.0]
    got = profile.exact_quantiles(df, {c: F.col(c) for c in "xyz"}, probs)
    rows = df.toPandas()
    for c in "xyz":
        assert got[c][0] == pytest.approx(np.quantile(rows[c], probs).tolist())


def test_date_shapes_let_all_dates_pass(spark):
    """What any format parses has its shape; shapes alone decide nothing."""
    from datetime import date, timedelta

    from tidemark.config import DATE_FORMATS

    days = [date(1, 1, 1), date(1999, 12, 31), date(2024, 2, 29), date(9999, 9, 9)] + [date(2000, 1, 1) + timedelta(days=37 * k) for k in range(40)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    said = df.select(F.explode(F.array(*[F.date_format("d", f) for f in DATE_FORMATS])).alias("t"))
    odd = ["+12345-01", "-2020-01", "2024-13", "31/31/2024", "99-Foo", "24-sep", "SEP-24", "20241", "20240101", "2024-1", " 2024-01", "2024-01 ", "1-URGENT", "", "x", "٢٠٢٤-٠١", "2024-01-01T00:00"]
    every = said.union(spark.createDataFrame([(t,) for t in odd], "t string"))
    plain = F.coalesce(*[F.try_to_date("t", f) for f in DATE_FORMATS]).isNotNull()
    rows = every.select("t", plain.alias("want"), text.parses_as_date(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows) and {r["got"] for r in rows} == {True, False}


def test_no_task_holds_a_column_for_its_quantiles(spark):
    import inspect

    assert "F.percentile(" not in inspect.getsource(profile) and "collect_list" not in inspect.getsource(profile)


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, 0.0, "a", None), (1, -0.0, "b", None), (2, 1.5, None, None), (None, float("nan"), "a", None)], "i int, d double, s string, v string")
    assert {r["feature"]: r["n_unique"] for r in profile.cardinality(df, df.columns).collect()} == {"i": 3, "d": 3, "s": 3, "v": 1}
    assert {r["n_unique"] for r in profile.cardinality(df.where("false"), df.columns).collect()} == {0}


@pytest.mark.parametrize("levels", [30, 1109])
def test_trees_take_any_number_of_levels(spark, levels):
    df = spark.range(4000).select(F.concat(F.lit("city "), (F.col("id") % levels).cast("string")).alias("city"), ((F.col("id") % levels) % 3 == 0).cast("int").alias("y"), (F.col("id") % 50).cast("double").alias("x"))
    fitted = model.fit(df, ["city", "x"], F.col("y"), trees=3, depth=3)
    scored = model.score(fitted, df.union(spark.createDataFrame([("never seen", 0, None)], df.schema)), ["city"])
    assert scored.count() == 4001 and scored.where("probability_score IS NULL OR probability_score NOT BETWEEN 0 AND 1").count() == 0
    assert bool(fitted.codes) == (levels > model.MOST_LEVELS)
    assert [r["rank"] for r in model.importance(fitted, spark).collect()] == [1, 2]


def test_columns_that_a_split_lacks_are_skipped_not_lost(spark):
    a, b = spark.range(50).select(F.col("id").cast("double").alias("x"), F.lit("m").alias("k")), spark.range(50).select(F.col("id").cast("double").alias("x"))
    got = {r["column"]: (r["test_method"], r["notes"]) for r in detect.Detector({"x": "numerical", "k": "categorical", "gone": "sparse"}).detect(a, b).collect()}
    assert got["k"] == got["gone"] == ("Skipped", "column absent in one dataset") and got["x"][0] == "Pre-Screen Only (fast)"


def test_a_failing_third_phase_is_noted(spark, monkeypatch):
    train = spark.range(200).select(F.col("id").cast("double").alias("x"), F.lit("25-Jan").alias("m"))
    test = train.select((F.col("x") + 500).alias("x"), "m")
    monkeypatch.setattr(months, "temporal_means", lambda *a: 1 / 0)
    got = detect.Detector({"x": "numerical"}, "m").detect(train, test).first()
    assert got["drift_severity"] == "SEVERE" and got["phase_c_notes"].startswith("phase C error")


def test_exact_ks_equals_a_count_of_paths():
    import itertools

    for n, m in ((3, 4), (5, 2), (4, 4)):
        gaps = []
        for chosen in itertools.combinations(range(n + m), n):
            i = j = 0
            worst = 0.0
            for k in range(n + m):
                i, j = (i + 1, j) if k in chosen else (i, j + 1)
                worst = max(worst, abs(i / n - j / m))
            gaps.append(worst)
        for d in sorted(set(gaps)):
            assert special.ks_two_sample(d, n, m) == pytest.approx(sum(g >= d - 1e-12 for g in gaps) / len(gaps))


def test_positive_label_of_the_score_view():
    assert text.positive_label_of_view(["No", "Yes"]) == "Yes" and text.positive_label_of_view(["stay", "leave"]) == "leave"


def test_scores_need_an_id(spark):
    a = spark.createDataFrame([(1, 0.5)], "k int, p double")
    with pytest.raises(ValueError, match="need the id"):
        model.joined_scores(a, a.drop("k"), "k")


def test_policies_do_not_multiply_rows_that_share_an_id(spark):
    raw = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 9.0)], "k int, x double")
    fitted = mitigate.Mitigator().fit(raw, raw, {"x": "numerical"})
    assert sorted(r["x"] for r in mitigate.apply_policy("delta", ["x"], raw, raw, fitted).collect()) == [-2.0, 0.0, 5.0]
    assert sorted(r["x"] for r in mitigate.apply_policy("none", ["x"], raw, raw, fitted).collect()) == [2.0, 4.0, 9.0]


def test_quantiles_scan_few_times(spark):
    """Three scans at most, however many ranks are wanted."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).select(F.col("id").cast("double").alias("x")).mapInArrow(watched, "x double")
    probs = [k / 64 for k in range(1, 64)]
    found, _ = profile.exact_quantiles(df, {"x": F.col("x")}, probs)["x"]
    assert found == pytest.approx([999 * p for p in probs]) and seen.value <= 3000


def test_distance_from_buckets_that_can_hold_it(spark):
    """Buckets whose bound is below the largest gap at an end are left out; the distance is that of all values, whatever their ties and gaps."""
    rng = random.Random(5)
    made = {
        "moved": ([rng.gauss(0, 1) for _ in range(3000)], [rng.gauss(0.7, 1) for _ in range(2000)]), "same": ([rng.random() for _ in range(2500)], [rng.random() for _ in range(2500)]),
        "ties": ([float(rng.randint(0, 3)) for _ in range(900)], [float(rng.randint(1, 4)) for _ in range(700)]), "apart": ([1.0, 2.0, 3.0], [4.0, 5.0]), "point": ([7.0] * 5, [7.0] * 9),
        "jump": ([k / 1000 for k in range(1000)], [0.5004] * 50),
    }
    rows = [(f, x, *n) for f, (a, b) in made.items() for x, n in ((x, (a.count(x), b.count(x))) for x in {*a, *b})]
    told = {r["feature"]: r for r in drift.ks_of(spark.createDataFrame(rows, "feature string, x double, a long, b long")).collect()}
    for f, (a, b) in made.items():
        gaps = [abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in {*a, *b}]
        assert told[f]["ks"] == pytest.approx(max(gaps), abs=1e-15) and (told[f]["n_train"], told[f]["n_test"]) == (len(a), len(b)), f


def test_one_sided_feature_has_no_distance(spark):
    rows = [("a", 1.0, 3, 0), ("a", 2.0, 1, 0)]
    assert [tuple(r) for r in drift.ks_of(spark.createDataFrame(rows, "feature string, x double, a long, b long")).collect()] == [("a", None, 4, 0)]


def test_texts_are_normalised_once(spark):
    """Rows are grouped as they are; the regular expressions see distinct texts only, and levels that they make equal are added up."""
    a = spark.createDataFrame([("A-b",), (" a B",), ("x",), (None,)], "c string")
    pair = frequency.paired(a, a.where("c IS NOT NULL"), ["c"])
    assert {r["category"]: (r["n_train"], r["n_test"]) for r in pair.collect()} == {"a b": (2, 2), "x": (1, 1), "__null__": (1, 0)}
    for df in (pair, frequency.category_freq(a, ["c"])):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()  # noqa: SLF001
        at = [k for k, x in enumerate(lines) if "Aggregate [feature" in x]
        assert len(at) == 2 and not any("regexp_replace" in x for x in lines[at[1] + 1 :])
