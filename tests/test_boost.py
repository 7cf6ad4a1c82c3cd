"""The boosted trees: splits against all splits tried one by one, missing and unseen values, many levels, quality beside Spark's trees."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import boost, model


def rows_of(seed, n=600):
    rng = random.Random(seed)
    for k in range(n):
        x = None if rng.random() < 0.2 else round(rng.gauss(0, 1), 2)
        c = None if rng.random() < 0.1 else rng.choice(["a", "b", "c", "d-e", "D_E", "f"])
        z = rng.randrange(5)
        y = int(rng.random() < (0.8 if x is None or x > 0.5 else 0.3) * (0.4 if c in ("a", "f") else 1) * (1 if z else 0.5))
        yield k, x, c, float(z), y


def slow_split(rows, w, features, texts):
    """The best split by trying every prefix of every order; (gain, feature, left set of bins, missing_left)."""
    best = None
    score = lambda g, h: g * g / (h + boost.PENALTY)
    for f in range(features):
        bins: dict = {}
        for bins_, y in rows:
            g, h = w[y] * (0.5 - y), w[y] * 0.25
            s = bins.setdefault(bins_[f], [0.0, 0.0, 0])
            s[0], s[1], s[2] = s[0] + g, s[1] + h, s[2] + 1
        miss = bins.pop(None, [0.0, 0.0, 0])
        total = [sum(s[k] for s in bins.values()) + miss[k] for k in range(3)]
        order = sorted(bins, key=lambda b: (bins[b][0] / (bins[b][1] + boost.SMOOTH), b) if f in texts else b)
        for at in range(1, len(order) + 1):
            for missing_left in (False, True) if miss[2] else (False,):
                left = [sum(bins[b][k] for b in order[:at]) + (miss[k] if missing_left else 0) for k in range(3)]
                right = [t - x for t, x in zip(total, left, strict=True)]
                if min(left[2], right[2]) < boost.LEAST_ROWS or min(left[1], right[1]) < boost.LEAST_CURVE:
                    continue
                gain = score(*left[:2]) + score(*right[:2]) - score(*total[:2])
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, set(order[:at]), missing_left)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_first_split_against_all_splits(spark, seed):
    df = spark.createDataFrame(list(rows_of(seed)), "id long, x double, c string, z double, y int")
    grown = boost.fit(df, ["x", "c", "z"], F.col("y"), trees=1, depth=1, bins=16)
    rows = [(r["b"], r["y"]) for r in df.select(grown.bins().alias("b"), "y").collect()]
    share = sum(y for _, y in rows) / len(rows)
    gain, f, left, missing_left = slow_split(rows, {1: 0.5 / share, 0: 0.5 / (1 - share)}, 3, {1})
    s = grown.trees[0].splits[1]
    goes = {r["id"] for r in df.select("id", grown.bins().alias("bins")).where(F.expr(s.sql())).collect()}
    want = {i for i, (b, _) in enumerate(rows) if (missing_left if b[f] is None else b[f] in left)}
    assert s.feature == f and s.gain == pytest.approx(gain) and goes == want


def test_missing_unseen_and_many_levels(spark):
    """A third of the rows miss the number, which tells; each of 3,000 levels has one or two rows; a level that train lacks goes with the others."""
    rng = random.Random(4)
    data = [(None if k % 3 == 0 else rng.random(), f"level {k // 2}", int(k % 3 == 0) if rng.random() < 0.9 else int(k % 3 != 0)) for k in range(6000)]
    df = spark.createDataFrame(data, "x double, c string, y int").repartition(3)
    grown = boost.fit(df, ["x", "c"], F.col("y"), trees=2, depth=2)
    assert grown.trees[0].splits[1].feature == 0
    told = {r["x"] is None: r["p"] for r in boost.score(grown, df, ["x"]).groupBy("x").agg(F.avg("probability_score").alias("p")).collect()}
    assert told[True] > 0.52 > 0.5 > told[False]
    assert all(len(s.levels) <= boost.LISTED for t in grown.trees for s in t.splits.values())
    new = spark.createDataFrame([(None, "never seen"), (0.5, None), (float("nan"), "")], "x double, c string")
    p = [r["probability_score"] for r in boost.score(grown, new, ["c"]).collect()]
    assert p[0] > 0.5 > p[1] and p[2] > 0.5


def test_levels_tell_where_numbers_do_not(spark):
    rng = random.Random(5)
    good = {f"l{k}" for k in range(0, 100, 2)}
    data = [(rng.random(), c, int(c in good)) for c in (f"l{rng.randrange(100)}" for _ in range(8000))]
    grown = boost.fit(spark.createDataFrame(data, "x double, c string, y int"), ["x", "c"], F.col("y"), trees=6, depth=2, rate=0.5)
    df = spark.createDataFrame(data[:500], "x double, c string, y int")
    scored = boost.score(grown, df, ["c"]).collect()
    assert sum((r["probability_score"] > 0.5) == (r["c"] in good) for r in scored) > 0.97 * len(scored)


def test_a_saved_model_scores_alike(spark, tmp_path):
    df = spark.createDataFrame(list(rows_of(7)), "id long, x double, c string, z double, y int")
    grown = boost.fit(df, ["x", "c", "z"], F.col("y"), trees=2, depth=2)
    grown.save(str(tmp_path / "m"), spark)
    again = boost.Boosted.load(str(tmp_path / "m"), spark)
    assert again == grown
    same = lambda m: {r["id"]: r["probability_score"] for r in boost.score(m, df, ["id"]).collect()}
    assert same(again) == same(grown)
    gains = boost.importance(grown, spark).collect()
    assert sum(r["importance"] for r in gains) == pytest.approx(1) and [r["rank"] for r in gains] == [1, 2, 3]


def test_labels_of_one_class_few_rows_and_none(spark):
    df = spark.createDataFrame([(1.0, "a", 1)] * 50, "x double, c string, y int")
    assert not boost.fit(df, ["x", "c"], F.col("y")).trees
    assert [r["probability_score"] for r in boost.score(boost.fit(df.where("false"), ["x", "c"], F.col("y")), df.limit(2), ["x"]).collect()] == [0.5, 0.5]


def test_quality_beside_sparks_trees(spark):
    """Average precision on rows that neither learned from is no worse than that of Spark's trees of the same size."""
    rows = list(rows_of(21, 6000))
    a, b = (spark.createDataFrame(part, "id long, x double, c string, z double, y int") for part in (rows[:4000], rows[4000:]))
    names = ["x", "c", "z"]
    ours = boost.score(boost.fit(a, names, F.col("y"), trees=12, depth=3, rate=0.3), b, ["y"])  # their first tree counts whole
    theirs = model.score(model.fit(a, names, F.col("y"), trees=12, depth=3), b, ["y"])
    ap = [model.average_precision(s, "y", "probability_score").first()[0] for s in (ours, theirs)]
    assert ap[0] > ap[1] - 0.01 and not math.isnan(ap[0])


def test_sparks_trees_load_again(spark, tmp_path):
    """With coded levels (more than the bound) and without."""
    df = spark.createDataFrame(list(rows_of(9, 200)), "id long, x double, c string, z double, y int")
    for most in (2, 512):
        fit = model.fit(df, ["x", "c", "z"], F.col("y"), trees=2, depth=2, most_levels=most)
        fit.save(str(tmp_path / f"m{most}"), spark)
        again = model.Trained.load(str(tmp_path / f"m{most}"), spark)
        assert bool(again.codes) == (most == 2)
        same = lambda m: {r["id"]: r["probability_score"] for r in model.score(m, df, ["id"]).collect()}
        assert same(again) == same(fit)


def test_a_level_needs_one_job_with_the_levels_listed(spark):
    """The split of a text comes with the levels on its shorter end; tables of sums are not kept for a second look."""
    hist = spark.createDataFrame([(1, 0, k, float(k - 50), 30.0, 30) for k in range(100)], "node int, f int, bin long, g double, h double, n long")
    best = {r["node"]: r for r in boost.best_splits(hist, [0]).collect()}[1]
    order = sorted(range(100), key=lambda k: (k - 50) / 40)
    at = best["at"]
    assert at <= boost.LISTED or best["m"] - at <= boost.LISTED
    assert sorted(best["listed"]) == sorted(order[:at] if at <= boost.LISTED else order[at:])
    assert boost.best_splits(hist, []).first()["listed"] is None


def test_sparks_trees_grow_on_groups_of_rows(spark, monkeypatch):
    """Rows with the same bins, levels and label are one row to the trees, and these are the trees that Spark grows on all rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    seen, grow = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df: seen.append(df.count()) or grow(self, df))
    rng = random.Random(2)
    rows = [(k, float(rng.randint(0, 12)), rng.choice("abcd"), rng.random()) for k in range(3000)]
    df = spark.createDataFrame([(k, x, c, int((x > 5) ^ (c == "a") if r > 0.2 else r < 0.1)) for k, x, c, r in rows], "id long, x double, c string, y int")
    mine = {r["id"]: r["probability_score"] for r in model.score(model.fit(df, ["x", "c"], F.col("y"), trees=4, depth=3), df, ["id"]).collect()}
    assert seen == [df.select("x", "c", "y").distinct().count()]
    share = df.agg(F.avg("y")).first()[0]
    ready = df.withColumn("w", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    ready = VectorAssembler(inputCols=["x", "i"], outputCol="v").transform(StringIndexer(inputCol="c", outputCol="i", handleInvalid="keep").fit(ready).transform(ready))
    own = grow(GBTClassifier(featuresCol="v", labelCol="y", weightCol="w", seed=42, maxIter=4, maxDepth=3, maxBins=64), ready).transform(ready)
    theirs = {r["id"]: r["p"] for r in own.select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert all(abs(mine[k] - theirs[k]) < 1e-9 for k in theirs) and len(set(mine.values())) > 5


def test_numbers_with_many_values_are_cut_at_all_rows_quantiles(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(0.0).alias("s"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("one"))
    edges = model.bin_edges(df, ["s", "x", "one"], 64)
    assert edges["one"] == [] and len(edges["x"]) == 63 and all(abs(e - 99_999 * k / 64) < 1e-6 for k, e in enumerate(edges["x"], 1))
    assert 0 < edges["s"][0] < 1e-300 and 4 <= len(edges["s"]) <= 8  # zeros are a bin of their own


def test_of_a_text_with_many_levels_only_the_ends_are_searched(spark, monkeypatch):
    """Two texts of thousands of levels, one with a level of a third of the rows, and many equal ones: the trees are those of a search through all levels."""
    rng = random.Random(6)
    a, b = ["most", *(f"a{k}" for k in range(4000))], [f"b{k}" for k in range(2500)]
    odd = {x for x in [*a, *b] if rng.random() < 0.1}
    data = []
    for _ in range(8000):
        x, y, z = rng.choice([a[0], rng.choice(a), rng.choice(a[:60]), None]), rng.choice([rng.choice(b), rng.choice(b[:90])]), rng.random()
        data.append((z, x, y, int(rng.random() < 0.2 + 0.4 * (x in odd) + 0.2 * (y in odd) + 0.1 * (z > 0.7))))
    df = spark.createDataFrame(data, "z double, a string, b string, y int")
    searched, search = [], boost.best_splits
    monkeypatch.setattr(boost, "best_splits", lambda hist, texts: searched.append(hist.groupBy("node", "f").count().agg(F.max("count")).first()[0]) or search(hist, texts))
    grow = lambda: boost.fit(df, ["z", "a", "b"], F.col("y"), trees=2, depth=3, bins=16)
    monkeypatch.setattr(boost, "TASK_ROWS", 2000)
    cut = grow()
    assert len(searched) == 6 and max(searched) <= 5 * (2 * boost.LISTED + 3)
    monkeypatch.setattr(boost, "WIDE", 1 << 40)
    whole = grow()
    assert max(searched) > 1500
    told = lambda m: [(k, s.feature, s.upto, s.levels, s.listed_left, s.missing_left) for t in m.trees for k, s in sorted(t.splits.items())]
    assert told(cut) == told(whole) and {1, 2} <= {s.feature for t in cut.trees for s in t.splits.values()}
    assert [v for t in cut.trees for v in t.values.values()] == pytest.approx([v for t in whole.trees for v in t.values.values()])


def test_scores_follow_the_splits_as_sql(spark):
    """Values that are breaks, beyond all, no numbers or missing, and levels that train lacks."""
    grown = boost.fit(spark.createDataFrame(list(rows_of(11)), "id long, x double, c string, z double, y int"), ["x", "c", "z"], F.col("y"), trees=3, depth=3, bins=8)
    xs = [*grown.breaks["x"], *(math.nextafter(b, s * math.inf) for b in grown.breaks["x"] for s in (-1, 1)), math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(k, x, c, z) for k, (x, c, z) in enumerate((x, c, z) for x in xs for c in ("A", "d_e", "new", None) for z in (0.0, 3.0, None))], "id long, x double, c string, z double")
    value = lambda t, k: f"CASE WHEN {t.splits[k].sql()} THEN {value(t, 2 * k)} ELSE {value(t, 2 * k + 1)} END" if k in t.splits else f"{t.values[k]!r}D"
    margin = " + ".join(value(t, 1) for t in grown.trees)
    want = {r["id"]: r["m"] for r in df.select("id", grown.bins().alias("bins")).selectExpr("id", f"{margin} AS m").collect()}
    got = {r["id"]: r["probability_score"] for r in boost.score(grown, df, ["id"]).collect()}
    assert len(set(want.values())) > 5 and all(got[k] == pytest.approx(1 / (1 + math.exp(-m)), abs=1e-12) for k, m in want.items())
