"""The downstream classifier and its scores."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions.scalars import number, numeric_columns, ratio, text_columns
from tidemark.functions.text import normalise
from tidemark.operators.cumulative import running_sums
from tidemark.operators.mitigate import with_codes
from tidemark.operators.profile import cardinality, exact_quantiles
from tidemark.sources.store import scratch, stored


def dead_columns(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns that are null throughout in either split: one aggregate each."""
    counts = [df.agg(*[F.count(F.col(c)).alias(f"c{k}") for k, c in enumerate(cols)]).first() for df in (train, test)]
    return [c for k, c in enumerate(cols) if not counts[0][k] or not counts[1][k]]


def prepared(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Text features normalised, numbers as doubles with null as -1e9 below all values (trees split it off)."""
    numbers, texts = numeric_columns(df, features), text_columns(df, features)
    out = {c: F.coalesce(number(F.col(c)), F.lit(-1e9)) for c in numbers} | {c: F.coalesce(normalise(F.col(c)), F.lit("")) for c in texts}
    out |= {c: F.coalesce(F.col(c).cast("double"), F.lit(-1e9)) for c in features if c not in numbers and c not in texts}
    return df.select(*[out.get(c, F.col(c)).alias(c) for c in [*features, *keep]])


#: Text features of up to so many levels are nominal to the trees; beyond, a level is the number of train rows that have it.
MOST_LEVELS, LEAST_BINS = 512, 64


@dataclass
class Trained:
    """Trees with what their inputs are made of. ``codes``: (level, code) of each text feature with too many levels to be nominal."""

    pipeline: PipelineModel
    features: list[str]
    codes: dict[str, DataFrame]

    def inputs(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        rows = prepared(df, self.features, keep)
        for c, codes in self.codes.items():
            rows = with_codes(rows, c, codes, 0.0)
        return rows

    def save(self, path: str, spark: SparkSession) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        for k, c in enumerate(self.codes):
            self.codes[c].write.mode("overwrite").parquet(f"{path}/codes-{k}")
        about = json.dumps({"features": self.features, "coded": list(self.codes)})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Trained:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        codes = {c: spark.read.parquet(f"{path}/codes-{k}") for k, c in enumerate(about["coded"])}
        return cls(PipelineModel.load(f"{path}/pipeline"), about["features"], codes)


def bin_edges(df: DataFrame, numbers: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Where each number column, none null, is cut into at most ``bins`` bins: midway between its values if there are no more of them, else behind its exact quantiles."""
    told = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"d{k}") for k, c in enumerate(numbers)]).first()
    out = {}
    for k, c in enumerate(numbers):
        if told[f"d{k}"] <= 2 * bins:  # few, so they may be listed
            values = sorted(r[0] for r in df.select(c).distinct().limit(4 * bins).collect())
            if len(values) <= bins:
                out[c] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    many = {c: F.col(c) for c in numbers if c not in out}
    if many:
        found = exact_quantiles(df, many, [k / bins for k in range(1, bins)])
        out |= {c: sorted({math.nextafter(x, math.inf) for x in found[c][0] or ()}) for c in many}  # values that are a quantile fall below the cut
    return out


def fit(train: DataFrame, features: Sequence[str], label: Column, trees: int = 20, depth: int = 5, most_levels: int = MOST_LEVELS) -> Trained:
    """Gradient-boosted trees, classes balanced by weight, seed 42; rows without a label are dropped.

    Text levels are indexed by frequency, levels beyond train's become a level of their own. A text feature with more than
    ``most_levels`` levels becomes a number, its level's rows in train (0 for unseen ones), so that neither the trees' bins nor the
    driver have to hold its levels.

    Trees see numbers by bins alone, here cut at all train rows' quantiles. Rows with the same bins, levels and label are the same to them,
    so they become one row with the sum of their weights: the trees' hundred scans or so are of a table that bins and levels bound.
    """
    rows = train.withColumn("tm_label__", label.cast("double")).where("tm_label__ IS NOT NULL")
    told = rows.agg(F.avg("tm_label__")).first()[0] or 0.0
    weight = F.when(F.col("tm_label__") == 1, 0.5 / max(told, 1e-9)).otherwise(0.5 / max(1 - told, 1e-9))
    keep = ["tm_label__", "tm_weight__"]
    ready = prepared(rows.withColumn("tm_weight__", weight), features, keep)
    texts = text_columns(ready, features)
    levels = {r["feature"]: r["n_unique"] for r in cardinality(ready, texts).collect()} if texts else {}
    spark, where = train.sparkSession, scratch(train.sparkSession)
    coded = lambda c: ready.groupBy(F.col(c).alias("level")).agg(F.count(F.lit(1)).cast("double").alias("code"))
    codes = {c: stored(spark, coded(c), f"{where}/codes-{k}") for k, c in enumerate(texts) if levels[c] > most_levels}
    texts = [c for c in texts if c not in codes]
    trained = Trained(None, list(features), codes)
    ready = stored(spark, trained.inputs(rows.withColumn("tm_weight__", weight), keep), f"{where}/inputs")  # encoded once, read by every job of the trees
    stages: list = []
    if texts:
        stages.append(StringIndexer(inputCols=texts, outputCols=[f"tm_ix_{c}" for c in texts], handleInvalid="keep").fit(ready))
    bins, numbers = max([LEAST_BINS, *(levels[c] + 2 for c in texts)]), [c for c in features if c not in texts]
    if numbers:
        cuts = [[-math.inf, *(e or [0.0]), math.inf] for e in map(bin_edges(ready, numbers, bins).get, numbers)]
        stages.append(Bucketizer(splitsArray=cuts, inputCols=numbers, outputCols=[f"tm_bin_{c}" for c in numbers]))
    binned = PipelineModel(stages).transform(ready)
    inputs = [f"tm_ix_{c}" if c in texts else f"tm_bin_{c}" for c in features]
    keys = [F.col(x) if x.startswith("tm_ix_") else (F.col(x) + 0.0).alias(x) for x in inputs]  # as numbers: a bucket's own metadata would make it nominal
    grouped = binned.groupBy(*keys, "tm_label__").agg(F.sum("tm_weight__").alias("tm_weight__"))
    grouped = stored(spark, grouped, f"{where}/grouped")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="tm_features__"))
    grower = GBTClassifier(featuresCol="tm_features__", labelCol="tm_label__", weightCol="tm_weight__", seed=42, maxIter=trees, maxDepth=depth, maxBins=bins)
    trained.pipeline = PipelineModel([*stages, grower.fit(stages[-1].transform(grouped))])
    return trained


def score(model: Trained, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(*keep, probability_score); kept columns may be features, their own values are kept."""
    held = [f"tm_keep_{k}__" for k in range(len(keep))]
    rows = df.withColumns({h: F.col(c) for h, c in zip(held, keep, strict=True)})
    done = model.pipeline.transform(model.inputs(rows, held))
    return done.select(*[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], vector_to_array("probability")[1].alias("probability_score"))


def importance(model: Trained, spark: SparkSession) -> DataFrame:
    """(rank, feature, importance), largest first: a row per feature."""
    gains = model.pipeline.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(model.features, gains, strict=True), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(k, f, float(g)) for k, (f, g) in enumerate(rows, 1)], "rank int, feature string, importance double")


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row (average_precision): the sum of recall steps times precision, equal scores together."""
    counts = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.lit("all").alias("feature"), F.col(p).cast("double").alias("x")).agg(
        F.sum(F.col(y).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n")
    )
    curve = running_sums(counts, ["tp", "n"], descending=True)
    total = counts.agg(F.sum("tp").alias("positives"))
    precision = F.col("cum_tp") / F.col("cum_n")
    return curve.join(F.broadcast(total)).agg(F.sum(F.try_divide(F.col("tp") * precision, F.col("positives"))).alias("average_precision"))


def confusion(df: DataFrame, y: str, p: str, threshold: float | None = None, config: Config = DEFAULT) -> DataFrame:
    """One row: the four cells and accuracy, precision, recall, f1, specificity; 0 where undefined."""
    return confusion_curve(df, y, p, [config.decision if threshold is None else threshold]).drop("threshold")


def confusion_curve(df: DataFrame, y: str, p: str, thresholds: Sequence[float]) -> DataFrame:
    """A row of cells and metrics for each threshold: scores are counted between neighbouring thresholds and added up, one pass for any number of them.

    Rows whose score is null are hits of no threshold and misses of none, those without a label count nowhere.
    """
    steps = sorted({float(t) for t in thresholds})
    x = F.col(p).cast("double")
    passed = reduce(lambda a, t: a + (x >= F.lit(t)).cast("int"), steps, F.lit(0))  # how many thresholds the score reaches
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    counts = rows.groupBy(passed.alias("k")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    grid = df.sparkSession.createDataFrame(list(enumerate([float("-inf"), *steps])), "k int, threshold double")
    full = F.broadcast(grid).join(counts, "k", "left").fillna(0, ["pos", "neg"])  # a row per threshold
    from_here = Window.partitionBy(F.lit(0)).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(c).over(from_here).alias(n) for c, n in (("pos", "tp"), ("neg", "fp"))] + [F.coalesce(F.sum(c).over(below), F.lit(0)).alias(n) for c, n in (("pos", "fn"), ("neg", "tn"))]
    cells = full.select("k", "threshold", *sums).where("k > 0").drop("k")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        "*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tn, tn + fp).alias("specificity"),
    )


#: The score view's slider: 0.10 to 0.90 in steps of a hundredth.
SWEEP = tuple(k / 100 for k in range(10, 91))


def classes(df: DataFrame, y: str) -> int:
    """Distinct labels; scores need two."""
    return df.agg(F.count_distinct(F.col(y))).first()[0]


def joined_scores(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Predictions with labels by id; without an id on both sides there is no safe order to join by."""
    if key not in predictions.columns or key not in labels.columns:
        raise ValueError(f"both sides need the id {key}")
    as_text = lambda df: df.withColumn(key, F.col(key).cast("string"))
    return as_text(predictions).join(as_text(labels), key)
