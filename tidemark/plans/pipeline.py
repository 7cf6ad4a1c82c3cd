"""The whole run: ingest, classify, detect, rank, mitigate, train, score, export; also from the command line."""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions.text import positive_label
from tidemark.operators import boost, detect, mitigate, model, profile, rank, views
from tidemark.plans import report
from tidemark.sources import readers, writers
from tidemark.sources.store import scratch, stored


@dataclass
class Run:
    """What a run found."""

    verdicts: DataFrame
    ranked: DataFrame
    importance: DataFrame
    scored: DataFrame
    au_prc_train: float
    au_prc_test: float | None
    meta: DataFrame
    cells: DataFrame | None
    chosen: list[str]


def run(
    spark: SparkSession, train: DataFrame, test: DataFrame, key: str = "CustomerID", month: str = "Month", target: str = "ChurnStatus",
    policy: str = "binning", config: Config = DEFAULT, out: str | None = None, learner: str = "histogram",
) -> Run:
    """All stages on two aligned splits; results go to ``out`` where one is given.

    ``learner``: "histogram" are the package's own boosted trees (missing values learn a direction, any number of levels), "spark" those of Spark.
    """
    began = time.time()
    profiles = profile.profile(train, {key: "metadata", month: "time", target: "target"}, config)
    types = profile.manifest(profiles)
    verdicts = detect.Detector(types, month, config).detect(train, test)
    labels = [r[0] for r in train.where(F.col(target).isNotNull()).select(F.col(target).cast("string")).distinct().limit(3).collect()]
    label = positive_label(labels)
    ranked = rank.rank_drift(detect.rank_input(verdicts), test, month, config).persist()  # a row per drifted column, read again and again
    drifted = {r["feature"]: r["col_type"] for r in ranked.collect()}
    fitted = mitigate.Mitigator(target, label, config).fit(train, test, drifted)
    chosen = mitigate.policy_features(ranked)
    a, b = (mitigate.apply_policy(policy, chosen, train, raw, fitted) for raw in (train, test))
    tested = [c for c in profile.of_type(types, "numerical", "categorical", "high_cardinality", "sparse") if c in a.columns and c in b.columns]
    gone = model.dead_columns(a, b, tested)
    features = [c for c in tested if c not in gone]
    y = mitigate.positive(F.col(target), label)
    trees = {"histogram": boost, "spark": model}[learner]
    fit, folder = trees.fit(a, features, y), scratch(spark)
    label_ = "tm_y__"
    # each split is scored once
    of_train, of_test = (stored(spark, trees.score(fit, df.withColumn(label_, y_), keep), f"{folder}/{n}") for n, df, y_, keep in (
        ("train", a, y, [label_]), ("test", b, y if target in b.columns else F.lit(None).cast("int"), [key, label_]),
    ))
    prc = lambda scores: model.average_precision(scores, label_, "probability_score").first()[0] or 0.0
    train_prc = prc(of_train)
    labelled = target in b.columns and model.classes(b, target) >= 2
    test_prc = prc(of_test) if labelled else None
    cells = model.confusion(of_test, label_, "probability_score", config=config) if labelled else None
    scored = writers.predictions(of_test, key)
    figures = writers.meta(spark, train.count(), test.count(), views.feature_count(types), train_prc, time.time() - began, test_prc)
    importance = trees.importance(fit, spark)
    if out:
        writers.export(out, verdicts, ranked, figures, importance, scored)
        writers.save_model(fit, f"{out}/model", spark)
    return Run(verdicts, ranked, importance, scored, train_prc, test_prc, figures, cells, chosen)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Find, explain and repair drift between two CSV files, then train and score.")
    parser.add_argument("--train", required=True)
    parser.add_argument("--test", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--learner", choices=("histogram", "spark"), default="histogram")
    parser.add_argument("--policy", choices=("binning", "robust", "none", "delta"), default="binning")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    began, folder = time.time(), scratch(spark)
    both = (stored(spark, df, f"{folder}/{n}") for n, df in zip(("train", "test"), readers.ingest(spark, args.train, args.test), strict=True))
    done = run(spark, *both, policy=args.policy, out=args.out, learner=args.learner)
    tables = (
        report.drift_summary(done.verdicts), done.ranked, report.policy_summary(spark, args.policy, done.chosen), report.score_table(spark, done.au_prc_train, done.au_prc_test),
        done.cells, done.importance, done.meta, report.runtime(spark, time.time() - began),
    )
    for shown in tables:
        if shown is not None:
            shown.show(1000, truncate=False)


if __name__ == "__main__":
    main()
