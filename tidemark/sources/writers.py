"""Sinks: predictions, models, drift results, rankings, importance and the run's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.mitigate import ACTUAL, ROUTES
from tidemark.operators.boost import Boosted
from tidemark.operators.model import Trained


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, quotes doubled; one file only for tables with a row per column or month."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"')


def predictions(scored: DataFrame, key: str) -> DataFrame:
    """(id as text, probability_score)."""
    return scored.select(F.col(key).cast("string").alias(key), "probability_score")


def drift_results(verdicts: DataFrame) -> DataFrame:
    """Drifted columns with the encoder that the mitigator uses, by column type."""
    pairs = F.create_map(*[F.lit(x) for kind, how in ROUTES.items() for x in (kind, ACTUAL[how])])
    return verdicts.where("drift_detected").select(
        F.col("column").alias("feature"), "feature_type", "drift_severity", F.col("test_method").alias("test_used"), "test_statistic",
        F.coalesce(F.try_element_at(pairs, F.lower("feature_type")), "mitigation").alias("mitigation"), "phase_c_segment_stable", "phase_c_drifted_months",
    )


def meta(spark: SparkSession, n_train: int, n_test: int, n_features: int, au_prc_train: float, runtime: float, au_prc_test: float | None = None) -> DataFrame:
    """One row of figures; au_prc_test only where the test split has labels."""
    out = {"n_train": n_train, "n_test": n_test, "n_features": n_features, "au_prc_train": round(au_prc_train, 6), "runtime_seconds": round(runtime, 2)}
    if au_prc_test is not None:
        out["au_prc_test"] = round(au_prc_test, 6)
    kinds = ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in out.items())
    return spark.createDataFrame([tuple(out.values())], kinds)


def save_model(model: Trained | Boosted, path: str, spark: SparkSession) -> None:
    """What ``load`` of the model's class reads again."""
    model.save(path, spark)


def export(folder: str, verdicts: DataFrame, ranked: DataFrame, figures: DataFrame, importance: DataFrame | None = None, scored: DataFrame | None = None) -> None:
    """All outputs of a run below one folder."""
    write_csv(drift_results(verdicts), f"{folder}/drift_results.csv", one_file=True)
    write_csv(ranked, f"{folder}/ranked_features.csv", one_file=True)
    if importance is not None:
        write_csv(importance, f"{folder}/feature_importance.csv", one_file=True)
    if scored is not None:
        write_csv(scored, f"{folder}/prediction.csv")
    figures.coalesce(1).write.mode("overwrite").json(f"{folder}/pipeline_meta.json")
