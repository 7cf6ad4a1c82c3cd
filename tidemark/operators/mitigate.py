"""Encoders that take drift out of features, all fitted on train alone and applied as column expressions and small joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions.scalars import cut, is_numeric, number, present
from tidemark.functions.text import level, normalise
from tidemark.operators.profile import both_quantiles, quantiles

#: Encoder by column type; the names on the left are also accepted as aliases.
ROUTES = {
    "high_cardinality": "frequency", "high_card_cat": "frequency", "categorical": "target", "low_card_cat": "target",
    "numerical": "quantile_bin", "continuous": "quantile_bin", "sparse": "binarise",
}
#: What result files call each encoder.
ACTUAL = {"frequency": "frequency_encoding", "target": "target_encoding", "quantile_bin": "quantile_binning", "binarise": "binarise (sparse->binary)"}


def positive(target: Column, label: str) -> Column:
    """1 for the positive label, 0 for others, null for null; numbers compare as text."""
    return (target.cast("string") == F.lit(label)).cast("int")


def global_rate(train: DataFrame, target: str, label: str) -> float:
    return train.agg(F.avg(positive(F.col(target), label))).first()[0] or 0.0


def frequency_codes(train: DataFrame, col: str) -> DataFrame:
    """(level, code): train rows of each normalised category, null a level."""
    return train.groupBy(level(F.col(col)).alias("level")).agg(F.count(F.lit(1)).alias("code"))


def target_codes(train: DataFrame, col: str, target: str, label: str, rate: float, config: Config = DEFAULT) -> DataFrame:
    """(level, code): smoothed target rate; n counts rows with a null target, the mean does not."""
    y = positive(F.col(target), label)
    told = train.groupBy(level(F.col(col)).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"))
    m = config.laplace_m
    return told.select("level", ((F.col("n") * F.coalesce("mean", F.lit(rate)) + m * rate) / (F.col("n") + m)).alias("code"))


def with_codes(df: DataFrame, col: str, codes: DataFrame, default: float | int) -> DataFrame:
    """``col`` replaced by its code, unseen levels by ``default``. Spark broadcasts the codes if they are small."""
    kind = codes.schema["code"].dataType
    named = codes.select(F.col("level").alias("tm_level__"), F.col("code").alias("tm_code__"))
    joined = df.join(named, level(F.col(col)) == F.col("tm_level__"), "left")
    return joined.withColumn(col, F.coalesce("tm_code__", F.lit(default).cast(kind))).select(df.columns)


def distinct_breaks(deciles: Sequence[float] | None) -> list[float]:
    return sorted({x for x in deciles or () if x is not None})


def quantile_bin(x: Column, breaks: Sequence[float]) -> Column:
    """Ordinal of a right-closed bin, null in bin 0; fewer than two breaks leave the value alone."""
    return cut(number(x), F.array(*map(F.lit, breaks))).cast("tinyint") if len(breaks) >= 2 else x


def unseen_rates(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, rate): share of test rows whose level does not occur among train's non-null levels; test nulls never do."""
    from tidemark.operators.frequency import category_freq, long_form

    known = long_form(train, cols).select("feature", normalise(F.col("category")).alias("category")).where("category IS NOT NULL").distinct()
    unseen = category_freq(test, cols).join(known, ["feature", "category"], "left_anti").groupBy("feature").agg(F.sum("freq").alias("rate"))
    every = train.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return F.broadcast(every).join(unseen, "feature", "left").fillna(0.0)


def iqr_collapse(train: DataFrame, test: DataFrame, cols: Sequence[str], config: Config = DEFAULT) -> DataFrame:
    """(feature, iqr_train, iqr_test, collapsed)."""
    width = lambda q: F.col(q)[1] - F.col(q)[0]
    both = both_quantiles(train, test, cols, [0.25, 0.75]).select("feature", width("a_q").alias("iqr_train"), width("b_q").alias("iqr_test"))
    gone = (F.col("iqr_train") > config.prune_iqr_min) & (F.col("iqr_test") < config.prune_iqr_ratio * F.col("iqr_train"))
    return both.withColumn("collapsed", F.coalesce(gone, F.lit(False)))


def robust_scale(x: Column, median: float, iqr: float) -> Column:
    return (number(x) - median) / iqr if iqr >= 1e-9 else x


@dataclass
class Fitted:
    """What the fit knows of each feature: its encoder, or that it is pruned, and the small parameters."""

    route: dict[str, str] = field(default_factory=dict)
    pruned: list[str] = field(default_factory=list)
    breaks: dict[str, list[float]] = field(default_factory=dict)
    codes: dict[str, DataFrame] = field(default_factory=dict)
    rate: float = 0.0
    warnings: list[str] = field(default_factory=list)
    numeric: set[str] = field(default_factory=set)

    def transform(self, df: DataFrame, instead: dict[str, Column] | None = None) -> DataFrame:
        """One projection for all expressions, a join for each coded feature; column order stays. ``instead`` overrides features, pruned ones too."""
        out = dict(instead or {})
        for c, how in self.route.items():
            if c not in df.columns or c in out:
                continue
            if c in self.pruned:
                out[c] = F.lit(None).cast(df.schema[c].dataType)
            elif how == "quantile_bin":
                out[c] = quantile_bin(F.col(c), self.breaks.get(c, []))
            elif how == "binarise":
                out[c] = present(df, c).cast("tinyint")
        done = df.withColumns(out) if out else df
        for c, codes in self.codes.items():
            if c not in self.pruned and c in df.columns and c not in (instead or {}):
                done = with_codes(done, c, codes, 0 if self.route[c] == "frequency" else self.rate)
        return done.select(df.columns)


@dataclass
class Mitigator:
    """fit(train, test, types of the drifted features): routes by column type, not by the detector's suggestion."""

    target: str | None = None
    label: str = "Yes"
    config: Config = field(default_factory=lambda: DEFAULT)

    def fit(self, train: DataFrame, test: DataFrame, types: dict[str, str]) -> Fitted:
        c = self.config
        out = Fitted()
        for name, kind in types.items():
            if name not in train.columns or name not in test.columns:
                out.warnings.append(f"{name}: not in both splits")
            elif kind.lower() not in ROUTES:
                out.warnings.append(f"{name}: no encoder for {kind}")
            else:
                out.route[name] = ROUTES[kind.lower()]
        of = lambda *hows: [n for n, h in out.route.items() if h in hows]
        if coded := of("frequency", "target"):
            out.pruned += [r["feature"] for r in unseen_rates(train, test, coded).where(F.col("rate") > c.prune_unseen).collect()]
        if binned := of("quantile_bin"):
            out.pruned += [r["feature"] for r in iqr_collapse(train, test, binned, c).where("collapsed").collect()]
            probs = [k / c.bins for k in range(1, c.bins)]
            out.breaks = {r["feature"]: distinct_breaks(r["q"]) for r in quantiles(train, binned, probs).collect()}
        if self.target and self.target in train.columns:
            out.rate = global_rate(train, self.target, self.label)
        for name in coded if coded else []:
            if out.route[name] == "frequency":
                out.codes[name] = frequency_codes(train, name)
            elif self.target:
                out.codes[name] = target_codes(train, name, self.target, self.label, out.rate, c)
        out.numeric = {n for n in out.route if is_numeric(train, n)}
        return out


def policy_features(ranked: DataFrame) -> list[str]:
    """Numerical features whose drift is mild or moderate."""
    kind, sev = F.lower("col_type").isin("numerical", "continuous"), F.upper("drift_severity").isin("MILD", "MODERATE")
    return [r["feature"] for r in ranked.where(kind & sev).select("feature").collect()]


def policy_columns(policy: str, features: Sequence[str], raw_train: DataFrame) -> dict[str, Column]:
    """What stands in for the encoders of these features: nothing under ``binning`` and ``robust``, raw values under ``none``, the distance from train's median under ``delta``."""
    if policy in ("binning", "robust") or not features:
        return {}
    if policy not in ("none", "delta"):
        raise ValueError(f"unknown policy {policy}")
    if policy == "none":
        return {f: F.col(f) for f in features}
    middle = {r["feature"]: (r["q"] or [0.0])[0] for r in quantiles(raw_train, features, [0.5]).collect()}
    return {f: number(F.col(f)) - middle[f] for f in features}


def apply_policy(policy: str, features: Sequence[str], raw_train: DataFrame, raw: DataFrame, fitted: Fitted) -> DataFrame:
    """``raw`` encoded, with the policy's overrides of these features: an expression each, no join, so that repeated ids do no harm."""
    return fitted.transform(raw, policy_columns(policy, features, raw_train))
