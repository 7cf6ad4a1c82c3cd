"""The detector: a cheap pre-screen of all columns, exact tests of the flagged ones, then months and sub-populations.

Each phase is a few jobs over all columns of a kind at once; between phases the driver holds one small row per column. The categories of
both splits are counted once, in one persisted table of (feature, category) that every categorical statistic comes from.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from dataclasses import fields as fields_of

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, JS_TEST, KS_TEST, PRESCREENED, PSI_TEST, SKIPPED, STABLE, UNTREATED, Z_TEST, Config
from tidemark.functions.scalars import is_numeric, severity_of
from tidemark.functions.special import chi2_upper, ks_two_sample, normal_two_sided
from tidemark.operators import drift, months
from tidemark.operators.frequency import category_freq, paired, top_other_of
from tidemark.operators.profile import of_type

_log = logging.getLogger(__name__)

EXCLUDED = ("metadata", "constant", "time", "target", "unsupported")
LEVELS = ("NONE", "MILD", "MODERATE", "SEVERE")
#: What the detector suggests for a drifted column of each type; the mitigator routes by type on its own.
SUGGESTED = {"numerical": "quantile_binning", "categorical": "frequency_encoding", "high_cardinality": "drop_feature", "sparse": "binarise (sparse->binary)"}
VERDICT = (
    "column string, feature_type string, prescreen_score double, prescreen_flagged boolean, test_method string, test_statistic double, drift_detected boolean,"
    " drift_severity string, mitigation string, notes string, phase_c_drift_detected boolean, phase_c_drift_is_temporal boolean, phase_c_notes string,"
    " phase_c_segment_stable boolean, phase_c_drifted_months string, p_value double, inner_p_value double"
)


@dataclass
class Verdict:
    """One column's result, in the order of ``VERDICT``."""

    column: str
    feature_type: str
    prescreen_score: float = 0.0
    prescreen_flagged: bool = False
    test_method: str = PRESCREENED
    test_statistic: float | None = None
    drift_detected: bool = False
    drift_severity: str = "NONE"
    mitigation: str = STABLE
    notes: str = ""
    phase_c_drift_detected: bool = False
    phase_c_drift_is_temporal: bool = False
    phase_c_notes: str = ""
    phase_c_segment_stable: bool | None = None
    phase_c_drifted_months: str = ""
    #: Of the test named; of a sparse column's values that are not zero.
    p_value: float | None = None
    inner_p_value: float | None = None

    def settle(self, method: str, statistic: float | None, confirmed: bool, level: str, note: str) -> None:
        self.test_method, self.test_statistic, self.notes = method, statistic, note
        self.drift_detected = confirmed
        self.drift_severity = level if confirmed else "NONE"
        self.mitigation = SUGGESTED.get(self.feature_type, "none") if confirmed else STABLE

    def skip(self, why: str, mitigation: str = "none") -> None:
        self.test_method, self.mitigation, self.notes = SKIPPED, mitigation, why


def gathered(jobs: dict[str, DataFrame]) -> dict[str, list]:
    """Rows of several small results (a row per column), their jobs running side by side."""
    if not jobs:
        return {}
    with ThreadPoolExecutor(len(jobs)) as pool:
        return dict(zip(jobs, pool.map(lambda df: df.collect(), jobs.values()), strict=True))


@dataclass
class Detector:
    """detect(train, test) for columns of known types, a month column where there is one."""

    types: dict[str, str]
    month: str | None = None
    config: Config = field(default_factory=lambda: DEFAULT)

    def detect(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """Verdicts in ``VERDICT``'s schema, one row per column that has a type; those that can't be tested say so."""
        found = {c: Verdict(c, t) for c, t in self.types.items()}
        for c, v in found.items():
            if v.feature_type in EXCLUDED:
                v.skip("excluded feature type" if v.feature_type != "unsupported" else "unhandled type", UNTREATED if v.feature_type != "unsupported" else "none")
            elif c not in train.columns or c not in test.columns:
                v.skip("column absent in one dataset")
        live = {c: v for c, v in found.items() if v.test_method != SKIPPED}
        words = self._names(live, "categorical", "high_cardinality") + [c for c in self._names(live, "sparse") if not is_numeric(train, c)]
        pair = paired(train, test, words).persist() if words else None
        try:
            self._prescreen(train, test, live, pair)
            flagged = {c: v for c, v in live.items() if v.prescreen_flagged}
            if flagged:
                told = self._test(train, test, flagged, pair)
                if self.month and self.month in train.columns and self.month in test.columns:
                    try:
                        self._months(train, test, flagged, told)
                        self._subpopulations(flagged, told)
                    except Exception as e:  # the third phase only explains: its failure is noted, the verdicts stay
                        _log.exception("the checks of months and sub-populations failed")
                        for v in flagged.values():
                            v.phase_c_notes = f"phase C error: {e}".splitlines()[0]
        finally:
            if pair is not None:
                pair.unpersist()
        return train.sparkSession.createDataFrame([tuple(asdict(v).values()) for v in found.values()], VERDICT)

    def _names(self, found: dict[str, Verdict], *types: str) -> list[str]:
        return [c for c in of_type(self.types, *types) if c in found]

    def _prescreen(self, train: DataFrame, test: DataFrame, found: dict[str, Verdict], pair: DataFrame | None) -> None:
        c = self.config
        jobs = {}
        if cols := self._names(found, "categorical", "high_cardinality"):
            jobs["categories"] = drift.category_prescreen(pair.where(F.col("feature").isin(*cols)), c)
        if cols := self._names(found, "sparse"):
            jobs["sparse"] = drift.sparse_prescreen(train, test, cols, c)
        if cols := self._names(found, "numerical"):
            jobs["numbers"] = drift.numeric_prescreen(train, test, cols, c)
        for rows in gathered(jobs).values():
            for row in rows:
                v = found[row["feature"]]
                v.prescreen_score, v.prescreen_flagged, v.notes = row["score"], row["flagged"], f"pre-screen {row['score']:.6g}"

    def _test(self, train: DataFrame, test: DataFrame, found: dict[str, Verdict], pair: DataFrame | None) -> dict[str, Row]:
        """Exact tests of the flagged columns; what the categories of each told is returned for the phase after."""
        c = self.config
        jobs: dict[str, DataFrame] = {}
        if pair is not None:
            jobs["categories"] = drift.category_tests(pair, c)
        if cols := self._names(found, "high_cardinality"):
            jobs["js"] = drift.js_of(top_other_of(pair.where(F.col("feature").isin(*cols)), c.top_k), c)
        inner = []
        if cols := self._names(found, "sparse"):
            jobs["z"] = drift.proportion_test(train, test, cols)
            inner = [x for x in cols if is_numeric(train, x)]
        values = None
        if cols := [*self._names(found, "numerical"), *inner]:
            values = drift.two_sample_counts(train, test, cols, nonzero=inner).persist()  # all columns counted in one scan of each split
            jobs["ks"] = drift.ks_of(values)
        try:
            told = gathered(jobs)
        finally:
            if values is not None:
                values.unpersist()
        of = lambda name: {r["feature"]: r for r in told.get(name, [])}
        categories, distances = of("categories"), of("ks")
        for x in self._names(found, "numerical"):
            if r := distances.get(x):
                self._ks_verdict(found[x], r["ks"], r["n_train"], r["n_test"])
        for x in self._names(found, "categorical"):
            r = categories[x]
            p = None if r["chi2"] is None else chi2_upper(r["chi2"], r["cells"] - 1)
            ok = r["psi"] >= c.psi.mild and (p is None or p < c.alpha)
            found[x].settle(PSI_TEST, r["psi"], ok, severity_of(r["psi"], c.psi), "chi2 did not run" if p is None else f"chi2 p={p:.6g}")
            found[x].p_value = p
        for r in told.get("js", []):
            level = severity_of(r["js"], c.js)
            found[r["feature"]].settle(JS_TEST, r["js"], level != "NONE", level, f"top {c.top_k} and the rest")
        for r in told.get("z", []):
            self._sparse_verdict(found[r["feature"]], r["z"], distances.get(r["feature"]))
        return categories

    def _ks_verdict(self, v: Verdict, d: float, n: int, m: int) -> None:
        c = self.config
        if min(n, m) < c.min_obs:
            v.notes = "too few values"
            return
        v.p_value = p = ks_two_sample(d, n, m)
        v.settle(KS_TEST, d, p < c.alpha and d > c.ks.mild, severity_of(d, c.ks), f"p={p:.6g}")

    def _sparse_verdict(self, v: Verdict, z: float, inner) -> None:  # noqa: ANN001
        """Presence by Z, then values that are not zero by KS; either confirms, the larger raw severity counts."""
        c = self.config
        v.p_value = normal_two_sided(z)
        level, confirmed = severity_of(abs(z), c.z), v.p_value < c.alpha and abs(z) >= c.z.mild
        statistic, note = z, f"z={z:.6g}"
        if inner is not None and min(inner["n_train"], inner["n_test"]) >= c.min_obs:
            d = inner["ks"]
            v.inner_p_value = p = ks_two_sample(d, inner["n_train"], inner["n_test"])
            statistic, note = d, f"{note}, ks p={p:.6g}"
            level = max(level, severity_of(d, c.ks), key=LEVELS.index)
            confirmed = confirmed or (p < c.alpha and d > c.ks.mild)
        v.settle(Z_TEST, statistic, confirmed, level, note)

    def _months(self, train: DataFrame, test: DataFrame, found: dict[str, Verdict], categories: dict[str, Row]) -> None:
        """Is the drift one of time: is the recent part of train nearer to test than all of it? And which test months leave train's range?"""
        c = self.config
        recent = [r["month"] for r in months.recent_months(train, self.month, c).collect()]
        numbers = [x for x in found if is_numeric(train, x)]
        others = [x for x in found if x not in numbers]
        jobs: dict[str, DataFrame] = {}
        sums = [months.month_sums(df, numbers, self.month).persist() for df in (train, test)] if numbers else []  # a row per column and month
        if numbers:
            jobs["means"] = months.temporal_of(*sums, recent)
        if segmented := [x for x in numbers if found[x].feature_type == "numerical"]:
            jobs["ranges"] = months.drifted_months(*[months.means_of(s.where(F.col("feature").isin(*segmented))) for s in sums], c)
        if others:
            late = train.where(F.col(self.month).cast("string").isin(recent))
            jobs["near"] = category_freq(late, others).groupBy("feature").agg(F.max("freq").alias("share"))
        try:
            told = gathered(jobs)
        finally:
            for s in sums:
                s.unpersist()
        for r in told.get("means", []):
            self._temporal(found[r["feature"]], r["near"], r["full"], r["then"])
        near = {r["feature"]: r["share"] for r in told.get("near", [])}
        for x in others:
            share = categories.get(x)
            self._temporal(found[x], near.get(x) or 0.0, share["top_p"] if share else 0.0, share["top_q"] if share else 0.0)
        for r in told.get("ranges", []):
            found[r["feature"]].phase_c_segment_stable, found[r["feature"]].phase_c_drifted_months = r["stable"], r["months"]

    def _temporal(self, v: Verdict, recent: float, full: float, test: float) -> None:
        v.phase_c_drift_is_temporal = abs(recent - test) < abs(full - test)
        v.phase_c_notes = f"recent {recent:.6g}, all {full:.6g}, test {test:.6g}"

    def _subpopulations(self, found: dict[str, Verdict], categories: dict[str, Row]) -> None:
        for x in self._names(found, "categorical"):
            v, r = found[x], categories[x]
            if r["shift"] > self.config.subpop_shift:
                v.phase_c_drift_detected = True
                v.phase_c_notes += f"; {r['category']} moved by {r['shift']:.6g}"
                if not v.drift_detected:
                    v.drift_detected, v.drift_severity, v.mitigation = True, "MILD", SUGGESTED["categorical"]


def drifted(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("drift_detected")


def rank_input(verdicts: DataFrame) -> DataFrame:
    """Verdicts as the ranking wants them."""
    return drifted(verdicts).select(
        F.col("column").alias("feature"), F.col("feature_type").alias("col_type"), F.col("test_method").alias("test_used"),
        F.coalesce("test_statistic", F.lit(0.0)).alias("raw_score"), "drift_severity",
    )


assert [f.name for f in fields_of(Verdict)] == [p.split()[0] for p in VERDICT.split(", ")]
