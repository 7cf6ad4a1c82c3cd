"""Every threshold of the engine in one place, with the switches that choose between parity and corrected behaviour."""

from __future__ import annotations

from dataclasses import dataclass, field

# Text that counts as null in CSV files, and the formats that make a string column a time column.
NULL_TOKENS = ("", "NA", "N/A", "NULL", "null", "None", "none", "NaN", "nan")
DATE_FORMATS = ("yy-MMM", "yyyy-MM", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyyMM", "MMM-yy", "yyyy-MM-dd", "dd/MM/yyyy")
POSITIVE_HINTS = ("yes", "1", "true", "y", "churn")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
NULL_LEVEL, OTHER_LEVEL = "__null__", "__OTHER__"
# Names of tests and treatments in result files, and the short and long names shown for them.
KS_TEST, PSI_TEST, JS_TEST, Z_TEST = "Kolmogorov-Smirnov", "Population Stability Index", "Jensen-Shannon Divergence", "Two-Proportion Z-Test"
PRESCREENED, SKIPPED = "Pre-Screen Only (fast)", "Skipped"
SHORT_TESTS = ((KS_TEST, "KS"), (PSI_TEST, "PSI"), (JS_TEST, "JS"), (Z_TEST, "Z"))
STABLE, UNTREATED = "no_action (stable)", "no_action (excluded type)"
TREATMENTS = {
    "quantile_binning": "Quantile Binning", "robust_scaling": "Robust Scaling", "frequency_encoding": "Frequency Encoding",
    "target_encoding": "Target Encoding (Laplace, m=10)", "binarise (sparse->binary)": "Binarisation", "drop_feature": "Drop Feature",
}


@dataclass(frozen=True)
class Cutoffs:
    """Half-open severity bounds: below mild is none, then mild, moderate, and severe from the last on."""

    mild: float
    moderate: float
    severe: float


@dataclass(frozen=True)
class Config:
    # classifier
    metadata_ratio: float = 0.95
    date_parse_rate: float = 0.80
    sparse_null: float = 0.75
    sparse_zero: float = 0.75
    high_cardinality: int = 100
    int_category_levels: int = 50
    int_category_ratio: float = 0.05
    # pre-screen
    shift: float = 0.10
    iqr_gap: float = 0.30
    l1: float = 0.10
    sparse_rate: float = 0.05
    l1_top: int = 30
    # tests
    ks: Cutoffs = field(default=Cutoffs(0.05, 0.10, 0.20))
    psi: Cutoffs = field(default=Cutoffs(0.10, 0.25, 0.50))
    js: Cutoffs = field(default=Cutoffs(0.05, 0.10, 0.20))
    z: Cutoffs = field(default=Cutoffs(2.0, 3.5, 5.0))
    alpha: float = 0.05
    min_obs: int = 30
    chi2_min_expected: float = 5.0
    top_k: int = 50
    psi_floor: float = 1e-6
    js_floor: float = 1e-9
    # sub-populations and months
    subpop_shift: float = 0.10
    recent_months: int = 3
    segment_tolerance: float = 0.05
    # ranking
    decay: float = 0.1
    severity_weights: tuple[tuple[str, float], ...] = (("SEVERE", 3.0), ("MODERATE", 2.0), ("MILD", 1.0), ("NONE", 0.0))
    # mitigation
    laplace_m: float = 10.0
    bins: int = 10
    prune_unseen: float = 0.30
    prune_iqr_ratio: float = 0.01
    prune_iqr_min: float = 1.0
    decision: float = 0.50
    # switches: the first value is parity
    month_order: str = "lexical"  # or "chronological"
    abs_score: bool = False  # rank sparse features by |Z|
    zero_counts_null: bool = True  # nulls count as zeros in the zero rate
    #: "bounded": a profile counts distinct values exactly only where a sketch comes near a rule's cut-off.
    cardinality: str = "exact"


DEFAULT = Config()
