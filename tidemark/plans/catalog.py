"""Named queries of every operator and the SQL that checks them on another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, DATE_FORMATS, NULL_TOKENS
from tidemark.functions import text
from tidemark.functions.scalars import cut, linspace, midpoints, number, numeric_columns, present, safe_float, text_columns
from tidemark.operators import cube, detect, drift, frequency, mitigate, model, months, profile, rank, views
from tidemark.plans import report
from tidemark.plans.fixtures import ITEMS_SQL, ITEMS_TEST, ITEMS_TRAIN, ORDERS_SQL, TEST, TRAIN, item_splits, items, orders, rounded, splits, table
from tidemark.sources import readers, store, writers

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int | None = 6):  # noqa: ANN201
    """Registers a query under its function's name, its doubles rounded, with the SQL that must give the same rows."""

    def keep(f):  # noqa: ANN001, ANN202
        _QUERIES[f.__name__] = (lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)) if digits else f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- pieces of SQL ----


def _norm(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({x}), '^\s+|\s+$', '', 'g'), '[-_]', ' ', 'g'), '\s+', ' ', 'g')"


def _level(x: str) -> str:
    return f"coalesce({_norm(f'CAST({x} AS VARCHAR)')}, '__null__')"


def _freq(source: str, *cols: str) -> str:
    """(feature, category, n, freq)."""
    one = [f"SELECT '{c}' AS feature, {_level(c)} AS category, count(*) AS n, count(*) / (SELECT count(*) FROM {source})::DOUBLE AS freq FROM {source} GROUP BY 2" for c in cols]
    return "(" + " UNION ALL ".join(one) + ")"


def _both(*cols: str, train: str = TRAIN, test: str = TEST) -> str:
    return f"""(SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.category, b.category) AS category,
      coalesce(a.freq, 0) AS p, coalesce(b.freq, 0) AS q, coalesce(a.n, 0) AS np, coalesce(b.n, 0) AS nq
      FROM {_freq(train, *cols)} a FULL JOIN {_freq(test, *cols)} b ON a.feature = b.feature AND a.category = b.category)"""


def _psi(*cols: str) -> str:
    p, q = "greatest(p, 1e-6)", "greatest(q, 1e-6)"
    return f"SELECT feature, sum(({q} - {p}) * ln({q} / {p})) AS psi FROM {_both(*cols)} GROUP BY feature"


def _severity(x: str, a: float, b: float, c: float) -> str:
    return f"CASE WHEN {x} < {a} THEN 'NONE' WHEN {x} < {b} THEN 'MILD' WHEN {x} < {c} THEN 'MODERATE' ELSE 'SEVERE' END"


def _stats(source: str, *cols: str) -> str:
    one = [
        f"""SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.75) AS p75,
        (SELECT avg((x.{c} - m.mu) ** 3) / sqrt(avg((x.{c} - m.mu) ** 2)) ** 3 FROM {source} x, (SELECT avg({c}) AS mu FROM {source}) m) AS skewness FROM {source}"""
        for c in cols
    ]
    return "(" + " UNION ALL ".join(one) + ")"


def _ks(train: str, test: str, cols: dict[str, str], where: str = "x IS NOT NULL") -> str:
    """(feature, ks, n_train, n_test) for {feature: expression}."""
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, {e} AS x, {a} AS a, {1 - a} AS b FROM {s}" for f, e in cols.items() for s, a in ((train, 1), (test, 0)))
    return f"""(WITH v AS (SELECT feature, x, sum(a) AS a, sum(b) AS b FROM ({rows}) WHERE {where} GROUP BY feature, x),
      c AS (SELECT feature, x, sum(a) OVER w / sum(a) OVER t AS fa, sum(b) OVER w / sum(b) OVER t AS fb, sum(a) OVER t AS na, sum(b) OVER t AS nb FROM v
        WINDOW w AS (PARTITION BY feature ORDER BY x), t AS (PARTITION BY feature))
      SELECT feature, max(abs(fa - fb)) AS ks, max(na)::BIGINT AS n_train, max(nb)::BIGINT AS n_test FROM c GROUP BY feature)"""


def _z(pa: str, na: str, pb: str, nb: str) -> str:
    pooled = f"(({pa} + {pb}) / ({na} + {nb})::DOUBLE)"
    return f"({pa} / {na}::DOUBLE - {pb} / {nb}::DOUBLE) / sqrt({pooled} * (1 - {pooled}) * (1.0::DOUBLE / {na} + 1.0::DOUBLE / {nb}))"


_MONTHS = " ".join(f"WHEN '{m}' THEN {k}" for k, m in enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), 1))


def _month_rank(source: str, col: str) -> str:
    key = f"CASE right(month, 3) {_MONTHS} END"
    return f"""(SELECT month, n, row_number() OVER (ORDER BY CAST(split_part(month, '-', 1) AS INT), {key}) - 1 AS rank
      FROM (SELECT {col} AS month, count(*) AS n FROM {source} GROUP BY 1))"""


def _monthly(source: str, month: str, *cols: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {month} AS month, coalesce(avg({c}), 0) AS mean FROM {source} GROUP BY 2" for c in cols) + ")"


# ---- profiles and types ----
_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, round(p25, 6) AS p25, round(p75, 6) AS p75, round(skewness, 6) AS skewness FROM {_stats('lineitem', *_NUMBERS)}")
def profile_numeric(spark, sf):
    return profile.numeric_stats(table(spark, sf, "lineitem"), _NUMBERS)


_RATED = {"trap": True, "rare_flag": False, "rare_price": True, "l_quantity": True}


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(({c} IS NULL)::INT), 6) AS null_rate, round({f'avg((coalesce({c}, 0) = 0)::INT)' if num else '0.0::DOUBLE'}, 6) AS zero_rate FROM ({ITEMS_SQL})"
        for c, num in _RATED.items()
    )
)
def null_zero_rates(spark, sf):
    return profile.null_zero_rates(items(spark, sf), list(_RATED))


_COUNTED = ("o_orderkey", "status", "target", "month", "o_orderpriority", "variant")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS n_unique FROM ({ORDERS_SQL})" for c in _COUNTED))
def cardinality(spark, sf):
    return profile.cardinality(orders(spark, sf), _COUNTED)


_TYPED = {
    "o_orderkey": ("bigint", "integer"), "o_totalprice": ("double", "float"), "o_orderpriority": ("string", "string"), "month": ("string", "string"),
    "sparse_price": ("double", "float"), "status": ("string", "string"), "o_orderdate": ("timestamp_ntz", "date"), "unit": ("int", "integer"),
    "priority_rank": ("int", "integer"), "name": ("string", "string"), "customer": ("string", "string"),
}
_TYPED_SQL = f"SELECT *, 1 AS unit, CAST(left(o_orderpriority, 1) AS INT) AS priority_rank, 'order ' || o_orderkey AS name, 'customer ' || o_custkey AS customer FROM ({ORDERS_SQL})"


def _classified(c: str, kind: str) -> str:
    zero = f"avg((coalesce({c}, 0) = 0)::INT)" if kind in ("integer", "float") else "0"
    share, n = "u / greatest(n, 1)", f"count(DISTINCT {c}) + max(({c} IS NULL)::INT)"
    dated = f"(SELECT avg((try_strptime(v, ['%y-%b', '%Y-%m', '%m/%d/%Y', '%d-%b-%Y', '%b-%y', '%Y-%m-%d', '%d/%m/%Y']) IS NOT NULL)::INT) FROM (SELECT DISTINCT {c} AS v FROM ({_TYPED_SQL}) WHERE {c} IS NOT NULL))" if kind == "string" else "0"
    rule = f"""CASE WHEN u <= 1 THEN 'constant' WHEN '{kind}' = 'string' AND {share} > 0.95 THEN 'metadata' WHEN '{kind}' = 'date' OR d >= 0.8 THEN 'time'
      WHEN nulls > 0.75 OR zeros > 0.75 THEN 'sparse' WHEN '{kind}' = 'string' AND u > 100 THEN 'high_cardinality'
      WHEN '{kind}' = 'string' OR '{kind}' = 'integer' AND u <= 50 AND {share} < 0.05 THEN 'categorical' ELSE 'numerical' END"""
    return f"SELECT '{c}' AS name, {rule} AS feature_type, u AS n_unique FROM (SELECT count(*) AS n, {n} AS u, avg(({c} IS NULL)::INT) AS nulls, {zero} AS zeros, {dated} AS d FROM ({_TYPED_SQL}))"


@query(" UNION ALL ".join(_classified(c, kind) for c, (_, kind) in _TYPED.items()))
def classify_columns(spark, sf):
    df = orders(spark, sf).withColumns(
        {
            "unit": F.lit(1), "priority_rank": F.left("o_orderpriority", F.lit(1)).cast("int"),
            "name": F.concat(F.lit("order "), F.col("o_orderkey")), "customer": F.concat(F.lit("customer "), F.col("o_custkey")),
        }
    )
    return profile.profile(df.select(*_TYPED)).select("name", "feature_type", "n_unique")


_DATED = """SELECT strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%y-%b') AS label, o_orderpriority AS word,
  CASE WHEN o_orderkey % 3 = 0 THEN 'order ' || o_orderkey ELSE strftime(o_orderdate, '%d/%m/%Y') END AS mixed FROM orders"""


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg((try_strptime(v, ['%y-%b', '%Y-%m', '%m/%d/%Y', '%d-%b-%Y', '%b-%y', '%Y-%m-%d', '%d/%m/%Y']) IS NOT NULL)::INT), 6) AS date_rate FROM (SELECT DISTINCT {c} AS v FROM ({_DATED}))"
        for c in ("iso", "label", "word", "mixed")
    )
)
def date_parse_rate(spark, sf):
    mixed = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("order "), "o_orderkey")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    df = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "yy-MMM").alias("label"), F.col("o_orderpriority").alias("word"), mixed.alias("mixed"))
    return profile.date_parse_rates(df, df.columns)


_FORMATS = {"yy-MMM": "%y-%b", "yyyy-MM": "%Y-%m", "MM/dd/yyyy": "%m/%d/%Y", "dd-MMM-yyyy": "%d-%b-%Y", "yyyyMM": "%Y%m", "MMM-yy": "%b-%y", "yyyy-MM-dd": "%Y-%m-%d", "dd/MM/yyyy": "%d/%m/%Y"}


@query(" UNION ALL ".join(f"SELECT '{a}' AS format, count(*) AS parsed, count(DISTINCT strftime(o_orderdate, '{b}')) AS labels FROM orders" for a, b in _FORMATS.items()))
def date_formats(spark, sf):
    df = table(spark, sf, "orders")
    one = lambda f: df.select(F.date_format("o_orderdate", f).alias("x")).agg(F.lit(f).alias("format"), F.count(F.try_to_date("x", f)).alias("parsed"), F.count_distinct("x").alias("labels"))
    out = one(DATE_FORMATS[0])
    for f in DATE_FORMATS[1:]:
        out = out.unionByName(one(f))
    return out


@query(f"SELECT count(*) AS rows, count(o_orderkey) AS keys, count(target) AS labelled, sum((o_totalprice > 200000)::INT)::BIGINT AS large FROM ({ORDERS_SQL})")
def row_counts(spark, sf):
    return orders(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count("o_orderkey").alias("keys"), F.count("target").alias("labelled"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


# ---- text, frequencies ----


@query(f"SELECT DISTINCT variant, {_norm('variant')} AS normal FROM ({ORDERS_SQL})")
def normalise_category(spark, sf):
    return orders(spark, sf).select("variant", text.normalise(F.col("variant")).alias("normal")).distinct()


@query(f"SELECT feature, category, n, round(freq, 6) AS freq FROM {_freq(f'({ORDERS_SQL})', 'variant', 'status', 'o_custkey')}")
def value_counts_norm(spark, sf):
    return frequency.category_freq(orders(spark, sf), ["variant", "status", "o_custkey"])


@query(f"SELECT category, n, round(freq, 6) AS freq FROM {_freq(f'({ORDERS_SQL})', 'status')}")
def value_counts(spark, sf):
    return frequency.value_counts(orders(spark, sf), "status")


@query(f"SELECT feature, category, round(p, 6) AS p, round(q, 6) AS q FROM {_both('moved', 'status')}")
def outer_aligned_shares(spark, sf):
    a, b = splits(spark, sf)
    both = frequency.aligned(frequency.category_freq(a, ["moved", "status"]), frequency.category_freq(b, ["moved", "status"]))
    return both.select("feature", "category", "p", "q")


@query(f"SELECT DISTINCT {_level('status')} AS category FROM {TRAIN} UNION SELECT DISTINCT {_level('status')} FROM {TEST}")
def category_union(spark, sf):
    a, b = splits(spark, sf)
    one = lambda df: df.select(text.level(F.col("status")).alias("category"))
    return one(a).union(one(b)).distinct()


def _freqs(spark, sf, *cols):
    a, b = splits(spark, sf)
    return frequency.category_freq(a, cols), frequency.category_freq(b, cols)


_CATEGORIES = ("o_orderpriority", "variant", "status", "moved")


@query(f"SELECT feature, round(psi, 6) AS psi FROM ({_psi(*_CATEGORIES)})")
def psi(spark, sf):
    return drift.psi(*_freqs(spark, sf, *_CATEGORIES))


@query(f"SELECT feature, round(psi, 6) AS psi, {_severity('psi', 0.1, 0.25, 0.5)} AS severity FROM ({_psi(*_CATEGORIES)})")
def psi_severity(spark, sf):
    return drift.psi_severity(*_freqs(spark, sf, *_CATEGORIES))


@query(
    f"""SELECT feature, round(psi, 6) AS psi, round(top_p, 6) AS top_p, round(top_q, 6) AS top_q FROM ({_psi(*_CATEGORIES)})
    JOIN (SELECT feature, max(p) AS top_p, max(q) AS top_q FROM {_both(*_CATEGORIES)} GROUP BY feature) USING (feature)"""
)
def category_tests(spark, sf):
    """All statistics of categories from one aggregate over one paired table."""
    return drift.category_tests(frequency.paired(*splits(spark, sf), _CATEGORIES)).select("feature", "psi", "top_p", "top_q")


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM {TEST}), c AS (SELECT feature, q * n AS o, greatest(p, 1e-9) * n AS e FROM {_both(*_CATEGORIES)}, n),
    k AS (SELECT * FROM c WHERE e >= 5), t AS (SELECT feature, sum(o) AS so, sum(e) AS se FROM k GROUP BY feature)
    SELECT feature, round(sum((o - e * so / se) ** 2 / (e * so / se)), 4) AS chi2, count(*) AS cells FROM k JOIN t USING (feature) GROUP BY feature""",
    digits=4,
)
def chi2_gof_statistic(spark, sf):
    return drift.chi2(*_freqs(spark, sf, *_CATEGORIES))


def _top(source: str, k: int, *cols: str) -> str:
    return f"(SELECT * FROM {_freq(source, *cols)} QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, category) <= {k})"


@query(
    f"""SELECT feature, round(sum(abs(p - q)), 6) AS l1 FROM {_both('brand_type', train=ITEMS_TRAIN, test=ITEMS_TEST)}
    WHERE category IN (SELECT category FROM {_top(ITEMS_TRAIN, 30, 'brand_type')}) OR category IN (SELECT category FROM {_top(ITEMS_TEST, 30, 'brand_type')}) GROUP BY feature"""
)
def l1_prescreen(spark, sf):
    """Categories among either side's first 30; their shares are those of the whole tables."""
    return drift.l1_of(frequency.paired(*item_splits(spark, sf), ["brand_type"]))


_SCREENED = ("o_totalprice", "shifted")


@query(
    f"""WITH j AS (SELECT a.feature, a.mean AS am, a.std AS astd, a.p25 AS al, a.p75 AS ah, b.mean AS bm, coalesce(nullif(b.p25, 0), b.mean) AS bl, coalesce(nullif(b.p75, 0), b.mean) AS bh
      FROM {_stats(TRAIN, *_SCREENED)} a JOIN {_stats(TEST, *_SCREENED)} b USING (feature)),
    s AS (SELECT feature, abs(am - bm) / (astd + 1e-9) AS shift, CASE WHEN ah - al > 1e-9 THEN 1 - greatest(0, least(ah, bh) - greatest(al, bl)) / (ah - al) ELSE 0 END AS gap FROM j)
    SELECT feature, round(shift, 6) AS shift, round(gap, 6) AS iqr_gap, round(greatest(shift, gap), 6) AS score, shift > 0.1 OR gap > 0.3 AS flagged FROM s"""
)
def numeric_prescreen(spark, sf):
    return drift.numeric_prescreen(*splits(spark, sf), _SCREENED)


def _presence(source: str, side: str, expr: str) -> str:
    return f"SELECT count(*) AS n_{side}, sum(({expr})::INT) AS pos_{side} FROM {source}"


_SPARSE = {"sparse_price": "coalesce(sparse_price, 0) <> 0", "status": "status IS NOT NULL"}


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(abs(pos_a / n_a::DOUBLE - pos_b / n_b::DOUBLE), 6) AS score, abs(pos_a / n_a::DOUBLE - pos_b / n_b::DOUBLE) > 0.05 AS flagged
        FROM ({_presence(TRAIN, 'a', e)}), ({_presence(TEST, 'b', e)})"""
        for c, e in _SPARSE.items()
    )
)
def sparse_prescreen(spark, sf):
    return drift.sparse_prescreen(*splits(spark, sf), list(_SPARSE))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, pos_x, n_x FROM (SELECT count(*) AS n_x, sum(({e})::INT)::BIGINT AS pos_x FROM {TRAIN})" for c, e in _SPARSE.items()))
def presence_counts(spark, sf):
    return drift.presence(splits(spark, sf)[0], list(_SPARSE), "x")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(pos_a / n_a::DOUBLE, 6) AS rate_train, round(pos_b / n_b::DOUBLE, 6) AS rate_test, round({_z('pos_a', 'n_a', 'pos_b', 'n_b')}, 6) AS z FROM ({_presence(TRAIN, 'a', e)}), ({_presence(TEST, 'b', e)})"
        for c, e in _SPARSE.items()
    )
)
def two_proportion_z(spark, sf):
    return drift.proportion_test(*splits(spark, sf), list(_SPARSE))


@query(f"SELECT feature, round(ks, 6) AS ks, n_train, n_test FROM {_ks(TRAIN, TEST, {c: c for c in ('o_totalprice', 'shifted', 'o_custkey')})}")
def ks_two_sample(spark, sf):
    return drift.ks(*splits(spark, sf), ["o_totalprice", "shifted", "o_custkey"])


@query(f"SELECT feature, round(ks, 6) AS ks, n_train, n_test FROM {_ks(TRAIN, TEST, {'sparse_price': 'sparse_price'}, 'x <> 0')}")
def ks_conditional_nonzero(spark, sf):
    return drift.ks(*splits(spark, sf), ["sparse_price"], nonzero=True)


_BINNED = f"""(WITH kept AS (SELECT feature, category, true AS kept FROM {_top(ITEMS_TRAIN, 50, 'brand_type')}),
  b AS (SELECT f.feature, CASE WHEN kept THEN f.category ELSE '__OTHER__' END AS category, sum(p) AS p, sum(q) AS q FROM {_both('brand_type', train=ITEMS_TRAIN, test=ITEMS_TEST)} f
    LEFT JOIN kept USING (feature, category) GROUP BY 1, 2)
  SELECT feature, category, p / sum(p) OVER (PARTITION BY feature) AS p, q / sum(q) OVER (PARTITION BY feature) AS q FROM b)"""


def _item_freqs(spark, sf):
    a, b = item_splits(spark, sf)
    return frequency.category_freq(a, ["brand_type"]), frequency.category_freq(b, ["brand_type"])


@query(f"SELECT feature, category, round(p, 6) AS p, round(q, 6) AS q FROM {_BINNED}")
def topk_other(spark, sf):
    return frequency.top_other(*_item_freqs(spark, sf), DEFAULT.top_k)


@query(
    f"""WITH f AS (SELECT feature, greatest(p, 1e-9) AS p, greatest(q, 1e-9) AS q FROM {_BINNED}), r AS (SELECT feature, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM f WINDOW w AS (PARTITION BY feature))
    SELECT feature, round(sum(p * ln(p / ((p + q) / 2)) / 2 + q * ln(q / ((p + q) / 2)) / 2) / ln(2), 6) AS js FROM r GROUP BY feature"""
)
def js_divergence(spark, sf):
    return drift.js(*_item_freqs(spark, sf))


@query(f"SELECT feature, round(max(freq), 6) AS share FROM {_freq(TRAIN, 'o_orderpriority', 'status', 'moved')} GROUP BY feature")
def dominant_share(spark, sf):
    return frequency.category_freq(splits(spark, sf)[0], ["o_orderpriority", "status", "moved"]).groupBy("feature").agg(F.max("freq").alias("share"))


@query(f"SELECT feature, arg_max(category, (round(abs(p - q), 12), category)) AS category, round(max(abs(p - q)), 6) AS shift FROM {_both('status', 'moved')} GROUP BY feature")
def subpop_max_shift(spark, sf):
    return drift.max_share_shift(*_freqs(spark, sf, "status", "moved"))


@query(
    " UNION ALL ".join(
        f"SELECT {x}::DOUBLE AS x, {_severity(f'{x}::DOUBLE', *c)} AS severity, '{n}' AS test FROM (SELECT 1)"
        for n, c in (("ks", (0.05, 0.1, 0.2)), ("psi", (0.1, 0.25, 0.5)), ("js", (0.05, 0.1, 0.2)), ("z", (2.0, 3.5, 5.0)))
        for x in (0.0, 0.05, 0.1, 0.2, 0.25, 0.5, 2.0, 3.5, 5.0)
    )
)
def severity_cutoffs(spark, sf):
    from tidemark.functions.scalars import severity

    xs = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.1, 0.2, 0.25, 0.5, 2.0, 3.5, 5.0)], "x double")
    c = DEFAULT
    outs = [xs.select("x", severity(F.col("x"), k).alias("severity"), F.lit(n).alias("test")) for n, k in (("ks", c.ks), ("psi", c.psi), ("js", c.js), ("z", c.z))]
    return outs[0].union(outs[1]).union(outs[2]).union(outs[3])


# ---- months ----


@query(f"SELECT month, count(*) AS n FROM {TRAIN} GROUP BY month")
def month_counts(spark, sf):
    return months.month_counts(splits(spark, sf)[0], "month")


@query(f"SELECT month, n, rank::INT AS rank FROM {_month_rank(f'({ORDERS_SQL})', 'month4')}")
def month_rank(spark, sf):
    return months.month_rank(orders(spark, sf), "month4")


@query(f"SELECT DISTINCT month FROM {TRAIN} ORDER BY month DESC LIMIT 3")
def recent_months_lexical(spark, sf):
    return months.recent_months(splits(spark, sf)[0], "month")


@query(f"SELECT month FROM {_month_rank(TRAIN, 'month')} ORDER BY rank DESC LIMIT 3")
def recent_months_chronological(spark, sf):
    from dataclasses import replace

    return months.recent_months(splits(spark, sf)[0], "month", replace(DEFAULT, month_order="chronological"))


@query(f"SELECT count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM {TRAIN} WHERE month IN (SELECT DISTINCT month FROM {TRAIN} ORDER BY month DESC LIMIT 3)")
def recent_rows(spark, sf):
    a = splits(spark, sf)[0]
    return a.join(F.broadcast(months.recent_months(a, "month")), "month", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"))


_WEIGHTS = f"(SELECT *, exp(0.1 * rank) AS weight, exp(0.1 * rank) * n / sum(exp(0.1 * rank) * n) OVER () AS fraction FROM {_month_rank(TEST, 'month')})"


@query(f"SELECT month, n, rank::INT AS rank, round(weight, 6) AS weight, round(fraction, 6) AS fraction FROM {_WEIGHTS}")
def recency_weights(spark, sf):
    return months.recency_weights(splits(spark, sf)[1], "month")


@query(f"SELECT round(sum(fraction ** 2), 6) AS recency_factor FROM {_WEIGHTS}")
def recency_factor(spark, sf):
    return months.recency_factor(splits(spark, sf)[1], "month")


@query(f"SELECT o_orderkey, round(weight, 6) AS recency_weight FROM {TEST} LEFT JOIN {_WEIGHTS} USING (month)")
def row_recency_weights(spark, sf):
    return months.row_weights(splits(spark, sf)[1], "month").select("o_orderkey", "recency_weight")


@query(f"SELECT month, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM (SELECT month, count(*) AS n FROM {TEST} GROUP BY month)")
def month_shares(spark, sf):
    return months.month_counts(splits(spark, sf)[1], "month").select("month", months.ratio_to_total("n").alias("share"))


@query(f"SELECT feature, month, round(mean, 4) AS mean FROM {_monthly(TRAIN, 'month', 'o_totalprice', 'sparse_price')}", digits=4)
def monthly_means(spark, sf):
    return months.monthly_means(splits(spark, sf)[0], ["o_totalprice", "sparse_price"], "month")


#: Values of some months only, so that others have none; and rows without a month.
_GAPPY = "(SELECT *, CASE WHEN month LIKE '%-J%' THEN NULL ELSE o_totalprice END AS gappy, CASE WHEN o_orderkey % 13 <> 0 THEN month END AS some_month FROM {})"


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(mean), 4) AS mean FROM (SELECT avg({c}) AS mean FROM {_GAPPY.format(TRAIN)} GROUP BY some_month)" for c in ("o_totalprice", "sparse_price", "gappy")
    ),
    digits=4,
)
def mean_of_monthly_means(spark, sf):
    """Months without values are skipped; rows without a month are a month of their own."""
    return months.mean_of_means(months.monthly_means(_gappy(splits(spark, sf)[0]), ["o_totalprice", "sparse_price", "gappy"], "some_month", None))


def _gappy(df):
    return df.withColumn("gappy", F.when(~F.col("month").contains("-J"), F.col("o_totalprice"))).withColumn("some_month", F.when(F.col("o_orderkey") % 13 != 0, F.col("month")))


_GAPPY_TRAIN, _GAPPY_TEST = _GAPPY.format(TRAIN), _GAPPY.format(TEST)
_RECENT = f"(SELECT DISTINCT some_month FROM {_GAPPY_TRAIN} WHERE some_month IS NOT NULL ORDER BY 1 DESC LIMIT 3)"


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(coalesce((SELECT avg({c}) FROM {_GAPPY_TRAIN} WHERE some_month IN {_RECENT}), (SELECT avg({c}) FROM {_GAPPY_TRAIN})), 4) AS near,
        round((SELECT avg({c}) FROM {_GAPPY_TRAIN}), 4) AS full, round((SELECT avg(m) FROM (SELECT avg({c}) AS m FROM {_GAPPY_TEST} GROUP BY some_month)), 4) AS "then" """
        for c in ("o_totalprice", "gappy", "o_custkey")
    ),
    digits=4,
)
def temporal_means(spark, sf):
    """What the temporal flag compares: train's recent months and all its rows, and the mean of test's monthly means."""
    a, b = map(_gappy, splits(spark, sf))
    recent = [r["month"] for r in months.recent_months(a, "some_month").collect()]
    return months.temporal_means(a, b, ["o_totalprice", "gappy", "o_custkey"], "some_month", recent)


_RANGES = f"""(SELECT feature, min(mean) - w AS low, max(mean) + w AS high FROM (SELECT *, CASE WHEN avg(mean) OVER t = 0 THEN greatest(stddev_pop(mean) OVER t, 1e-6)
  ELSE greatest(stddev_pop(mean) OVER t, 0.05 * abs(avg(mean) OVER t)) END AS w FROM {_monthly(TRAIN, 'month', 'o_totalprice', 'shifted')} WINDOW t AS (PARTITION BY feature)) GROUP BY feature, w)"""


@query(f"SELECT feature, round(low, 3) AS low, round(high, 3) AS high FROM {_RANGES}", digits=3)
def segment_ranges(spark, sf):
    return months.segment_ranges(months.monthly_means(splits(spark, sf)[0], ["o_totalprice", "shifted"], "month"))


@query(
    f"""SELECT feature, count(*) FILTER (mean < low OR mean > high) = 0 AS stable, coalesce(string_agg(month, ',' ORDER BY month) FILTER (mean < low OR mean > high), '') AS months
    FROM {_monthly(TEST, 'month', 'o_totalprice', 'shifted')} JOIN {_RANGES} USING (feature) GROUP BY feature"""
)
def segment_range_check(spark, sf):
    a, b = splits(spark, sf)
    cols = ["o_totalprice", "shifted"]
    return months.drifted_months(months.monthly_means(a, cols, "month"), months.monthly_means(b, cols, "month"))


# ---- the detector ----
#: Columns of all kinds: a city with more than a hundred levels, new ones among them in test; one that no split has.
_TYPES = {
    "o_orderkey": "metadata", "month": "time", "target": "target", "o_totalprice": "numerical", "shifted": "numerical", "o_orderpriority": "categorical", "variant": "categorical",
    "status": "categorical", "moved": "categorical", "sparse_price": "sparse", "city": "high_cardinality", "rare": "sparse", "absent": "numerical",
}
_CITY = """(SELECT *, CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderkey % 4 = 0 THEN 'New-City ' || o_custkey % 40 ELSE 'city_' || o_custkey % 150 END AS city,
  CASE WHEN o_orderkey % (CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 4 ELSE 10 END) = 0 THEN o_orderstatus END AS rare FROM {})"""
_D_TRAIN, _D_TEST = _CITY.format(TRAIN), _CITY.format(TEST)


def _with_city(df):
    late = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    new = F.concat(F.lit("New-City "), (F.col("o_custkey") % 40).cast("string"))
    old = F.concat(F.lit("city_"), (F.col("o_custkey") % 150).cast("string"))
    rare = F.when(F.col("o_orderkey") % F.when(late, 4).otherwise(10) == 0, F.col("o_orderstatus"))
    return df.withColumn("city", F.when(late & (F.col("o_orderkey") % 4 == 0), new).otherwise(old)).withColumn("rare", rare)


def _detect_sql(p_values: bool = False) -> str:
    """The detector's rules over the same columns, from the statistics above; p-values as critical values at 0.05. Or the p-values of categories and of presence."""
    numbers, words, city = ("o_totalprice", "shifted"), ("o_orderpriority", "variant", "status", "moved"), ("city",)
    all_words = (*words, *city, "rare")
    sides = {"tr": _D_TRAIN, "te": _D_TEST}
    both = _both(*all_words, train=_D_TRAIN, test=_D_TEST)
    kept = " OR ".join(f"(feature, category) IN (SELECT (feature, category) FROM {_top(x, 30, *words, *city)})" for x in sides.values())
    binned = f"""(WITH kept AS (SELECT feature, category, true AS kept FROM {_top(_D_TRAIN, 50, *city)}), b AS (SELECT f.feature, CASE WHEN kept THEN f.category ELSE '__OTHER__' END AS category, sum(p) AS p, sum(q) AS q
      FROM (SELECT * FROM both_ WHERE feature = 'city') f LEFT JOIN kept USING (feature, category) GROUP BY 1, 2) SELECT feature, category, p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM b)"""
    recent = f"(SELECT DISTINCT month FROM {_D_TRAIN} ORDER BY month DESC LIMIT 3)"
    means = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (SELECT avg({c}) FROM {_D_TRAIN} WHERE month IN {recent}) AS near, (SELECT avg({c}) FROM {_D_TRAIN}) AS whole, (SELECT avg(m) FROM (SELECT avg({c}) AS m FROM {_D_TEST} GROUP BY month)) AS later"
        for c in (*numbers, "sparse_price")
    )
    shares = " UNION ALL ".join(
        f"SELECT '{c}', (SELECT max(n) / sum(n)::DOUBLE FROM (SELECT count(*) AS n FROM {_D_TRAIN} WHERE month IN {recent} GROUP BY {_level(c)})), (SELECT max(p) FROM both_ WHERE feature = '{c}'), (SELECT max(q) FROM both_ WHERE feature = '{c}')"
        for c in all_words
    )
    critical = "CASE cells - 1 WHEN 1 THEN 3.841458820694124 WHEN 2 THEN 5.991464547107979 WHEN 3 THEN 7.814727903251179 WHEN 4 THEN 9.487729036781154 WHEN 5 THEN 11.070497693516351 WHEN 6 THEN 12.591587243743977 END"
    sure = "ks > 0.05 AND ks * sqrt(n_train * n_test / (n_train + n_test)::DOUBLE) > 1.3580986393225505"  # the 0.95 quantile of Kolmogorov's distribution
    level = lambda x: f"list_position(['NONE', 'MILD', 'MODERATE', 'SEVERE'], {x})"
    sparse = {"sparse_price": "coalesce(sparse_price, 0) <> 0", "rare": "rare IS NOT NULL"}
    presence = " UNION ALL ".join(f"SELECT '{c}' AS feature, {_z('pos_a', 'n_a', 'pos_b', 'n_b')} AS z, abs(pos_a / n_a::DOUBLE - pos_b / n_b::DOUBLE) AS score FROM ({_presence(_D_TRAIN, 'a', e)}), ({_presence(_D_TEST, 'b', e)})" for c, e in sparse.items())
    monthly = lambda source: " UNION ALL ".join(f"SELECT '{c}' AS feature, month, coalesce(avg({c}), 0) AS mean FROM {source} GROUP BY 2" for c in numbers)
    rules = f"""WITH both_ AS (SELECT * FROM {both}), nt AS (SELECT count(*) AS n FROM {_D_TEST}),
    stats AS (SELECT a.feature, a.mean AS am, a.std AS astd, a.p25 AS al, a.p75 AS ah, b.mean AS bm, coalesce(nullif(b.p25, 0), b.mean) AS bl, coalesce(nullif(b.p75, 0), b.mean) AS bh
      FROM {_stats(_D_TRAIN, *numbers)} a JOIN {_stats(_D_TEST, *numbers)} b USING (feature)),
    gaps AS (SELECT feature, abs(am - bm) / (astd + 1e-9) AS shift, CASE WHEN ah - al > 1e-9 THEN 1 - greatest(0, least(ah, bh) - greatest(al, bl)) / (ah - al) ELSE 0 END AS gap FROM stats),
    presence AS ({presence}),
    pre AS (SELECT feature, 'numerical' AS kind, greatest(shift, gap) AS score, shift > 0.1 OR gap > 0.3 AS flagged FROM gaps
      UNION ALL SELECT feature, CASE WHEN feature = 'city' THEN 'high_cardinality' ELSE 'categorical' END, sum(abs(p - q)), sum(abs(p - q)) > 0.1 FROM both_ WHERE {kept} GROUP BY feature
      UNION ALL SELECT feature, 'sparse', score, score > 0.05 FROM presence),
    cells AS (SELECT feature, q * n AS o, greatest(p, 1e-9) * n AS e FROM both_, nt WHERE greatest(p, 1e-9) * n >= 5),
    sums AS (SELECT feature, sum(o) AS so, sum(e) AS se, count(*) AS cells FROM cells GROUP BY feature),
    chi AS (SELECT feature, any_value(cells) AS cells, sum((o - e * so / se) ** 2 / (e * so / se)) AS chi2 FROM cells JOIN sums USING (feature) GROUP BY feature),
    psi AS (SELECT feature, sum((greatest(q, 1e-6) - greatest(p, 1e-6)) * ln(greatest(q, 1e-6) / greatest(p, 1e-6))) AS psi, max(abs(p - q)) AS moved FROM both_ GROUP BY feature),
    lifted AS (SELECT feature, greatest(p, 1e-9) AS p, greatest(q, 1e-9) AS q FROM {binned}),
    even AS (SELECT feature, p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM lifted),
    js AS (SELECT feature, sum(p * ln(p / ((p + q) / 2)) / 2 + q * ln(q / ((p + q) / 2)) / 2) / ln(2) AS js FROM even GROUP BY feature),
    ks AS (SELECT * FROM {_ks(_D_TRAIN, _D_TEST, {c: c for c in numbers})}), inner_ks AS (SELECT * FROM {_ks(_D_TRAIN, _D_TEST, {'sparse_price': 'sparse_price'}, 'x <> 0')}),
    tests AS (SELECT feature, 'Kolmogorov-Smirnov' AS method, ks AS stat, {sure} AS ok, {_severity('ks', 0.05, 0.1, 0.2)} AS sev FROM ks WHERE least(n_train, n_test) >= 30
      UNION ALL SELECT feature, 'Population Stability Index', psi, psi >= 0.1 AND (coalesce(cells, 0) < 2 OR chi2 > {critical}), {_severity('psi', 0.1, 0.25, 0.5)} FROM psi LEFT JOIN chi USING (feature) WHERE feature NOT IN ('city', 'rare')
      UNION ALL SELECT feature, 'Jensen-Shannon Divergence', js, js >= 0.05, {_severity('js', 0.05, 0.1, 0.2)} FROM js
      UNION ALL SELECT p.feature, 'Two-Proportion Z-Test', CASE WHEN least(n_train, n_test) >= 30 THEN ks ELSE z END, abs(z) >= 2 OR least(n_train, n_test) >= 30 AND {sure},
        CASE WHEN least(n_train, n_test) >= 30 AND {level(_severity('ks', 0.05, 0.1, 0.2))} > {level(_severity('abs(z)', 2.0, 3.5, 5.0))} THEN {_severity('ks', 0.05, 0.1, 0.2)} ELSE {_severity('abs(z)', 2.0, 3.5, 5.0)} END FROM presence p LEFT JOIN inner_ks k ON p.feature = k.feature),
    times AS (SELECT feature, abs(near - later) < abs(whole - later) AS temporal FROM ({means} UNION ALL {shares})),
    monthly AS (SELECT 'a' AS side, * FROM ({monthly(_D_TRAIN)}) UNION ALL SELECT 'b', * FROM ({monthly(_D_TEST)})),
    spread AS (SELECT feature, min(mean) AS lo, max(mean) AS hi, CASE WHEN avg(mean) = 0 THEN greatest(stddev_pop(mean), 1e-6) ELSE greatest(stddev_pop(mean), 0.05 * abs(avg(mean))) END AS w FROM monthly WHERE side = 'a' GROUP BY feature HAVING count(*) >= 2),
    segments AS (SELECT feature, count(*) FILTER (mean < lo - w OR mean > hi + w) = 0 AS stable, coalesce(string_agg(month, ',' ORDER BY month) FILTER (mean < lo - w OR mean > hi + w), '') AS months FROM monthly JOIN spread USING (feature) WHERE side = 'b' GROUP BY feature),
    told AS (SELECT pre.*, method, stat, coalesce(flagged AND ok, false) AS drifted, CASE WHEN flagged AND ok THEN sev ELSE 'NONE' END AS severity, coalesce(flagged AND kind = 'categorical' AND moved > 0.1, false) AS sub, flagged AND temporal AS temporal, stable, months
      FROM pre LEFT JOIN tests USING (feature) LEFT JOIN psi USING (feature) LEFT JOIN times USING (feature) LEFT JOIN segments USING (feature))"""
    upper = lambda x, a: "CASE WHEN {x} > 1000 THEN 0 ELSE greatest(0, 1 - list_sum(list_transform(range(3000), lambda i: exp((i + {a}) * ln({x} / 2) - {x} / 2 - lgamma(i + {a} + 1))))) END".format(x=x, a=a)  # noqa: E731  the lower gamma series, in logarithms
    if p_values:
        return f"""{rules} SELECT feature AS "column", method AS test_method, round(CASE WHEN kind = 'sparse' THEN {upper('z * z', '0.5::DOUBLE')} WHEN cells >= 2 THEN {upper('chi2', '((cells - 1) / 2.0)')} END, 6) AS p_value
          FROM told LEFT JOIN chi USING (feature) LEFT JOIN (SELECT feature, z FROM presence) USING (feature) WHERE flagged AND kind IN ('categorical', 'sparse')"""
    return f"""({rules}
    SELECT feature AS "column", kind AS feature_type, score AS prescreen_score, flagged AS prescreen_flagged, CASE WHEN flagged THEN method ELSE 'Pre-Screen Only (fast)' END AS test_method,
      CASE WHEN flagged THEN stat END AS test_statistic, drifted OR sub AS drift_detected, CASE WHEN drifted THEN severity WHEN sub THEN 'MILD' ELSE 'NONE' END AS drift_severity,
      CASE WHEN NOT (drifted OR sub) THEN 'no_action (stable)' WHEN kind = 'numerical' THEN 'quantile_binning' WHEN kind = 'categorical' THEN 'frequency_encoding' WHEN kind = 'sparse' THEN 'binarise (sparse->binary)' ELSE 'drop_feature' END AS mitigation,
      sub AS phase_c_drift_detected, temporal AS phase_c_drift_is_temporal, CASE WHEN flagged THEN stable END AS phase_c_segment_stable, coalesce(CASE WHEN flagged THEN months END, '') AS phase_c_drifted_months FROM told
    UNION ALL SELECT c, t, 0.0, false, 'Skipped', NULL, false, 'NONE', CASE WHEN t = 'numerical' THEN 'none' ELSE 'no_action (excluded type)' END, false, false, NULL, ''
      FROM (VALUES ('o_orderkey', 'metadata'), ('month', 'time'), ('target', 'target'), ('absent', 'numerical')) v(c, t))"""


_DETECT = _detect_sql()
_DECIDED = (
    "column", "feature_type", "prescreen_score", "prescreen_flagged", "test_method", "test_statistic", "drift_detected", "drift_severity", "mitigation",
    "phase_c_drift_detected", "phase_c_drift_is_temporal", "phase_c_segment_stable", "phase_c_drifted_months",
)


def _verdicts(spark, sf):
    """Verdicts of one input, made once for the queries that look at them, and again where its files change."""

    def make():
        a, b = map(_with_city, splits(spark, sf))
        return detect.Detector(_TYPES, "month").detect(a, b).coalesce(1)

    return store.kept(spark, "verdicts", [f"{sf}/orders.parquet"], (_TYPES, DEFAULT), make)


@query("SELECT \"column\", feature_type, round(prescreen_score, 6) AS prescreen_score, prescreen_flagged, test_method, round(test_statistic, 6) AS test_statistic, " + ", ".join(_DECIDED[6:]) + f" FROM {_DETECT}")
def detect_all(spark, sf):
    """Verdicts of all orders columns, before and after 2000."""
    a, b = map(_with_city, splits(spark, sf))
    return detect.Detector(_TYPES, "month").detect(a, b).select(*_DECIDED)


@query()
def detect_notes(spark, sf):
    """What the verdicts say in words, p-values among them."""
    return _verdicts(spark, sf).select("column", "notes", "phase_c_notes")


_ITEMS = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "scaled_tax": "CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN l_tax * 1.03 ELSE l_tax END"}
_EARLY, _LATE = "(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01')", "(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01')"

@query(
    f"""WITH k AS (SELECT feature, ks, round(n_train * n_test / (n_train + n_test)::DOUBLE) AS n, ks * sqrt(round(n_train * n_test / (n_train + n_test)::DOUBLE)) AS z FROM {_ks(_EARLY, _LATE, _ITEMS)}),
    w AS (SELECT *, list_sum(list_transform(range(1, 60), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2 * k * k * z * z) * (1 - 2 * k * k * z / (3 * sqrt(n))
      - (k * k - k % 2 - 4 * (k * k - k % 2 + 3) * k * k * z * z + 8 * k ** 4 * z ** 4) / (18 * n)
      + k * k * z / (27 * n ** 1.5) * ((5 * k * k + 22 - 15 * (k % 2)) ** 2 / 5.0 - 4 * (5 * k * k + 67 - 15 * (k % 2)) * k * k * z * z / 15.0 + 8 * k ** 4 * z ** 4)))) AS p FROM k)
    SELECT feature, round(ks, 6) AS ks, n::BIGINT AS n, round(least(1, greatest(0, p)), 4) AS p FROM w"""
)
def ks_p_values(spark, sf):
    """The finite-sample law over items shipped before and after 2000; in SQL the alternating series with corrections for the sample's size (Li-Chien)."""
    from tidemark.functions.special import kolmogorov_upper

    items = table(spark, sf, "lineitem")
    late = F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    items = items.withColumn("scaled_tax", F.when(late, F.col("l_tax") * 1.03).otherwise(F.col("l_tax")))
    told = []
    for r in drift.ks(items.where(~late), items.where(late), list(_ITEMS)).collect():
        n = round(r["n_train"] / (r["n_train"] + r["n_test"]) * r["n_test"])
        told.append((r["feature"], r["ks"], n, round(kolmogorov_upper(r["ks"], n), 4)))
    return spark.createDataFrame(told, "feature string, ks double, n long, p double")


@query(_detect_sql(p_values=True))
def verdict_p_values(spark, sf):
    """P-values of the verdicts of categories (chi-square) and of presence (normal), as numbers."""
    told = _verdicts(spark, sf).where("feature_type = 'categorical' OR feature_type = 'sparse'").where("prescreen_flagged")
    return told.select("column", "test_method", "p_value")


# ---- ranking, and the tables that show verdicts ----
_RANK_IN = f"(SELECT \"column\" AS feature, feature_type AS col_type, test_method AS test_used, coalesce(test_statistic, 0) AS raw_score, drift_severity FROM {_DETECT} WHERE drift_detected)"
_RANKED = f"""(WITH w AS (SELECT v.*, raw_score * CASE drift_severity WHEN 'SEVERE' THEN 3 WHEN 'MODERATE' THEN 2 WHEN 'MILD' THEN 1 ELSE 0 END * (SELECT sum(fraction ** 2) FROM {_WEIGHTS}) AS w FROM {_RANK_IN} v)
    SELECT feature, col_type, test_used, round(raw_score, 6) AS raw_score, round(w, 6) AS weighted_score, (row_number() OVER (ORDER BY w DESC, feature))::INT AS drift_rank, drift_severity FROM w)"""


@query(f"SELECT * FROM {_RANKED}")
def rank_drift(spark, sf):
    return rank.rank_drift(detect.rank_input(_verdicts(spark, sf)), splits(spark, sf)[1], "month")


@query(f"SELECT * FROM {_RANKED}")
def detect_and_rank(spark, sf):
    """The detector and the ranking in one go."""
    a, b = map(_with_city, splits(spark, sf))
    return rank.rank_drift(detect.rank_input(detect.Detector(_TYPES, "month").detect(a, b)), b, "month")


@query(f"SELECT feature FROM {_RANK_IN} WHERE lower(col_type) IN ('numerical', 'continuous') AND upper(drift_severity) IN ('MILD', 'MODERATE')")
def policy_features(spark, sf):
    return spark.createDataFrame([(f,) for f in mitigate.policy_features(detect.rank_input(_verdicts(spark, sf)))], "feature string")


@query(f"SELECT CASE WHEN drift_detected THEN drift_severity ELSE 'STABLE' END AS severity, count(*) AS n FROM {_DETECT} GROUP BY 1")
def severity_counts(spark, sf):
    return views.severity_counts(_verdicts(spark, sf))


@query(
    f"""SELECT count(*) AS tested, count(*) FILTER (prescreen_flagged) AS flagged, count(*) FILTER (drift_detected) AS confirmed, count(*) FILTER (phase_c_drift_is_temporal) AS temporal,
    count(*) FILTER (phase_c_drift_detected) AS upgraded FROM {_DETECT}"""
)
def phase_counts(spark, sf):
    return views.phase_counts(_verdicts(spark, sf))


@query(f"SELECT \"column\" FROM {_DETECT} WHERE lower(\"column\") LIKE '%pri%'")
def feature_search(spark, sf):
    return views.matching(_verdicts(spark, sf), "PRI").select("column")


@query(f"SELECT \"column\" FROM {_DETECT} WHERE contains(lower(\"column\"), 'price') OR contains('price', lower(\"column\")) ORDER BY lower(\"column\") <> 'price', \"column\" LIMIT 1")
def feature_lookup(spark, sf):
    return views.find_feature(_verdicts(spark, sf), "Price").select("column")


@query(f"SELECT \"column\" FROM {_DETECT} ORDER BY \"column\" LIMIT 5 OFFSET 5")
def verdict_page(spark, sf):
    return views.page(_verdicts(spark, sf), 1, "column", 5).select("column")


_WORST = "CASE drift_severity WHEN 'SEVERE' THEN 0 WHEN 'MODERATE' THEN 1 WHEN 'MILD' THEN 2 ELSE 3 END, test_statistic DESC NULLS LAST"


@query(f"SELECT \"column\", drift_severity FROM {_DETECT} ORDER BY {_WORST}, \"column\" LIMIT 4")
def worst_first(spark, sf):
    return views.by_severity(_verdicts(spark, sf)).limit(4).select("column", "drift_severity")


_IMPORTANCE = (("shifted", 0.4), ("month_no", 0.2), ("city", 0.15), ("moved", 0.1), ("status", 0.08), ("sparse_price", 0.04), ("o_totalprice", 0.02), ("rare", 0.01))
_IMPORTANCE_SQL = "(VALUES " + ", ".join(f"({k}, '{f}', {g}::DOUBLE)" for k, (f, g) in enumerate(_IMPORTANCE, 1)) + ") i(rank, feature, importance)"


def _importance(spark):
    return spark.createDataFrame([(k, f, g) for k, (f, g) in enumerate(_IMPORTANCE, 1)], "rank int, feature string, importance double")


@query(f"SELECT rank, i.feature, importance, coalesce(drift_severity, 'STABLE') AS drift_severity FROM {_IMPORTANCE_SQL} LEFT JOIN {_RANK_IN} v ON v.feature = i.feature ORDER BY rank LIMIT 5")
def importance_severity(spark, sf):
    return views.importance_severity(_importance(spark), _verdicts(spark, sf), 5).select("rank", "feature", "importance", "drift_severity")


@query(f"SELECT count(*) AS n FROM {_IMPORTANCE_SQL} JOIN {_RANK_IN} v ON v.feature = i.feature WHERE rank <= 7 AND drift_severity IN ('SEVERE', 'MODERATE')")
def drifted_among_top(spark, sf):
    return views.drifted_among_top(_importance(spark), _verdicts(spark, sf))


_ACTUAL = "CASE feature_type WHEN 'numerical' THEN 'quantile_binning' WHEN 'categorical' THEN 'target_encoding' WHEN 'high_cardinality' THEN 'frequency_encoding' ELSE 'binarise (sparse->binary)' END"


@query(
    f"""SELECT "column" AS feature, feature_type, drift_severity, test_method AS test_used, round(test_statistic, 6) AS test_statistic, {_ACTUAL} AS mitigation, phase_c_segment_stable, phase_c_drifted_months
    FROM {_DETECT} WHERE drift_detected"""
)
def drift_results_table(spark, sf):
    return writers.drift_results(_verdicts(spark, sf))


@query(
    f"""SELECT "column", feature_type, drift_severity, replace(replace(replace(replace({_ACTUAL}, 'quantile_binning', 'Quantile Binning'), 'target_encoding', 'Target Encoding (Laplace, m=10)'),
    'frequency_encoding', 'Frequency Encoding'), 'binarise (sparse->binary)', 'Binarisation') AS treatment,
    CASE WHEN phase_c_segment_stable THEN 'stable in all months' WHEN phase_c_drifted_months <> '' THEN phase_c_drifted_months ELSE '—' END AS segment FROM {_DETECT} WHERE drift_detected"""
)
def drift_report(spark, sf):
    """The console's table of drifted columns, without its sentences."""
    return report.drift_summary(_verdicts(spark, sf)).drop("description")


@query(f"SELECT \"column\" AS feature, replace(replace(replace(replace(test_method, 'Kolmogorov-Smirnov', 'KS'), 'Population Stability Index', 'PSI'), 'Jensen-Shannon Divergence', 'JS'), 'Two-Proportion Z-Test', 'Z') AS short FROM {_DETECT}")
def test_names(spark, sf):
    return _verdicts(spark, sf).select(F.col("column").alias("feature"), text.short_test_name(F.col("test_method")).alias("short"))


@query(f"SELECT \"column\" AS name, drift_severity AS severity FROM {_DETECT}")
def synonym_columns(spark, sf):
    return views.with_synonyms(_verdicts(spark, sf), {"name": ["feature", "column"], "severity": ["drift_severity"]}).select("name", "severity")


# ---- encoders ----


@query(
    f"""SELECT '{"status"}' AS feature, round(coalesce(avg((k.level IS NULL)::INT), 0), 6) AS rate FROM {TEST} t LEFT JOIN (SELECT DISTINCT {_norm('status')} AS level FROM {TRAIN} WHERE status IS NOT NULL) k ON {_level('t.status')} = k.level
    UNION ALL SELECT 'moved', round(coalesce(avg((k.level IS NULL)::INT), 0), 6) FROM {TEST} t LEFT JOIN (SELECT DISTINCT {_norm('moved')} AS level FROM {TRAIN} WHERE moved IS NOT NULL) k ON {_level('t.moved')} = k.level"""
)
def unseen_ratio(spark, sf):
    return mitigate.unseen_rates(*splits(spark, sf), ["status", "moved"])


def _iqr(source: str, c: str) -> str:
    return f"(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM {source})"


@query(
    f"""SELECT 'o_totalprice' AS feature, round({_iqr(TRAIN, 'o_totalprice')}, 4) AS iqr_train, round({_iqr(TEST, 'o_totalprice')}, 4) AS iqr_test, false AS collapsed
    UNION ALL SELECT 'flat', round({_iqr(TRAIN, 'o_totalprice')}, 4), 0.0, true""",
    digits=4,
)
def iqr_collapse(spark, sf):
    a, b = splits(spark, sf)
    return mitigate.iqr_collapse(a.withColumn("flat", F.col("o_totalprice")), b.withColumn("flat", F.lit(5.0)), ["o_totalprice", "flat"])


@query(f"SELECT o_orderkey, coalesce(code, 0) AS moved FROM {TEST} t LEFT JOIN (SELECT {_level('moved')} AS level, count(*) AS code FROM {TRAIN} GROUP BY 1) k ON {_level('t.moved')} = k.level")
def frequency_encode(spark, sf):
    a, b = splits(spark, sf)
    return mitigate.with_codes(b, "moved", mitigate.frequency_codes(a, "moved"), 0).select("o_orderkey", "moved")


_RATE = f"(SELECT avg((target = 'Yes')::INT) FROM {TRAIN})"
_CODES = f"(SELECT {_level('status')} AS level, (count(*) * avg((target = 'Yes')::INT) + 10 * {_RATE}) / (count(*) + 10) AS code FROM {TRAIN} GROUP BY 1)"


@query(f"SELECT level, round(code, 6) AS code FROM {_CODES}")
def target_codes(spark, sf):
    a = splits(spark, sf)[0]
    return mitigate.target_codes(a, "status", "target", "Yes", mitigate.global_rate(a, "target", "Yes"))


@query(f"SELECT o_orderkey, round(coalesce(code, {_RATE}), 6) AS status FROM {TEST} t LEFT JOIN {_CODES} k ON {_level('t.status')} = k.level")
def target_encode(spark, sf):
    a, b = splits(spark, sf)
    rate = mitigate.global_rate(a, "target", "Yes")
    return mitigate.with_codes(b, "status", mitigate.target_codes(a, "status", "target", "Yes", rate), rate).select("o_orderkey", "status")


@query(f"SELECT round({_RATE}, 6) AS rate")
def global_target_rate(spark, sf):
    a = splits(spark, sf)[0]
    return a.agg(F.avg(mitigate.positive(F.col("target"), "Yes")).alias("rate"))


_DECILES = f"(SELECT list_sort(list_distinct(quantile_cont(shifted, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) FROM {TRAIN})"


@query(f"SELECT o_orderkey, len(list_filter({_DECILES}, lambda b: b < shifted))::TINYINT AS shifted FROM {TEST}")
def quantile_bin(spark, sf):
    a, b = splits(spark, sf)
    fitted = mitigate.Mitigator().fit(a, b, {"shifted": "numerical"})
    return fitted.transform(b).select("o_orderkey", "shifted")


@query(f"SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS p, round(unnest(quantile_cont(shifted, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])), 4) AS value FROM {TRAIN}", digits=4)
def deciles(spark, sf):
    got = profile.quantiles(splits(spark, sf)[0], ["shifted"], [k / 10 for k in range(1, 10)])
    return got.select(F.posexplode("q").alias("k", "value")).select(((F.col("k") + 1) / 10).alias("p"), "value")


@query(f"SELECT o_orderkey, (coalesce(sparse_price, 0) <> 0)::TINYINT AS sparse_price, (status IS NOT NULL)::TINYINT AS status FROM {TEST}")
def binarise(spark, sf):
    b = splits(spark, sf)[1]
    return b.select("o_orderkey", *[present(b, c).cast("tinyint").alias(c) for c in ("sparse_price", "status")])


@query(f"SELECT o_orderkey, round((shifted - (SELECT median(shifted) FROM {TRAIN})) / {_iqr(TRAIN, 'shifted')}, 6) AS shifted FROM {TEST}")
def robust_scale(spark, sf):
    a, b = splits(spark, sf)
    q = profile.quantiles(a, ["shifted"], [0.25, 0.5, 0.75]).first()["q"]
    return b.select("o_orderkey", mitigate.robust_scale(F.col("shifted"), q[1], q[2] - q[0]).alias("shifted"))


@query(f"SELECT o_orderkey, round(shifted - (SELECT median(shifted) FROM {TRAIN}), 4) AS shifted FROM {TEST}", digits=4)
def delta_policy(spark, sf):
    a, b = splits(spark, sf)
    fitted = mitigate.Mitigator().fit(a, b, {"shifted": "numerical"})
    return mitigate.apply_policy("delta", ["shifted"], a, b, fitted).select("o_orderkey", "shifted")


@query(f"SELECT o_orderkey, shifted AS raw, len(list_filter({_DECILES}, lambda b: b < shifted))::TINYINT AS binned FROM {TEST}")
def none_and_binning_policies(spark, sf):
    """Raw values under one policy, bins under the other; under ``robust`` bins too."""
    a, b = splits(spark, sf)
    fitted = mitigate.Mitigator().fit(a, b, {"shifted": "numerical"})
    raw = mitigate.apply_policy("none", ["shifted"], a, b, fitted).select("o_orderkey", F.col("shifted").alias("raw"))
    kept = mitigate.apply_policy("binning", ["shifted"], a, b, fitted).select("o_orderkey", F.col("shifted").alias("binned"))
    return raw.join(kept, "o_orderkey")


@query(f"SELECT o_orderkey, coalesce(f.code, 0) AS brandlike, len(list_filter({_DECILES}, lambda b: b < shifted))::TINYINT AS shifted, (coalesce(sparse_price, 0) <> 0)::TINYINT AS sparse_price, round(coalesce(k.code, {_RATE}), 6) AS status FROM {TEST} t LEFT JOIN {_CODES} k ON {_level('t.status')} = k.level LEFT JOIN (SELECT {_level('o_orderpriority')} AS level, count(*) AS code FROM {TRAIN} GROUP BY 1) f ON {_level('t.o_orderpriority')} = f.level")
def mitigate_all(spark, sf):
    a, b = (df.withColumn("brandlike", F.col("o_orderpriority")) for df in splits(spark, sf))
    kinds = {"brandlike": "high_cardinality", "shifted": "numerical", "sparse_price": "sparse", "status": "categorical", "absent": "numerical"}
    return mitigate.Mitigator("target", "Yes").fit(a, b, kinds).transform(b).select("o_orderkey", "brandlike", "shifted", "sparse_price", "status")


# ---- projections, sources, sinks ----


@query("SELECT o_orderkey, NULL::DOUBLE AS fee FROM orders")
def align_missing_columns(spark, sf):
    """A feature that the test split lacks is filled with nulls; a target is not made up."""
    df = table(spark, sf, "orders").select("o_orderkey")
    return readers.aligned(df.withColumns({"target": F.lit("x"), "fee": F.lit(1.0)}), df, ("o_orderkey", "target"))


_TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)


@query(f"SELECT o_orderkey, CASE WHEN x NOT IN ({_TOKENS}) THEN x END AS x FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'NA' WHEN 1 THEN 'nan' WHEN 2 THEN '' WHEN 3 THEN 'none' ELSE o_orderpriority END AS x FROM orders)")
def null_token_map(spark, sf):
    k = F.col("o_orderkey") % 6
    x = F.when(k == 0, "NA").when(k == 1, "nan").when(k == 2, "").when(k == 3, "none").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", text.null_tokens(x).alias("x"))


@query(f"SELECT target AS label FROM (SELECT DISTINCT target FROM ({ORDERS_SQL}) WHERE target IS NOT NULL) WHERE lower(target) LIKE 'yes%'")
def label_detect(spark, sf):
    found = [r[0] for r in orders(spark, sf).where("target IS NOT NULL").select("target").distinct().collect()]
    return spark.createDataFrame([(text.positive_label(found),)], "label string")


@query(f"SELECT DISTINCT target FROM ({ORDERS_SQL}) WHERE target IS NOT NULL ORDER BY target")
def distinct_labels(spark, sf):
    return orders(spark, sf).where("target IS NOT NULL").select("target").distinct().orderBy("target")


@query(f"SELECT o_orderkey, o_totalprice FROM ({ORDERS_SQL}) WHERE target IS NOT NULL")
def drop_null_target(spark, sf):
    return orders(spark, sf).where(F.col("target").isNotNull()).select("o_orderkey", "o_totalprice")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature FROM (SELECT count({a}) AS n FROM {TRAIN}) x, (SELECT count({b}) AS n FROM {TEST}) y WHERE least(x.n, y.n) = 0"
        for c, a, b in (("o_totalprice", "o_totalprice", "o_totalprice"), ("gone", "status", "nullif(status, status)"), ("status", "status", "status"))
    )
)
def all_null_columns(spark, sf):
    a, b = splits(spark, sf)
    names = model.dead_columns(a.withColumn("gone", F.col("status")), b.withColumn("gone", F.lit(None).cast("string")), ["o_totalprice", "gone", "status"])
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query(f"SELECT column_name AS numbers FROM (DESCRIBE SELECT o_totalprice, status, shifted, sparse_price, moved FROM ({ORDERS_SQL})) WHERE column_type IN ('DOUBLE', 'BIGINT', 'INTEGER')")
def columns_by_type(spark, sf):
    df = orders(spark, sf).select("o_totalprice", "status", "shifted", "sparse_price", "moved")
    assert text_columns(df) == ["status", "moved"]
    return spark.createDataFrame([(c,) for c in numeric_columns(df)], "numbers string")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def pruned_read(spark, sf):
    """Id and target alone; where there is no target column, the id."""
    df = table(spark, sf, "orders")
    assert readers.pruned(df, "o_orderkey", "no such column").columns == ["o_orderkey"]
    return readers.pruned(df, "o_orderkey", "o_orderstatus")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, true AS real FROM (SELECT o_orderkey FROM orders LIMIT 100)")
def sample_rows(spark, sf):
    """A hundred rows, each once and each a row of the table; the same ones every time (by hash, which only Spark has)."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    some = readers.sample_rows(df, "o_orderkey", 100)
    again = readers.sample_rows(df.repartition(3), "o_orderkey", 100).select("o_orderkey", F.lit(True).alias("again"))
    told = some.join(again, "o_orderkey", "left").join(df.withColumnRenamed("o_totalprice", "price"), "o_orderkey", "left")
    return told.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.bool_and(F.coalesce(F.col("again"), F.lit(False)) & (F.col("price") == F.col("o_totalprice"))).alias("real"))


@query("SELECT k, k / 4.0::DOUBLE AS edge, k / 4.0::DOUBLE + 0.125 AS middle FROM range(4) t(k)")
def edges_and_midpoints(spark, sf):
    edges = spark.range(1).select(linspace(F.lit(0.0), F.lit(1.0), 4).alias("edges")).withColumn("middles", midpoints(F.col("edges")))
    return edges.select(F.posexplode(F.arrays_zip("edges", "middles")).alias("k", "p")).where("k < 4").select(F.col("k").cast("long").alias("k"), F.col("p.edges").alias("edge"), F.col("p.middles").alias("middle"))


@query("SELECT * FROM (VALUES ('1.5', 1.5::DOUBLE, 0), ('2', 2.0, 0), ('3', 3.0, 1), ('x', NULL, 0)) t(raw, value, bin)")
def safe_float_and_cut(spark, sf):
    df = spark.createDataFrame([("1.5",), ("2",), ("3",), ("x",)], "raw string").withColumn("value", number(safe_float(F.col("raw"))))
    return df.withColumn("bin", cut(F.col("value"), F.array(F.lit(2.0), F.lit(3.5))))


# ---- scores ----
def _half_up(x: str, digits: int) -> str:
    """Spark's rounding: ties of the number's shortest decimal go up. DuckDB's round() of a double scales it in binary first, which leaves ties to chance (0.285 gives 0.28)."""
    return f"round(({x})::DOUBLE::VARCHAR::DECIMAL(38, 20), {digits})::DOUBLE"


_SCORED = f"SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y, least(1.0, {_half_up('o_totalprice / 400000', 2)})::DOUBLE AS p FROM orders"


def _scored(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.least(F.lit(1.0), F.round(F.col("o_totalprice") / 400000, 2)).alias("p"))


@query(
    f"""WITH g AS (SELECT p, sum(y) AS tp, count(*) AS n FROM ({_SCORED}) GROUP BY p), c AS (SELECT tp, sum(tp) OVER w / (sum(n) OVER w)::DOUBLE AS pr, sum(tp) OVER () AS pos FROM g WINDOW w AS (ORDER BY p DESC))
    SELECT round(sum(tp / pos::DOUBLE * pr), 6) AS average_precision FROM c"""
)
def average_precision(spark, sf):
    return model.average_precision(_scored(spark, sf), "y", "p")


def _cells(t: float) -> str:
    return f"""SELECT {t}::DOUBLE AS threshold, count(*) FILTER (y = 1 AND p >= {t}) AS tp, count(*) FILTER (y <> 1 AND p >= {t}) AS fp,
      count(*) FILTER (y = 1 AND p < {t}) AS fn, count(*) FILTER (y <> 1 AND p < {t}) AS tn FROM ({_SCORED})"""


def _metrics(cells: str) -> str:
    r = lambda a, b: _half_up(f"coalesce({a} / nullif({b}, 0)::DOUBLE, 0)", 6)
    return f"""SELECT *, {r('(tp + tn)', '(tp + fp + fn + tn)')} AS accuracy, {r('tp', '(tp + fp)')} AS precision, {r('tp', '(tp + fn)')} AS recall,
      {r('2 * tp', '(2 * tp + fp + fn)')} AS f1, {r('tn', '(tn + fp)')} AS specificity FROM ({cells})"""


@query(f"SELECT * EXCLUDE (threshold) FROM ({_metrics(_cells(0.5))})")
def confusion_metrics(spark, sf):
    return model.confusion(_scored(spark, sf), "y", "p")


@query(_metrics(" UNION ALL ".join(map(_cells, model.SWEEP))))
def confusion_curve(spark, sf):
    """All 81 thresholds of the slider."""
    return model.confusion_curve(_scored(spark, sf), "y", "p", model.SWEEP)


@query(f"SELECT count(DISTINCT y) AS classes FROM ({_SCORED})")
def target_classes(spark, sf):
    return _scored(spark, sf).agg(F.count_distinct("y").alias("classes"))


@query(f"SELECT CAST(s.o_orderkey AS VARCHAR) AS o_orderkey, p AS probability_score, target FROM ({_SCORED}) s JOIN ({ORDERS_SQL}) o USING (o_orderkey)")
def predictions_with_labels(spark, sf):
    scored = writers.predictions(_scored(spark, sf).withColumnRenamed("p", "probability_score"), "o_orderkey")
    return model.joined_scores(scored, orders(spark, sf).select("o_orderkey", "target"), "o_orderkey")


# ---- views ----


@query(
    f"""WITH r AS (SELECT 'train' AS split, shifted AS x FROM {TRAIN} UNION ALL SELECT 'test', shifted FROM {TEST}), e AS (SELECT min(x) AS lo, max(x) AS hi FROM r),
    b AS (SELECT split, least(floor((x - lo) / ((hi - lo) / 30)) + 1, 30)::INT AS bin FROM r, e)
    SELECT split, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split)::DOUBLE, 6) AS share FROM b GROUP BY split, bin"""
)
def hist_equal_width(spark, sf):
    return views.hist_equal_width(*splits(spark, sf), "shifted")


_EDGES = f"(SELECT list_sort(list_distinct(quantile_cont(shifted, [{', '.join(str(k / 20) for k in range(21))}]))) AS e FROM {TRAIN})"


@query(
    f"""WITH r AS (SELECT 'train' AS split, shifted AS x FROM {TRAIN} UNION ALL SELECT 'test', shifted FROM {TEST})
    SELECT split, greatest(len(list_filter(e, lambda b: b < x)) - 1, 0)::INT AS bin, count(*) AS n FROM r, {_EDGES} WHERE x >= e[1] AND x <= e[-1] GROUP BY 1, 2"""
)
def hist_quantile_edges(spark, sf):
    return views.hist_quantile_edges(*splits(spark, sf), "shifted")


_TENTHS = f"(SELECT quantile_cont(shifted, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM {TRAIN})"


@query(
    " UNION ALL ".join(
        f"""SELECT '{name}' AS split, k::INT AS bin, (SELECT count(*) FROM {source} WHERE shifted <= e[k + 2] AND (shifted > e[k + 1] OR k = 0 AND shifted = e[1])) AS n,
        round((SELECT count(*) FROM {source} WHERE shifted <= e[k + 2] AND (shifted > e[k + 1] OR k = 0 AND shifted = e[1])) / (SELECT count(shifted) FROM {source})::DOUBLE, 6) AS share FROM {_TENTHS}, range(10) t(k)"""
        for name, source in (("train", TRAIN), ("test", TEST))
    )
)
def hist_occupancy(spark, sf):
    return views.hist_occupancy(*splits(spark, sf), "shifted")


@query(f"SELECT coalesce(trim(lower(status)), '(null)') AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM ({ORDERS_SQL}) GROUP BY 1")
def category_shares(spark, sf):
    return views.category_shares(orders(spark, sf), "status")


@query(f"SELECT trim(lower(brand_type)) AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM ({ITEMS_SQL}))::DOUBLE, 6) AS share FROM ({ITEMS_SQL}) GROUP BY 1 ORDER BY n DESC, category LIMIT 20")
def topn_categories(spark, sf):
    return views.top_categories(items(spark, sf), "brand_type")


@query(f"SELECT coalesce(trim(lower(status)), '(null)') AS category, count(*) AS n, round(avg((target = 'Yes')::INT), 6) AS rate FROM ({ORDERS_SQL}) GROUP BY 1")
def category_rates(spark, sf):
    return views.category_rates(orders(spark, sf).withColumn("y", mitigate.positive(F.col("target"), "Yes")), "status", "y")


def _cube(spark, sf):
    """The cube of the orders' charts: made once for the queries below, and again where the files change."""

    def make():
        a, b = (df.withColumn("y", mitigate.positive(F.col("target"), "Yes")) for df in splits(spark, sf))
        return cube.chart_cube(a, b, ["shifted", "o_totalprice"], ["status", "moved"], "month", "y")

    return store.kept(spark, "cube", [f"{sf}/orders.parquet"], cube.BINS, make)


@query(_SQL["hist_equal_width"])
def cube_equal_width(spark, sf):
    return cube.histogram(_cube(spark, sf), "shifted", "width")


@query(_SQL["hist_quantile_edges"])
def cube_quantile_edges(spark, sf):
    return cube.histogram(_cube(spark, sf), "shifted", "rank").drop("share")


@query(f"SELECT split, bin, n, round(n / sum(n) OVER (PARTITION BY split)::DOUBLE, 6) AS share FROM ({_SQL['hist_occupancy']}) WHERE n > 0")
def cube_occupancy(spark, sf):
    """Shares are of the rows within the bins, empty bins are left out."""
    return cube.histogram(_cube(spark, sf), "shifted", "tenth")


@query(_SQL["category_shares"])
def cube_category_shares(spark, sf):
    return cube.levels(_cube(spark, sf), "status").drop("rate")


@query(_SQL["category_rates"])
def cube_category_rates(spark, sf):
    return cube.levels(_cube(spark, sf), "status").drop("share")


@query(
    f"""WITH r AS (SELECT moved FROM {TRAIN} WHERE month IN (SELECT DISTINCT month FROM {TRAIN} ORDER BY month DESC LIMIT 3))
    SELECT trim(lower(moved)) AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM r GROUP BY 1"""
)
def cube_recent_months(spark, sf):
    """Categories of train's three recent months."""
    recent = [r["month"] for r in months.recent_months(splits(spark, sf)[0], "month").collect()]
    return cube.of_months(_cube(spark, sf), "moved", "train", recent)


@query(
    f"SELECT 'train' AS split, round(median(shifted), 4) AS median, round({_iqr(TRAIN, 'shifted')}, 4) AS iqr FROM {TRAIN} UNION ALL SELECT 'test', round(median(shifted), 4), round({_iqr(TEST, 'shifted')}, 4) FROM {TEST}", digits=4
)
def robust_view(spark, sf):
    return views.robust_view(*splits(spark, sf), "shifted")


@query("SELECT DISTINCT l_quantity AS x, count(*) OVER (PARTITION BY l_quantity) AS n, round(count(*) OVER (ORDER BY l_quantity) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS ecdf FROM lineitem")
def ecdf(spark, sf):
    return views.ecdf(table(spark, sf, "lineitem"), "l_quantity")


_GAPS = f"""(WITH v AS (SELECT x, sum(a) AS a, sum(b) AS b FROM (SELECT shifted AS x, 1 AS a, 0 AS b FROM {TRAIN} UNION ALL SELECT shifted, 0, 1 FROM {TEST}) GROUP BY x)
  SELECT x, round(abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()), 12) AS gap FROM v WINDOW w AS (ORDER BY x))"""


@query(f"SELECT round(x, 6) AS x, round(gap, 6) AS gap FROM {_GAPS} ORDER BY gap DESC, x LIMIT 1")
def ecdf_gap(spark, sf):
    return views.ecdf_gap(*splits(spark, sf), "shifted")


@query(f"SELECT count(*) AS features FROM ({' UNION ALL '.join(_classified(c, kind) for c, (_, kind) in _TYPED.items())}) WHERE feature_type NOT IN ('metadata', 'time', 'target')")
def feature_count(spark, sf):
    """Of the classified columns, those that are features: constant ones count."""
    types = {r["name"]: r["feature_type"] for r in classify_columns(spark, sf).collect()}
    return spark.createDataFrame([(views.feature_count(types),)], "features long")


# ---- models, files and streams ----
_FEATURES = ["o_totalprice", "sparse_price", "o_orderpriority", "status", "customer"]


@query()
def gbt_scores(spark, sf):
    """Test rows with the probability that trees of the default size give them; ``customer`` has more levels than trees take as nominal."""
    a, b = (df.withColumn("customer", F.concat(F.lit("customer "), "o_custkey")) for df in splits(spark, sf))
    return model.score(model.fit(a, _FEATURES, mitigate.positive(F.col("target"), "Yes")), b, ["o_orderkey"])


#: What one tree is grown on: (name, SQL, whether it is a number); ``gap`` misses values.
_GROWN = (("o_totalprice", "o_totalprice", True), ("status", "status", False), ("o_orderpriority", "o_orderpriority", False), ("gap", "CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END", True))


def _tree_sql(depth: int, bins: int = 64) -> str:
    """One boosted tree of a depth, level by level: histograms, running sums, the best split of each node, and the side every row goes to."""
    numbers, texts = [k for k, f in enumerate(_GROWN) if f[2]], [k for k, f in enumerate(_GROWN) if not f[2]]
    norm = "regexp_replace(regexp_replace(regexp_replace(lower({}), '^\\s+|\\s+$', '', 'g'), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')"
    probs = "[" + ", ".join(f"{k}::DOUBLE / {bins}" for k in range(1, bins)) + "]"
    source = ", ".join(f"{e}::DOUBLE AS x{k}" if n else f"{norm.format(e)} AS b{k}" for k, (_, e, n) in enumerate(_GROWN))
    binned = ", ".join(f"CASE WHEN x{k} IS NOT NULL THEN len(list_filter((SELECT q{k} FROM edges), lambda e: e < x{k})) END AS b{k}" if k in numbers else f"b{k}" for k in range(len(_GROWN)))
    parts = [
        f"""source AS (SELECT o_orderkey, is_train, CASE WHEN target = 'Yes' THEN 1 WHEN target IS NOT NULL THEN 0 END AS y, {source}
  FROM (SELECT *, true AS is_train FROM {TRAIN} UNION ALL SELECT *, false FROM {TEST}))""",
        "edges AS (SELECT " + ", ".join(f"list_distinct(quantile_cont(x{k}, {probs})) AS q{k}" for k in numbers) + " FROM source WHERE is_train AND y IS NOT NULL)",
        "shares AS (SELECT avg(y) AS s FROM source WHERE is_train AND y IS NOT NULL)",
        f"""r0 AS MATERIALIZED (SELECT o_orderkey, is_train AND y IS NOT NULL AS learns, CASE WHEN y = 1 THEN 0.5 / s ELSE 0.5 / (1 - s) END * (0.5 - y) AS g,
  CASE WHEN y = 1 THEN 0.5 / s ELSE 0.5 / (1 - s) END * 0.25 AS h, 1 AS node, 0.0::DOUBLE AS v, NOT is_train AS tested, {binned} FROM source, shares)""",
    ]
    gain = "{0} * {0} / ({1} + 1)"
    for d in range(depth):
        long = " UNION ALL ".join(f"SELECT node, {k} AS f, {'b%d' % k if k in numbers else 'NULL::BIGINT'} AS num, {'b%d' % k if k in texts else 'NULL::VARCHAR'} AS lev, g, h FROM r{d} WHERE learns AND node > 0" for k in range(len(_GROWN)))
        level_of = "CASE b.f " + " ".join(f"WHEN {k} THEN r.b{k}" for k in texts) + " END"
        number_of = "CASE b.f " + " ".join(f"WHEN {k} THEN r.b{k}" for k in numbers) + " END"
        parts += [
            f"hist{d} AS (SELECT node, f, num, lev, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({long}) GROUP BY ALL)",
            f"""sums{d} AS (SELECT *, CASE WHEN f IN ({', '.join(map(str, texts))}) THEN g / (h + 10) ELSE num END AS o, num IS NULL AND lev IS NULL AS missing,
  sum(g) OVER e AS ga, sum(h) OVER e AS ha, sum(n) OVER e AS na FROM hist{d} WINDOW e AS (PARTITION BY node, f))""",
            f"""lost{d} AS (SELECT node, f, g AS gm, h AS hm, n AS nm FROM sums{d} WHERE missing)""",
            f"""upto{d} AS MATERIALIZED (SELECT s.*, coalesce(gm, 0) AS gm, coalesce(hm, 0) AS hm, coalesce(nm, 0) AS nm, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, row_number() OVER w AS pos
  FROM sums{d} s LEFT JOIN lost{d} USING (node, f) WHERE NOT missing WINDOW w AS (PARTITION BY node, f ORDER BY o, lev ROWS UNBOUNDED PRECEDING))""",
            f"""sides{d} AS (SELECT node, f, num, pos, ga, ha, na, false AS ml, gl AS g, hl AS h, nl AS n FROM upto{d} UNION ALL SELECT node, f, num, pos, ga, ha, na, true, gl + gm, hl + hm, nl + nm FROM upto{d} WHERE nm > 0)""",
            f"""best{d} AS MATERIALIZED (SELECT *, {gain.format('g', 'h')} + {gain.format('(ga - g)', '(ha - h)')} - {gain.format('ga', 'ha')} AS gain FROM sides{d}
  WHERE least(n, na - n) >= 20 AND least(h, ha - h) >= 0.001 AND {gain.format('g', 'h')} + {gain.format('(ga - g)', '(ha - h)')} - {gain.format('ga', 'ha')} > 1e-9
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, pos, ml) = 1)""",
            f"listed{d} AS (SELECT u.node, u.lev FROM upto{d} u JOIN best{d} b ON u.node = b.node AND u.f = b.f AND u.pos <= b.pos WHERE u.lev IS NOT NULL)",
            f"""went{d} AS (SELECT r.*, b.node IS NOT NULL AS splits, coalesce(CASE WHEN b.f IN ({', '.join(map(str, texts))}) THEN CASE WHEN {level_of} IS NOT NULL THEN l.lev IS NOT NULL END ELSE {number_of} <= b.num END, b.ml) AS goes_left,
  b.g AS bg, b.h AS bh, b.ga, b.ha FROM r{d} r LEFT JOIN best{d} b ON r.node = b.node LEFT JOIN listed{d} l ON l.node = r.node AND l.lev = {level_of})""",
            f"""r{d + 1} AS MATERIALIZED (SELECT * EXCLUDE (splits, goes_left, bg, bh, ga, ha) REPLACE (CASE WHEN NOT splits THEN -abs(node) WHEN goes_left THEN 2 * node ELSE 2 * node + 1 END AS node,
  CASE WHEN NOT splits THEN v WHEN goes_left THEN -0.1 * bg / (bh + 1) ELSE -0.1 * (ga - bg) / (ha - bh + 1) END AS v) FROM went{d})""",
        ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT o_orderkey, round(1 / (1 + exp(-v)), 6) AS probability_score FROM r{depth} WHERE tested"


def _one_tree(spark, sf, depth: int):
    from tidemark.operators import boost

    a, b = (df.withColumn("gap", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))) for df in splits(spark, sf))
    grown = boost.fit(a, [f[0] for f in _GROWN], mitigate.positive(F.col("target"), "Yes"), trees=1, depth=depth)
    return boost.score(grown, b, ["o_orderkey"])


@query(_tree_sql(1))
def boosted_stump(spark, sf):
    """Test rows with the probability of one split."""
    return _one_tree(spark, sf, 1)


@query(_tree_sql(2))
def boosted_depth_two(spark, sf):
    """Test rows with the probability of one tree of depth two."""
    return _one_tree(spark, sf, 2)


@query()
def boosted_scores(spark, sf):
    """Test rows with the probability that boosted trees of the default size give them; ``customer`` has a level for each customer."""
    from tidemark.operators import boost

    a, b = (df.withColumn("customer", F.concat(F.lit("customer "), "o_custkey")) for df in splits(spark, sf))
    return boost.score(boost.fit(a, _FEATURES, mitigate.positive(F.col("target"), "Yes")), b, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, CASE WHEN l_quantity > 45 THEN l_returnflag END AS flag FROM lineitem")
def csv_roundtrip(spark, sf):
    """Written as CSV with NA for null, read back with inferred types."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_quantity") > 45, F.col("l_returnflag")).otherwise("NA").alias("flag"))
    path = f"{store.scratch(spark)}/items.csv"
    writers.write_csv(df, path)
    return readers.read_csv(spark, path)


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity,
  CASE WHEN l_linenumber % 3 = 0 THEN 'first' || chr(10) || 'said "' || l_returnflag || '", ' || chr(10) || chr(10) || 'last' ELSE l_returnflag END AS note FROM lineitem""")
def csv_line_breaks(spark, sf):
    """Quoted fields with line breaks, quotes and commas, written as CSV and read back in splits that end anywhere in them."""
    note = F.concat(F.lit('first\nsaid "'), "l_returnflag", F.lit('", \n\nlast'))
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_linenumber") % 3 == 0, note).otherwise(F.col("l_returnflag")).alias("note"))
    path = f"{store.scratch(spark)}/items.csv"
    writers.write_csv(items, path)
    return readers.read_csv(spark, path)


@query(f"SELECT (SELECT count(*) FROM {TRAIN}) AS n_train, (SELECT count(*) FROM {TEST}) AS n_test, 10::BIGINT AS n_features, 0.123457::DOUBLE AS au_prc_train, 1.5::DOUBLE AS runtime_seconds")
def meta_roundtrip(spark, sf):
    """The run's figures, rounded, written as JSON and read back."""
    path = f"{store.scratch(spark)}/pipeline_meta.json"
    a, b = splits(spark, sf)
    writers.meta(spark, a.count(), b.count(), views.feature_count(_TYPES), 0.1234567, 1.499).write.mode("overwrite").json(path)
    return readers.read_table(spark, path).select("n_train", "n_test", "n_features", "au_prc_train", "runtime_seconds")


_EVENT = _freq("(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15')", "event_type")


@query(
    f"""WITH r AS (SELECT category, freq AS p FROM {_EVENT}), d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, {_level('event_type')} AS category, count(*) AS n FROM events GROUP BY 1, 2),
    t AS (SELECT day, sum(n) AS total FROM d GROUP BY day), g AS (SELECT day, total, category, p FROM t, r),
    b AS (SELECT coalesce(g.day, d.day) AS day, greatest(coalesce(p, 0), 1e-6) AS p, greatest(coalesce(n / t.total::DOUBLE, 0), 1e-6) AS q FROM g FULL JOIN d ON g.day = d.day AND g.category = d.category LEFT JOIN t ON t.day = coalesce(g.day, d.day)),
    x AS (SELECT day, sum((q - p) * ln(q / p)) AS psi FROM b GROUP BY day)
    SELECT day, round(psi, 6) AS psi, {_severity('psi', 0.1, 0.25, 0.5)} AS severity FROM x"""
)
def stream_window_psi(spark, sf):
    """Extension: PSI of each day's event types against the first two weeks, by a stream that runs what is there; the last day too."""
    from tidemark.streaming.drift_stream import latest_counts, monitor, window_psi

    events = table(spark, sf, "events")
    reference = frequency.category_freq(events.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), ["event_type"])
    where = store.scratch(spark)
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    monitor(stream, "ts", "event_type", f"{where}/counts", f"{where}/checkpoint").awaitTermination()
    told = window_psi(latest_counts(spark, f"{where}/counts"), reference)
    return told.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "psi", "severity")


def _event_stream(spark, sf):
    return spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query(
    """WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS s FROM events)
    SELECT strftime(s, '%Y-%m-%d %H') AS window_start, event_type AS category, count(*) AS n FROM w GROUP BY ALL"""
)
def stream_sliding_counts(spark, sf):
    """Extension: event types by day windows that begin every twelve hours."""
    from tidemark.streaming.drift_stream import latest_counts, monitor

    where = store.scratch(spark)
    monitor(_event_stream(spark, sf), "ts", "event_type", f"{where}/counts", f"{where}/checkpoint", slide="12 hours").awaitTermination()
    return latest_counts(spark, f"{where}/counts").select(F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "category", "n")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS category, count(*) AS n FROM events GROUP BY ALL")
def stream_without_repeats(spark, sf):
    """Extension: every event sent twice counts once."""
    from tidemark.streaming.drift_stream import latest_counts, monitor

    where = store.scratch(spark)
    twice = _event_stream(spark, sf).union(_event_stream(spark, sf))
    monitor(twice, "ts", "event_type", f"{where}/counts", f"{where}/checkpoint", ids=["event_id"]).awaitTermination()
    return latest_counts(spark, f"{where}/counts").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "category", "n")


@query(
    """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours' AS apart FROM events),
    s AS (SELECT user_id, ts, sum(coalesce(apart, true)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
    x AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL '6 hours' AS b, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS session_end, n FROM x
    WHERE b <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL '1 hour'"""
)
def stream_sessions(spark, sf):
    """Extension: users' sessions, apart by six hours without an event, that the watermark has closed."""
    from tidemark.streaming.drift_stream import closed_sessions

    where = store.scratch(spark)
    closed_sessions(_event_stream(spark, sf), "ts", "user_id", f"{where}/sessions", f"{where}/checkpoint", gap="6 hours").awaitTermination()
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.parquet(f"{where}/sessions").select("user_id", shown("session_start"), shown("session_end"), "n")
