"""Quality rules whose cut-offs come from labelled rows with a guarantee on how many good documents they may reject.

Each rule is a whole number a document has (shares in thousandths, mean word lengths in hundredths) and a fixed ladder of cut-offs; a
document above the cut-off is rejected. All labelled documents that pass the base rules are the holdout: nothing is fitted on them
but the choice of a step. For each stratum and step, the good documents above the cut-off are counted; the step is certified where the exact
binomial probability of so few, were the true share of false rejections ``risk / rules`` or more, is at most ``doubt`` / (strata x rules).
Steps of a ladder are nested, so they are tested from the laxest on and end at the first that fails, which needs no correction for
their number; strata and rules are corrected for by Bonferroni. With probability 1 - ``doubt``, all rules together reject at most ``risk`` of
the good documents in every stratum. Of the certified steps that with most rejected bad documents is taken, of equals the laxest; a step that
rejects no bad document is none. Strata with too few good documents for any step get no cut-off, and only the base rules hold there.

All of it is built-in functions. A text's repeated windows are found in its own row: hashes of windows of words go through a set first, and only
texts where two are equal have them sorted with their positions, so cost grows with n log n of a text and no word is shuffled.
Two different windows of one text with the same 64-bit hash would count as equal; a text of a million words has that with a chance below one in
10^7. What is counted is written as a table of a few numbers a document; holdout counts are one row a stratum after partial sums.

Defined results. Null texts have no words and fail the base rules, as empty ones and those of white space do. Very long texts take some 150 bytes of
memory a word in one task. Null strata are a stratum. Labels: an id is good where any of its rows has quality 1, bad where all have
another, and unlabelled where none has a value; null ids have no label, an id that repeats has its label on every row. Repeated rows are repeated in
the result. Without labels or documents only base rules decide. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

WINDOW = 8
#: Base rules: fewest words, and the most words in repeated windows, per hundred.
FEWEST, MOST_REPEATED = 20, 30
#: A table of cut-offs is broadcast up to so many strata; beyond, Spark joins it as it joins any table.
BROADCAST_STRATA = 10_000
_SPACE = r"[\x20\x09-\x0D]"
_SHARES = (5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 600, 800)


@dataclass(frozen=True)
class Rule:
    """A whole number of a document, as SQL over its counts that any engine reads, and cut-offs from the strictest to the laxest."""

    name: str
    value: str
    ladder: tuple[int, ...]


RULES = (
    Rule("symbols", "1000 * n_symbols", _SHARES),
    Rule("dup_lines", "1000 * n_dup_lines", _SHARES),
    Rule("repeats", "1000 * n_repeat_words", _SHARES),
    Rule("short_words", "-100 * word_chars", tuple(range(-400, -99, 25))),
    Rule("long_words", "100 * word_chars", tuple(range(600, 2001, 100))),
)
#: What each rule's number is divided by, rounded down; at least one.
PER = {"symbols": "word_chars", "dup_lines": "n_lines", "repeats": "n_words", "short_words": "n_words", "long_words": "n_words"}


def counted(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_lines (those with a word), n_dup_lines and n_repeat_words of ``text``."""
    names = [f"tm_keep{k}__" for k in range(len(keep))]
    rows = docs.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        *names, "text", F.array_remove(F.split("text", f"{_SPACE}+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    rows = rows.select(
        *names, F.size("words").cast("long").alias("n_words"), F.char_length(F.regexp_replace("text", f"{_SPACE}+", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.when(F.size("words") > WINDOW, windows).alias("hashes"),
    )
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    pairs = F.when(twice, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    numbers = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
    rows = rows.select(*names, *numbers, pairs.alias("pairs"))
    hash_at = lambda k: F.get("pairs", k)["h"]
    again = F.filter("pairs", lambda p, k: p["h"].eqNullSafe(hash_at(k - 1)) | p["h"].eqNullSafe(hash_at(k + 1)))
    rows = rows.select(*names, *numbers, F.sort_array(F.transform(again, lambda p: p["i"])).alias("starts"))
    own = F.transform("starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(own, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return rows.select(*[F.col(n).alias(f"keep{k}") for k, n in enumerate(names)], *numbers, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def value(rule: Rule) -> Column:
    return F.expr(f"cast(floor(({rule.value}) / cast(greatest({PER[rule.name]}, 1) as double)) as long)")


def tail(k: Column, n: Column, share: float) -> Column:
    """The logarithm of the probability of at most ``k`` of ``n`` at a share, summed term by term."""
    start = n * math.log1p(-share)

    def more(held: Column, i: Column) -> Column:
        term = F.when(i == 0, start).otherwise(held["term"] + F.log((n - i + 1) / F.greatest(i, F.lit(1))) + math.log(share / (1 - share)))
        total = F.when(i == 0, start).otherwise(F.greatest(held["total"], term) + F.log1p(F.exp(-F.abs(held["total"] - term))))
        return F.struct(term.alias("term"), total.alias("total"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total")), more, lambda held: held["total"])


def cutoffs(holdout: DataFrame, risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """(stratum, cut_<rule>...): the cut-offs of strata that have any, from (stratum, good, counts...) of labelled documents that pass the base rules."""
    steps = [(r, c) for r in RULES for c in r.ladder]
    met = lambda good, r, c: F.sum(((F.col("good") == good) & (F.col(r.name) > c)).cast("long"))
    counts = holdout.select("stratum", "good", *[value(r).alias(r.name) for r in RULES]).groupBy("stratum").agg(
        F.sum(F.col("good").cast("long")).alias("n"),
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(c).alias("cutoff"), met(True, r, c).alias("good"), met(False, r, c).alias("bad")) for r, c in steps]).alias("steps"),
    )
    counts = cut(counts)
    strata, share = max(1, counts.count()), risk / len(RULES)
    each = counts.select("stratum", "n", F.explode("steps").alias("step")).select("stratum", "n", "step.*")
    level = math.log(doubt / (strata * len(RULES)))
    certified = each.where((F.col("bad") > 0) & F.when(F.col("good") <= share * F.col("n"), tail(F.col("good"), F.col("n"), share) <= level).otherwise(False))
    best = certified.groupBy("stratum", "rule").agg(F.max(F.struct("bad", "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"cut_{r.name}") for r in RULES])


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, rejected_by) of every row of (doc_id, text, stratum); labels: (doc_id, quality)."""
    rows = cut(counted(docs, F.col("doc_id"), F.col(stratum)).withColumnsRenamed({"keep0": "doc_id", "keep1": "stratum"}).withColumn("base_failed", base_failed()))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg((F.max((F.col("quality") == 1).cast("int")) == 1).alias("good"))
    holdout = rows.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("label_id"))
    chosen = cut(cutoffs(holdout, risk, doubt).withColumnRenamed("stratum", "of"))
    if chosen.count() <= BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    done = rows.join(chosen, F.col("stratum").eqNullSafe(F.col("of")), "left")
    above = F.filter(F.array(*[F.when(value(r) > F.col(f"cut_{r.name}"), F.lit(r.name)) for r in RULES]), lambda x: x.isNotNull())
    reasons = F.when(F.col("base_failed"), F.lit("base")).otherwise(F.array_join(above, ","))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (reasons == "").alias("kept"), reasons.alias("rejected_by"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op12_sql(risk: float = 0.02, doubt: float = 0.05) -> str:
    """Windows compared word by word, and the binomial sum by the gamma function."""
    share = risk / len(RULES)
    steps = ", ".join(f"('{r.name}', {c})" for r in RULES for c in r.ladder)
    values = ", ".join(f"CAST(floor(({r.value}) / CAST(greatest({PER[r.name]}, 1) AS DOUBLE)) AS BIGINT) AS {r.name}" for r in RULES)
    of_rule = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN h.{r.name}" for r in RULES) + " END"
    cuts = ", ".join(f"max(cutoff) FILTER (rule = '{r.name}') AS cut_{r.name}" for r in RULES)
    above = ", ".join(f"CASE WHEN v.{r.name} > c.cut_{r.name} THEN '{r.name}' END" for r in RULES)
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r}))"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
starts AS (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
again AS (SELECT rid, i FROM (SELECT rid, i, words[i : i + {WINDOW - 1}] AS win FROM starts) QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY rid),
f AS MATERIALIZED (SELECT d.rid, d.doc_id, d.lang, CAST(len(w.words) AS BIGINT) AS n_words, CAST(length(array_to_string(w.words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(w.lines) AS BIGINT) AS n_lines,
  CAST(len(w.lines) - len(list_distinct(w.lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN covered c USING (rid)),
v AS MATERIALIZED (SELECT *, n_words < {FEWEST} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {values} FROM f),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS MATERIALIZED (SELECT v.*, l.good FROM v JOIN l USING (doc_id) WHERE NOT base_failed),
sizes AS (SELECT lang, count(*) FILTER (good) AS n FROM h GROUP BY lang),
steps(rule, cutoff) AS (VALUES {steps}),
counts AS (SELECT h.lang, rule, cutoff, count(*) FILTER (good AND {of_rule} > cutoff) AS k, count(*) FILTER (NOT good AND {of_rule} > cutoff) AS bad
  FROM h, steps GROUP BY h.lang, rule, cutoff),
certified AS (SELECT c.lang, rule, cutoff, bad FROM counts c JOIN sizes s ON c.lang IS NOT DISTINCT FROM s.lang
  WHERE bad > 0 AND k <= {share!r} * n AND list_sum(list_transform(range(k + 1), lambda i: {term})) <= {doubt!r} / ((SELECT count(*) FROM sizes) * {len(RULES)})),
best AS (SELECT lang, rule, arg_max(cutoff, bad * 100000 + cutoff) AS cutoff FROM certified GROUP BY lang, rule),
c AS (SELECT lang, true AS found, {cuts} FROM best GROUP BY lang),
told AS (SELECT v.*, CASE WHEN base_failed THEN 'base' ELSE array_to_string(list_filter([{above}], lambda x: x IS NOT NULL), ',') END AS rejected_by
  FROM v LEFT JOIN c ON v.lang IS NOT DISTINCT FROM c.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by = '' AS kept, rejected_by FROM told
"""


OP12_SQL = _op12_sql()
