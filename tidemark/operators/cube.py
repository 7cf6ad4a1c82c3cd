"""One cube behind all charts: counts and positive labels by split, month, and bin or category of every feature, from one scan of each split.

A number is placed in equal widths over the joint range (``width``) and between train's quantiles (``rank`` and ``tenth``), a text in its label in
lower case (``level``). Grouping sets give each place in total and by month; a chart reads the few rows of its feature and never the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import cut, number, ratio
from tidemark.operators.profile import exact_quantiles

#: Bins of each kind of place of a number.
BINS = {"width": 30, "rank": 20, "tenth": 10}


def _slots(x: Column, lo: float, hi: float, edges: dict[str, list[float]]) -> dict[str, Column]:
    """A number's bin of each kind; null where it is outside."""
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    out = {"width": F.least(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(BINS["width"])), F.lit(BINS["width"]))}
    for kind, e in edges.items():
        out[kind] = F.when((x >= e[0]) & (x <= e[-1]), F.greatest(cut(x, F.array(*map(F.lit, e))) - 1, F.lit(0)))
    return out


def chart_cube(train: DataFrame, test: DataFrame, numbers: Sequence[str], texts: Sequence[str], month: str | None = None, y: str | None = None) -> DataFrame:
    """(feature, kind, split, month, slot, every_month, n, known, positive): ``every_month`` marks rows over all months, others are of one.

    ``slot`` is a bin's number or a label as text; ``known`` counts labels that are not null, ``positive`` those that are one.
    """
    side = lambda df, s: df.select(
        F.lit(s).alias("split"), (F.col(month).cast("string") if month else F.lit(None).cast("string")).alias("month"), (F.col(y).cast("int") if y else F.lit(None).cast("int")).alias("y"),
        *[number(F.col(c)).alias(f"x{k}") for k, c in enumerate(numbers)], *[F.coalesce(F.trim(F.lower(F.col(c).cast("string"))), F.lit("(null)")).alias(f"t{k}") for k, c in enumerate(texts)],
    )
    both = side(train, "train").unionByName(side(test, "test"))
    places = []
    if numbers:
        ends = both.agg(*[f(f"x{k}").alias(f"{n}{k}") for k in range(len(numbers)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        probs = sorted({i / BINS[kind] for kind in ("rank", "tenth") for i in range(BINS[kind] + 1)})
        found = exact_quantiles(both.where("split = 'train'"), {c: F.col(f"x{k}") for k, c in enumerate(numbers)}, probs)
        for k, c in enumerate(numbers):
            if ends[f"lo{k}"] is None:
                continue
            q = dict(zip(probs, found[c][0] or (), strict=False))
            edges = {kind: sorted({q[i / BINS[kind]] for i in range(BINS[kind] + 1)}) for kind in ("rank", "tenth") if q}
            places += [(c, kind, slot.cast("string")) for kind, slot in _slots(F.col(f"x{k}"), ends[f"lo{k}"], ends[f"hi{k}"], edges).items()]
    places += [(c, "level", F.col(f"t{k}")) for k, c in enumerate(texts)]
    slots = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), slot.alias("slot")) for c, kind, slot in places])
    rows = both.select("split", "month", "y", F.explode(slots).alias("p")).select("split", "month", "y", "p.*").where("slot IS NOT NULL")
    place = ["feature", "kind", "split", "slot"]
    cube = rows.groupingSets([place, [*place, "month"]], *place, "month").agg(
        F.grouping("month").alias("every_month"), F.count(F.lit(1)).alias("n"), F.count("y").alias("known"), F.sum(F.coalesce("y", F.lit(0))).alias("positive"),
    )
    return cube.withColumn("every_month", F.col("every_month") == 1)


def _of(cube: DataFrame, feature: str, kind: str) -> DataFrame:
    return cube.where((F.col("feature") == feature) & (F.col("kind") == kind) & F.col("every_month"))


def histogram(cube: DataFrame, feature: str, kind: str) -> DataFrame:
    """(split, bin, n, share) of the rows in the bins of a kind."""
    rows = _of(cube, feature, kind).select("split", F.col("slot").cast("int").alias("bin"), "n")
    total = rows.groupBy("split").agg(F.sum("n").alias("rows"))
    return rows.join(F.broadcast(total), "split").select("split", "bin", "n", (F.col("n") / F.col("rows")).alias("share"))


def levels(cube: DataFrame, feature: str) -> DataFrame:
    """(category, n, share, rate) over both splits; the rate is null where no label is known."""
    rows = _of(cube, feature, "level").groupBy(F.col("slot").alias("category")).agg(*[F.sum(c).alias(c) for c in ("n", "known", "positive")])
    total = rows.agg(F.sum("n").alias("rows"))  # one row
    return rows.join(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("rows")).alias("share"), ratio(F.col("positive"), F.col("known"), None).alias("rate"))


def of_months(cube: DataFrame, feature: str, split: str, months: Sequence[str]) -> DataFrame:
    """(category, n, share) of one split's rows in some months."""
    rows = cube.where((F.col("feature") == feature) & (F.col("kind") == "level") & ~F.col("every_month") & (F.col("split") == split) & F.col("month").isin(*months))
    counts = rows.groupBy(F.col("slot").alias("category")).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"))
    return counts.join(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("rows")).alias("share"))
