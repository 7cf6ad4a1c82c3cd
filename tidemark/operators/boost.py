"""Boosted trees by aggregates: each level of a tree is one grouping of gradients by (node, feature, bin).

Numbers are bins between train's exact quantiles, texts are levels, named by a 64-bit hash of the normalised text, so no dictionary of levels is
built or joined. A level's histograms are partial sums before the shuffle, added up by numpy over a task's rows. Splits are found by running sums over a node's bins of a
feature, numbers in their order, levels in the order of their smoothed gradient ratio, of which ``LISTED`` at most make up one side. Missing values
go to the side that gains more; levels that train does not have go with the levels that are not listed. The driver holds a row per node.

Training rows are written once as (label, bins), so that no level of a tree reads or encodes the input again. They are dealt out by the text with the most levels
(rows that miss it or have a level of many rows, evenly), so a task has all rows of such a level. Only the levels at either end of a task's order can
be among the ``LISTED`` at either end of all; the others go on as one row of sums and a count, so what a level of a tree shuffles doesn't grow with the levels.
Of further texts with many levels all sums are shuffled, and cut down to the ends after that. A task's rows are kept as one Arrow table with its margins, which goes to Python as it is.

Each class weighs half. Ties between splits go to the earlier feature, then the earlier bin.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import cut, number, text_columns
from tidemark.functions.text import normalise
from tidemark.operators.profile import exact_quantiles
from tidemark.sources.store import scratch, stored

#: Levels that one side of a split lists at most, what their gradient ratios are smoothed by, and the penalty on a leaf's weight.
LISTED, SMOOTH, PENALTY = 32, 10.0, 1.0
#: Rows and weight of curvature that each side of a split needs.
LEAST_ROWS, LEAST_CURVE = 20, 1e-3
#: Rows and values that a task looks at together, about; a level with more than a quarter of such rows is dealt out evenly. Texts with more levels than ``WIDE`` are cut down to their ends.
TASK_ROWS, TASK_VALUES, WIDE = 1 << 19, 1 << 23, 1 << 10


@dataclass(frozen=True)
class Split:
    """Rows whose bin of ``feature`` is at most ``upto``, or whose level is listed, go left (right, where ``listed_left`` is false)."""

    feature: int
    upto: int | None
    levels: tuple[int, ...]
    listed_left: bool
    missing_left: bool
    gain: float

    def sql(self) -> str:
        """A condition on ``bins``, true where a row goes left."""
        bin_ = f"bins[{self.feature}]"
        met = f"{bin_} <= {self.upto}L" if self.upto is not None else f"{bin_} {'' if self.listed_left else 'NOT '}IN ({', '.join(f'{x}L' if x > -(1 << 63) else 'cast(-9223372036854775808 AS bigint)' for x in self.levels)})"
        return f"coalesce({met}, {str(self.missing_left).lower()})"


@dataclass
class Tree:
    """Splits and values by node: the root is 1, the children of k are 2k and 2k + 1."""

    splits: dict[int, Split] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def plain(self) -> dict[int, tuple]:
        """The splits as what ``_router`` takes."""
        return {k: (s.feature, s.upto, s.levels, s.listed_left, s.missing_left) for k, s in self.splits.items()}


@dataclass
class Boosted:
    """Features with the breaks of the numbers among them (none: a text), and the trees."""

    features: list[str]
    breaks: dict[str, list[float]]
    trees: list[Tree] = field(default_factory=list)

    def bins(self) -> Column:
        """The array of a row's bins, null where a value is missing."""

        def one(c: str, x: Column) -> Column:
            return x if c not in self.breaks else F.when(x.isNotNull(), cut(x, F.array(*map(F.lit, self.breaks[c])).cast("array<double>")).cast("long"))

        return F.array(*map(one, self.features, self.inputs()))

    def inputs(self) -> list[Column]:
        """A row's numbers and, for texts, levels: what bins are made of."""

        def one(c: str) -> Column:
            x = F.col(f"`{c}`")
            return number(x) if c in self.breaks else F.when(x.isNotNull(), F.xxhash64(normalise(x)))

        return [one(c) for c in self.features]

    def margin(self) -> Column:
        """The sum of what the trees give a row."""
        if not self.trees:
            return F.lit(0.0)
        breaks = [self.breaks.get(c) for c in self.features]
        return _summed([(t.plain(), t.values) for t in self.trees], breaks)(*self.inputs())

    def save(self, path: str, spark: SparkSession) -> None:
        told = {"features": self.features, "breaks": self.breaks, "trees": [{"splits": {k: asdict(s) for k, s in t.splits.items()}, "values": t.values} for t in self.trees]}
        spark.createDataFrame([(json.dumps(told),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Boosted:
        told = json.loads(spark.read.text(path).first()[0])
        tree = lambda t: Tree({int(k): Split(**{**s, "levels": tuple(s["levels"])}) for k, s in t["splits"].items()}, {int(k): v for k, v in t["values"].items()})
        return cls(told["features"], told["breaks"], [tree(t) for t in told["trees"]])


def _binned(breaks: list[float]) -> Callable[[Column], Column]:
    """The number of breaks below a value, found by halves, as ``cut`` counts them one by one; null stays null."""

    def run(x: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        found = np.searchsorted(np.array(breaks), x.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(found.astype(np.int8 if len(breaks) < 128 else np.int32), mask=x.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "tinyint" if len(breaks) < 128 else "int")


def _router() -> tuple[Callable, Callable]:
    """Functions of a column: (values, which are missing), and of such columns, splits and a number of rows: each row's node. Workers need not import this package for them."""

    def read(column):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        missing = column.is_null().to_numpy(zero_copy_only=False)
        if pa.types.is_dictionary(column.type):  # a missing level has the last place
            return np.append(column.dictionary.to_numpy(zero_copy_only=False), 0).astype(np.int64)[column.indices.fill_null(-1).to_numpy(zero_copy_only=False)], missing
        return column.fill_null(0).to_numpy(zero_copy_only=False), missing

    def route(columns, splits, n):  # noqa: ANN001, ANN202
        import numpy as np

        node, todo = np.ones(n, np.int64), [(1, np.arange(n))]
        while todo:
            k, rows = todo.pop()
            if k not in splits:
                node[rows] = k
            elif len(rows):
                f, upto, levels, listed_left, missing_left = splits[k]
                values, missing = columns[f]
                x = values[rows]
                left = x <= upto if upto is not None else np.isin(x, np.array(levels, np.int64)) == listed_left
                left[missing[rows]] = missing_left
                todo += [(2 * k, rows[left]), (2 * k + 1, rows[~left])]
        return node

    return read, route


def _summed(trees: list[tuple[dict, dict]], breaks: Sequence[list[float] | None]) -> Callable[..., Column]:
    """What trees of (splits, values) give a row of numbers, which ``breaks`` bin, and levels in all."""
    read, route = _router()

    def run(*inputs: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        columns = [read(x) for x in inputs]
        columns = [(np.searchsorted(np.array(b), values) if b is not None else values, missing) for (values, missing), b in zip(columns, breaks, strict=True)]
        total = np.zeros(len(inputs[0]))
        for splits, values in trees:
            worth = np.zeros(max(values, default=1) + 1)
            worth[list(values)] = list(values.values())
            total += worth[route(columns, splits, len(total))]
        return pa.array(total)

    return F.arrow_udf(run, "double")


def _packed(rows: DataFrame) -> DataFrame:
    """(pack, margin): each task's rows as an Arrow stream, levels by number, and a margin of zero for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches).combine_chunks()
            columns = [c.combine_chunks() for c in table.columns]
            batch = pa.RecordBatch.from_arrays([c.dictionary_encode() if pa.types.is_int64(c.type) else c for c in columns], names=table.column_names)
            with pa.BufferOutputStream() as out:
                with pa.ipc.new_stream(out, batch.schema) as stream:
                    stream.write_batch(batch)
                pack = out.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.binary()), pa.array([bytes(8 * len(batch))], pa.binary())], names=["pack", "margin"])

    return rows.mapInArrow(run, "pack binary, margin binary")


def _opened() -> Callable:
    """A function of a pack and its margins: the columns of the pack and the margins as numpy's."""

    def run(pack, margin):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        return pa.ipc.open_stream(pack.as_buffer()).read_next_batch().columns, np.frombuffer(margin.as_buffer())

    return run


def _moved(trees: Sequence[Tree]) -> Column:
    """The margins of a pack with what trees give the rows added."""
    opened, (read, route) = _opened(), _router()
    told = [(t.plain(), [t.values.get(k, 0.0) for k in range(max(t.values, default=1) + 1)]) for t in trees]

    def run(packs: pa.Array, margins: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        out = []
        for pack, margin in zip(packs, margins, strict=True):
            (_, *columns), total = opened(pack, margin)
            columns = list(map(read, columns))
            for splits, worth in told:
                total = total + np.array(worth)[route(columns, splits, len(total))]
            out.append(total.tobytes())
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")("pack", "margin")


def _ends() -> Callable:
    """A function of the nodes, bins and sums of whole levels of one text: which can be among the ``LISTED`` at either end, and a row of sums for the others of each node.

    That row is (node, bin, g, h, n, levels, o) with the bin and the ratio of one of its levels: at this place of the order, it is behind all that may be listed
    in front and before all that may be listed at the end (one more there, to have a split behind which the others are).
    """

    def run(node, bins, g, h, n):  # noqa: ANN001, ANN202
        import numpy as np

        o, kept, others = g / (h + SMOOTH), np.ones(len(g), bool), []
        for k in np.unique(node):
            at = np.flatnonzero(node == k)
            if len(at) <= 2 * LISTED + 2:
                continue
            ratio = o[at]
            inner = [LISTED - 1, len(at) - LISTED - 1]
            low, high = np.partition(ratio, inner)[inner]
            in_order = lambda some: some[np.lexsort((bins[some], o[some]))]  # noqa: B023, E731
            kept[at] = False
            kept[in_order(at[ratio <= low])[:LISTED]] = True
            kept[in_order(at[ratio >= high])[-LISTED - 1 :]] = True
            rest = at[~kept[at]]
            others.append((k, bins[rest[0]], g[rest].sum(), h[rest].sum(), n[rest].sum(), len(rest), o[rest[0]]))
        return kept, others

    return run


#: A histogram's rows: sums by node, feature and bin (null: missing); rows that stand for several levels have their number, and their place in the order.
_HIST = "node int, f int, bin long, g double, h double, n long, levels long, o double"


def _histograms(rows: DataFrame, texts: Sequence[int], whole: int | None, frequent: Sequence[int], weights: tuple[float, float], tree: Tree, open_: Sequence[int]) -> DataFrame:
    """Partial sums of each task's rows in open nodes; of ``whole``, all of whose rows are in one task but for ``frequent`` levels, the levels at both ends."""
    opened, (read, route), ends, splits = _opened(), _router(), _ends(), tree.plain()
    hist = [c.split()[0] for c in _HIST.split(", ")]

    def sums_of(y, margin, columns):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        nodes = route(list(map(read, columns)), splits, len(y))
        slots = np.full(max(open_) + 2, -1)
        slots[list(open_)] = range(len(open_))
        slot = slots[np.minimum(nodes, max(open_) + 1)]
        some = np.flatnonzero(slot >= 0)
        if not len(some):
            return
        slot, y, margin = slot[some], y[some], margin[some]
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, *weights)
        g, h = w * (p - y), w * p * (1 - p)
        for f, column in enumerate(columns):
            if f in texts:
                codes, named = column.indices.fill_null(-1).to_numpy(zero_copy_only=False), np.append(0, column.dictionary.to_numpy(zero_copy_only=False)).astype(np.int64)
            else:
                codes = column.fill_null(-1).to_numpy(zero_copy_only=False)
                named = np.arange(-1, int(codes.max()) + 1)
            cell, size = (codes[some].astype(np.int64) + 1) * len(open_) + slot, len(named) * len(open_)
            count = np.bincount(cell, minlength=size)
            at = np.flatnonzero(count)
            code, node = at // len(open_), np.array(open_)[at % len(open_)]
            told = [node, named[code], np.bincount(cell, g, size)[at], np.bincount(cell, h, size)[at], count[at]]
            kept, others = np.ones(len(at), bool), []
            if f == whole:
                here = np.flatnonzero((code > 0) & ~np.isin(told[1], np.array(frequent, np.int64)))
                kept[here], others = ends(*[x[here] for x in told])
            node, bins, *sums = [x[kept] for x in told]
            one, no = np.ones(len(node), np.int64), np.zeros(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(one * f, pa.int32()), pa.array(bins, mask=code[kept] == 0), *map(pa.array, sums), pa.array(one), pa.array(no, mask=no == 0)], names=hist)
            if others:
                node, *more = zip(*others, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array([f] * len(node), pa.int32()), *[pa.array(np.array(x)) for x in more]], names=hist)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, margin in zip(*batch.columns, strict=True):
                (y, *columns), margins = opened(pack, margin)
                yield from sums_of(y.to_numpy(), margins, columns)

    return rows.mapInArrow(run, _HIST)


def _cut_down(hist: DataFrame, wide: Sequence[int]) -> DataFrame:
    """A histogram, its levels of ``wide`` texts cut down to the ends of each ``TASK_ROWS`` rows."""
    ends = _ends()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        def cut_down(held):  # noqa: ANN001, ANN202
            table = pa.Table.from_batches(held).combine_chunks()
            f = table["f"].to_numpy()
            known = table["bin"].is_valid().to_numpy() & table["o"].is_null().to_numpy()
            kept, rest = np.ones(len(f), bool), []
            for k in wide:
                at = np.flatnonzero((f == k) & known)
                kept[at], others = ends(*[table[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)[at] for c in ("node", "bin", "g", "h", "n")])
                rest += [(node, k, *more) for node, *more in others]
            yield from table.filter(pa.array(kept)).combine_chunks().to_batches()
            if rest:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x), field.type) for x, field in zip(zip(*rest, strict=True), table.schema, strict=True)], schema=table.schema)

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= TASK_ROWS:
                yield from cut_down(held)
                held, rows = [], 0
        if rows:
            yield from cut_down(held)

    return hist.mapInArrow(run, _HIST)


def _score(g: str, h: str) -> str:
    return f"({g}) * ({g}) / (({h}) + {PENALTY}D)"


def best_splits(hist: DataFrame, texts: Sequence[int]) -> DataFrame:
    """The best split of each node of (node, f, bin, g, h, n), with the sums of its left side and of the node; nodes without one are left out.

    Rows may have ``levels`` and ``o``: those of several levels of a text that are at neither end, and a place among them in the order.

    ``listed`` has the levels that a split of a text lists: those up to ``at``, or those behind it where they are fewer; null for numbers.
    It is one text of SQL: a tree plans a job for each of its levels, and step by step they would be hundreds of calls into the JVM, each of which looks at the whole plan again.
    """
    text = f"f IN ({', '.join(map(str, texts))})" if texts else "false"
    if "levels" not in hist.columns:
        hist = hist.selectExpr("*", "1L AS levels", "cast(NULL AS double) AS o")
    every = "OVER (PARTITION BY node, f)"
    upto = "OVER (PARTITION BY node, f ORDER BY o, bin ROWS UNBOUNDED PRECEDING)"
    sums = lambda form: ", ".join(form.format(c) for c in "ghn")
    side = lambda left: f"struct({str(left).lower()} AS missing_left, {sums('{0}_left + {0}_missing AS {0}' if left else '{0}_left AS {0}')})"
    held = "bin, at, m, g_all, h_all, n_all, missing_left, g, h, n, gain"
    # rows without ``good`` are no split, but may be listed
    fits = f"least(n, n_all - n) >= {LEAST_ROWS} AND least(h, h_all - h) >= {LEAST_CURVE}D AND gain > 1e-9D"
    end = lambda met: f"collect_list(CASE WHEN {text} AND NOT missing_left AND {met} THEN struct(at, bin) END)"
    # a feature's rows are together already: only its best split goes on, with the levels at both ends
    return hist.sparkSession.sql(
        f"""
        WITH placed AS (SELECT node, f, bin, g, h, n, levels, coalesce(o, CASE WHEN {text} THEN g / (h + {SMOOTH}D) ELSE cast(bin AS double) END) AS o FROM {{hist}}),
        told AS (SELECT *, {sums('coalesce(sum(CASE WHEN bin IS NULL THEN {0} END) ' + every + ', 0) AS {0}_missing')}, {sums('sum({0}) ' + every + ' AS {0}_all')},
          sum(CASE WHEN bin IS NOT NULL THEN levels END) {every} AS m FROM placed),
        ordered AS (SELECT *, {sums('sum({0}) ' + upto + ' AS {0}_left')}, sum(levels) {upto} AS at FROM told WHERE bin IS NOT NULL),
        sides AS (SELECT node, f, bin, at, m, g_all, h_all, n_all, explode(CASE WHEN n_missing > 0 THEN array({side(False)}, {side(True)}) ELSE array({side(False)}) END) AS s
          FROM ordered WHERE NOT {text} OR at <= {LISTED} OR m - at <= {LISTED}),
        gains AS (SELECT node, f, bin, at, m, g_all, h_all, n_all, s.*, {_score('s.g', 's.h')} + {_score('g_all - s.g', 'h_all - s.h')} - {_score('g_all', 'h_all')} AS gain FROM sides),
        per AS (SELECT node, f, max_by(struct({held}), CASE WHEN {fits} THEN struct(gain, -at, cast(NOT missing_left AS int)) END) AS b,
          {end(f'at <= {LISTED}')} AS head, {end(f'm - at < {LISTED}')} AS tail FROM gains GROUP BY node, f),
        best AS (SELECT node, max_by(struct(f, b.*, CASE WHEN {text} THEN transform(CASE WHEN b.at <= {LISTED} THEN filter(head, e -> e.at <= b.at) ELSE filter(tail, e -> e.at > b.at) END, e -> e.bin) END AS listed),
          struct(b.gain, -f)) AS b FROM per WHERE b IS NOT NULL GROUP BY node)
        SELECT node, b.* FROM best""",
        hist=hist,
    )


def _grown(rows: DataFrame, texts: Sequence[int], wide: Sequence[int], whole: int | None, frequent: Sequence[int], weights: tuple[float, float], depth: int, rate: float) -> Tree:
    """One tree over packs of (y, b0, ...), one job a level."""
    tree, open_ = Tree(), [1]
    leaf = lambda g, h: -rate * g / (h + PENALTY)
    for _ in range(depth):
        long = _histograms(rows, texts, whole, frequent, weights, tree, open_)
        hist = long.groupBy("node", "f", "bin").agg(*[F.expr(f"{e}({c}) AS {c}") for c, e in (("g", "sum"), ("h", "sum"), ("n", "sum"), ("levels", "max"), ("o", "max"))])
        if others := [k for k in wide if k != whole]:
            hist = _cut_down(hist, others)
        open_ = []
        for r in sorted(best_splits(hist, texts).collect(), key=lambda r: r["node"]):
            node, levels = r["node"], tuple(sorted(r["listed"] or ()))
            tree.splits[node] = Split(r["f"], None if levels else r["bin"], levels, r["at"] <= LISTED, r["missing_left"], r["gain"])
            tree.values |= {2 * node: leaf(r["g"], r["h"]), 2 * node + 1: leaf(r["g_all"] - r["g"], r["h_all"] - r["h"])}
            open_ += [2 * node, 2 * node + 1]
        if not open_:
            break
    return tree


def _dealt(rows: DataFrame, texts: Sequence[int]) -> tuple[DataFrame, list[int], int | None, list[int]]:
    """Stored rows dealt out into packs, the texts with many levels, the one that rows are dealt out by, and its levels of so many rows that they are dealt out evenly."""
    names = [c for c in rows.columns if c[0] == "b"]
    told = rows.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(f"b{k}").alias(f"d{k}") for k in texts]).first()
    wide = [k for k in texts if told[f"d{k}"] > WIDE]
    whole = max(wide, key=lambda k: told[f"d{k}"], default=None)
    size = max(1, min(TASK_ROWS, TASK_VALUES // len(names)))
    few = max(size >> 4, 1)  # small tables are dealt out to all cores
    parts = max(-(-told["n"] // size), min(rows.sparkSession.sparkContext.defaultParallelism, -(-told["n"] // few)), 1)
    key, frequent = "id", []
    if whole is not None:
        frequent = [r[0] for r in rows.where(f"b{whole} IS NOT NULL").groupBy(f"b{whole}").count().where(F.col("count") > max(told["n"] // parts // 4, 1)).collect()]
        alone = F.col(f"b{whole}").isNull() | F.col(f"b{whole}").isin(frequent)
        key = F.when(alone, F.col("id")).otherwise(F.col(f"b{whole}"))
    # rows of a stored table are numbered alike whenever it is read
    dealt = rows.withColumn("id", F.monotonically_increasing_id()).repartition(parts, key).select("y", *names)
    return _packed(dealt), wide, whole, frequent


def fit(train: DataFrame, features: Sequence[str], label: Column, trees: int = 20, depth: int = 5, bins: int = 64, rate: float = 0.1) -> Boosted:
    """Trees for a label of 0 and 1; rows without a label are dropped. Columns that are no text are numbers."""
    spark = train.sparkSession
    rows = train.withColumn("tm_label__", label.cast("double")).where("tm_label__ IS NOT NULL")
    numbers = [c for c in features if c not in text_columns(train, features)]
    values = {c: number(F.col(f"`{c}`")) for c in numbers}
    share = rows.agg(F.avg("tm_label__")).first()[0] or 0.0
    found = exact_quantiles(rows, values, [k / bins for k in range(1, bins)]) if numbers else {}
    model = Boosted(list(features), {c: sorted(set(found[c][0] or [0.0])) for c in numbers})
    texts = [k for k, c in enumerate(features) if c not in model.breaks]
    weights = 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)
    binned = [(_binned(model.breaks[c])(x) if c in model.breaks else x).alias(f"b{k}") for k, (c, x) in enumerate(zip(features, model.inputs(), strict=True))]
    rows = stored(spark, rows.select(F.col("tm_label__").alias("y"), *binned), scratch(spark))
    packs, *how = _dealt(rows, texts)
    # Spark looks at all that a kept table was made of, at a cost that doubles with each step, so only some margins rest on others
    base, since, step = packs.persist(), 0, max(5, trees // 5)
    now, held = base, [base]
    try:
        for k in range(trees):
            tree = _grown(now, texts, *how, weights, depth, rate)
            for old in [x for x in held if x is not base and x is not now]:  # the tree has read all rows, so they are kept by now
                old.unpersist()
                held.remove(old)
            if not tree.splits:
                break
            model.trees.append(tree)
            if k + 1 < trees:
                now = base.withColumn("margin", _moved(model.trees[since:])).persist()
                held.append(now)
                if k + 1 - since == step:
                    base, since = now, k + 1
    finally:
        for x in held:
            x.unpersist()
    return model


def score(model: Boosted, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(*keep, probability_score); without any tree all rows have one half."""
    return df.select(*[F.col(f"`{c}`") for c in keep], (1 / (1 + F.exp(-model.margin()))).alias("probability_score"))


def importance(model: Boosted, spark: SparkSession) -> DataFrame:
    """(rank, feature, importance), largest first: each feature's share of what all splits gained."""
    gains = dict.fromkeys(model.features, 0.0)
    for t in model.trees:
        for s in t.splits.values():
            gains[model.features[s.feature]] += s.gain
    total = sum(gains.values()) or 1.0
    rows = sorted(((f, g / total) for f, g in gains.items()), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(k, f, g) for k, (f, g) in enumerate(rows, 1)], "rank int, feature string, importance double")
