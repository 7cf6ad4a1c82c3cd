"""Readers: CSV with several null tokens and inferred types, aligned splits, and the pipeline's own outputs."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import null_tokens
from tidemark.sources import records

_log = logging.getLogger(__name__)


def must_exist(spark: SparkSession, path: str) -> str:
    """The path, if there is something at it, in whatever store it names."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):  # noqa: SLF001
        raise FileNotFoundError(path)
    return path


#: How files are read, one after the other until one fits: as they should be, with bytes that are no text replaced, with what is legible of each record.
LEVELS = ("FAILFAST", "LOSSY", "PERMISSIVE")
_DAMAGED = "tm_damaged__"


def raw_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", mode: str = "PERMISSIVE") -> DataFrame:
    """All columns as text with null tokens as null. Bytes that are no text become U+FFFD; every line is a record.

    Under PERMISSIVE malformed lines are kept as far as they go, under FAILFAST they are an error, under DROPMALFORMED they go.
    """
    must_exist(spark, path)
    rows = spark.read.csv(path, header=True, inferSchema=False, mode=mode, encoding=encoding, escape='"', multiLine=False)
    return rows.select(*[null_tokens(F.col(f"`{c}`")).alias(c) for c in rows.columns])


def parsed_csv(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """All columns as text with null tokens as null, then ``tm_damaged__`` with malformed records; and the number of lines that are no UTF-8.

    Where no line has an odd number of quotes, every line is a record and Spark's own reader parses them; otherwise records are
    cut first (``records``), across splits too.
    """
    must_exist(spark, path)
    rows = records.lines(spark, path)
    survey = [(r["file"], r["start"], r["odd"], r["no_text"]) for r in records.surveyed(rows).collect()]
    no_text, odd = sum(r[3] for r in survey), any(r[2] for r in survey)
    how = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _DAMAGED}
    names = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=odd).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _DAMAGED]])
    if not odd:
        rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, **how)
    else:
        text = F.regexp_replace(F.make_valid_utf8(F.col("record").cast("string")), "\\r$", "")
        cut = records.records(rows, [r[:3] for r in survey]).where(~F.col("first")).select(text.alias("record")).where(F.trim("record") != "")
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)
        rows = cut.select(F.from_csv("record", ddl, {**how, "multiLine": "true"}).alias("r")).select("r.*")
    return rows.select(*[null_tokens(F.col(f"`{c}`")).alias(c) for c in names], _DAMAGED), no_text


#: Types that a column can have, and the shape that all text has which a cast to them takes: only what has it is cast, as each failing cast throws.
_TESTS = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_SHAPES = {
    "bigint": r"^ *[+-]?[0-9]+[\s\p{Cntrl}]*$",
    "double": r"(?i)^ *[+-]?(nan|inf|infinity|(0x[0-9a-f.]*p[+-]?[0-9]+|[0-9.]+(e[+-]?[0-9]+)?)[fd]?)[\s\p{Cntrl}]*$",
    "boolean": r"(?i)^[\s\p{Cntrl}]*(t|true|y|yes|1|f|false|n|no|0)[\s\p{Cntrl}]*$",
}


def _taken(x: Column) -> dict[str, Column]:
    """For each type, whether a text can be cast to it.

    Tests are branches of conditions throughout, never terms of an ``and``: Spark may evaluate terms that occur twice before all else.
    """
    number = F.substring(F.ltrim(x), 1, 1).isin(*"0123456789+-.nNiI")
    fits = lambda t: F.when(x.rlike(_SHAPES[t]), x.try_cast(t).isNotNull()).otherwise(False)
    whole = F.when(number, fits("bigint")).otherwise(False)
    return {
        "bigint": whole, "double": F.when(whole, True).when(number, fits("double")).otherwise(False),
        "boolean": F.when(F.length(F.trim(x)) <= 5, fits("boolean")).otherwise(False),
    }


def inferred_types(rows: DataFrame, given: dict[str, T.DataType] | None = None) -> tuple[dict[str, T.DataType], dict[str, int], int]:
    """Type of each text column: long, double, boolean or string, whichever all rows' values fit; then, for columns with given
    types, how many values do not fit those; and the number of damaged rows. One job, partial aggregates only.
    """
    given, asked = given or {}, []
    names = [c for c in rows.columns if c != _DAMAGED]
    for k, c in enumerate(names):
        x = F.col(f"`{c}`")
        if c in given:
            asked.append(F.count_if(x.isNotNull() & x.try_cast(given[c]).isNull()).alias(f"m{k}"))
            continue
        asked += [F.count(x).alias(f"n{k}"), *[F.count_if(x.isNotNull() & ok).alias(f"{t}{k}") for t, ok in _taken(x).items()]]
    damaged = F.count(_DAMAGED) if _DAMAGED in rows.columns else F.lit(0)
    told = rows.agg(damaged.alias("damaged"), *asked).first()
    fitting = lambda k: next((t for name, t in _TESTS.items() if told[f"n{k}"] and told[f"{name}{k}"] == told[f"n{k}"]), T.StringType())
    types = {c: given.get(c) or fitting(k) for k, c in enumerate(names)}
    lost = {c: told[f"m{k}"] for k, c in enumerate(names) if c in given and told[f"m{k}"]}
    return types, lost, told["damaged"]


@dataclass
class Report:
    """What a read met: the level that it took, malformed records, lines that are no UTF-8, and values that fit a given type no better than as null, by column."""

    level: str = LEVELS[0]
    damaged: int = 0
    no_text: int = 0
    misfits: dict[str, int] = field(default_factory=dict)


def read_csv(spark: SparkSession, path: str, types: dict[str, T.DataType] | None = None, report: Report | None = None) -> DataFrame:
    """A CSV file with inferred types, or the given ones for the columns they name; values that do not fit those become null.

    Quoted fields may hold line breaks. A file that is UTF-8 and has as many fields in each record as in its header is read as it is; bytes
    that are no text are counted and replaced by U+FFFD; records with too few or too many fields are counted and kept as far as they go
    (``LEVELS``). All of it goes into ``report`` and, unless it is nothing, the log.
    """
    report = Report() if report is None else report
    rows, report.no_text = parsed_csv(spark, path)
    found, report.misfits, report.damaged = inferred_types(rows, {c: t for c, t in (types or {}).items() if c in rows.columns})
    report.level = LEVELS[2] if report.damaged else LEVELS[1] if report.no_text else LEVELS[0]
    if report.level != LEVELS[0]:
        _log.warning("%s: %d malformed records, %d lines that are no UTF-8, read as %s", path, report.damaged, report.no_text, report.level)
    if report.misfits:
        _log.warning("%s: values that do not fit their columns became null: %s", path, report.misfits)
    return rows.select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in found.items()])


def aligned(train: DataFrame, test: DataFrame, structural: Sequence[str] = ()) -> DataFrame:
    """``test`` with the columns it lacks as typed nulls, train's columns first; structural columns are never made up."""
    missing = [f for f in train.schema if f.name not in test.columns and f.name not in structural]
    out = test.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    return out.select(*[c for c in train.columns if c in out.columns], *[c for c in out.columns if c not in train.columns])


def ingest(spark: SparkSession, train_path: str, test_path: str, key: str = "CustomerID", structural: tuple[str, ...] = ("CustomerID", "Month", "ChurnStatus")) -> tuple[DataFrame, DataFrame]:
    """Both splits: test with train's types and missing columns except for the structural ones; the id is required."""
    train = read_csv(spark, train_path)
    types = {f.name: f.dataType for f in train.schema if f.name not in structural}
    test = read_csv(spark, test_path, types)
    if key not in test.columns:
        raise ValueError(f"the test file lacks the column {key}")
    return train, aligned(train, test, structural)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV or JSON by the file's ending."""
    if path.rstrip("/").endswith(".csv"):
        return read_csv(spark, path)
    return spark.read.json(path, multiLine=True) if path.rstrip("/").endswith(".json") else spark.read.parquet(path)


def pruned(df: DataFrame, key: str, target: str) -> DataFrame:
    """Id and target alone, or what there is of them: the scan reads no other column."""
    return df.select(*[c for c in (key, target) if c in df.columns])


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same ones every time: the n least hashes of the id. A top-n per task, no full sort."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)


def load_outputs(spark: SparkSession, *folders: str) -> dict[str, DataFrame]:
    """What ``writers.export`` wrote, by name, each from the first folder that has it; parts that are nowhere are left out."""
    out = {}
    for name in ("drift_results.csv", "ranked_features.csv", "feature_importance.csv", "prediction.csv", "pipeline_meta.json"):
        for folder in folders:
            try:
                out[name.split(".")[0]] = read_table(spark, must_exist(spark, f"{folder}/{name}"))
                break
            except FileNotFoundError:
                continue
    return out
