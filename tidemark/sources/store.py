"""Where intermediate and reusable results lie: folders that all executors share.

Results are kept by what they were made of (``kept``): the names, lengths and times of all input files, the settings, and the package's own
sources. A file that changes has another key, so nothing stale is ever read, in this session or another; the same inputs start no job.
A result counts from the moment its manifest is there, which is written last and moved into place at once, so a
run that broke off leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared(spark: SparkSession) -> str | None:
    """The session's shared folder, if it names one. A session with a local master may do without, any other must not."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return where and where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder below the session's shared checkpoint folder; one of its own where none is set and the master is local (tests)."""
    where = shared(spark)
    return f"{where}/{uuid.uuid4().hex}" if where else tempfile.mkdtemp(prefix="tidemark-")


def stored(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """``df`` as Parquet below ``folder``: what many jobs read is parsed once, and column by column after that."""
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def files(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of all files at or below the paths, in whatever stores they lie: what names a table's content without reading it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    out = []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(conf)
        if not fs.exists(where):
            raise FileNotFoundError(path)
        told = fs.listFiles(where, True)
        while told.hasNext():
            f = told.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


@cache
def code_version() -> str:
    """A digest of the package's sources: results made by other code are made anew."""

    def walk(folder):  # noqa: ANN001, ANN202
        for f in sorted(folder.iterdir(), key=lambda x: x.name):
            if f.is_dir():
                yield from walk(f) if f.name not in ("llm", "__pycache__") else ()
            elif f.name.endswith(".py"):
                yield f.name.encode() + b"\0" + f.read_bytes()

    digest = hashlib.sha256()
    for part in walk(resources.files("tidemark")):
        digest.update(part)
    return digest.hexdigest()


_own: dict[str, str] = {}


def _results(spark: SparkSession) -> str:
    where = shared(spark) or _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidemark-results-"))
    return f"{where}/results"


def _text(spark: SparkSession, path: str, write: str | None = None) -> str | None:
    """A small file's text, None where there is none; or the text written beside it and moved into place."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    if write is not None:
        beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.write(bytearray(write.encode()))
        out.close()
        fs.delete(where, False)
        fs.rename(beside, where)
        return write
    if not fs.exists(where):
        return None
    into = fs.open(where)
    try:
        return bytes(into.readAllBytes()).decode()
    finally:
        into.close()


def kept(spark: SparkSession, name: str, inputs: Sequence[str], config: object, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make``, a table that rests on the files at ``inputs`` and on ``config`` alone; made and stored only where it is not there yet."""
    about = {"name": name, "files": files(spark, *inputs), "config": repr(config), "code": code_version()}
    key = hashlib.sha256(json.dumps(about).encode()).hexdigest()
    manifest = f"{_results(spark)}/{name}-{key}.json"
    told = _text(spark, manifest)
    if told is None:
        folder = f"{_results(spark)}/{name}-{uuid.uuid4().hex}"
        df = make()
        df.write.parquet(folder)
        told = _text(spark, manifest, json.dumps({**about, "folder": folder, "schema": df.schema.json()}))
    found = json.loads(told)
    return spark.read.schema(T.StructType.fromJson(json.loads(found["schema"]))).parquet(found["folder"])


def forget(spark: SparkSession) -> None:
    """Delete all kept results of the session's shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_results(spark))  # noqa: SLF001
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001
