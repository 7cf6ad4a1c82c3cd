"""Centroid clustering of embeddings with weights: equal whole-number vectors are one vector with a multiplicity.

Vectors are turned into whole numbers, equal ones grouped with their count (partial sums before the shuffle, so that a vector that
a third of all rows share costs one row a task). Lloyd's rounds run over the distinct vectors: a task assigns each to its nearest
centroid and adds weight times vector, as whole numbers of any size; states of k sums are merged in rounds and the driver floors k
means. The last assignment of the distinct vectors is a table, joined back to the ids on a 128-bit digest of the vector. Vectors with
over a thousandth of all rows are a broadcast table of a thousand rows at most; the others go by a shuffle whose keys are then all small.

Defined results. Vectors that are null, hold a null, NaN or an infinity, or have another number of components are left out. Null ids
are kept and seed as an empty id; rows that repeat are repeated; equal distances go to the smaller centroid number, equal seed hashes to the
smaller vector. With fewer vectors than k there are fewer centroids; an empty centroid stays where it is. An empty table gives
an empty result. Other columns, whatever their names, are ignored. Entries beyond 2^27 after scaling are an error, since squared distances
would not fit a long; inertias beyond a long are null.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, map_batches, table
from tidemark.llm.vectors import finite, folded, matrix, whole

#: Largest absolute entry, so that a squared distance fits a long; and the share of all rows from which a vector is hot.
LARGEST, HOT_SHARE = 1 << 27, 1000


def quantised(df: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q, digest) of the vectors that are kept."""
    kept = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(finite("vector") & (F.size("vector") == dims))
    rows = kept.select("vec_id", whole("vector", scale).alias("q"))
    fits = ~F.exists("q", lambda x: x.isNull() | (F.abs(x) > LARGEST))
    checked = F.when(fits, F.col("q").cast("array<int>")).otherwise(F.raise_error(F.lit("a scaled vector has an entry beyond 2^27")).cast("array<int>"))
    return rows.select("vec_id", checked.alias("q")).withColumn("digest", F.md5(F.array_join(F.col("q").cast("array<string>"), ",")))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the smaller at equal distance, and the exact squared distance."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # every term is a whole number that a double holds
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best]


def _sums(centroids: np.ndarray):  # noqa: ANN202
    """A batch's weighted sums and counts by centroid, as Python integers."""

    def make(batch: pa.RecordBatch) -> bytes:
        x, n = matrix(batch.column(0), centroids.shape[1]), batch.column(1).to_numpy()
        best, _ = nearest(x, centroids)
        if int(n.sum()) * max(1, int(np.abs(x).max(initial=0))) >= 1 << 62:
            x, n = x.astype(object), n.astype(object)
        sums, counts = np.zeros(centroids.shape, x.dtype), np.zeros(len(centroids), n.dtype)
        np.add.at(sums, best, x * n[:, None])
        np.add.at(counts, best, n)
        return pickle.dumps((sums.astype(object), counts.astype(object)))

    return make


def _added(a: bytes, b: bytes) -> bytes:
    return pickle.dumps(tuple(x + y for x, y in zip(pickle.loads(a), pickle.loads(b), strict=True)))


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid that has vectors becomes the floor of their weighted mean, the others stay."""
    state = folded(distinct.select("q", "n"), _sums(centroids), _added)
    sums, counts = pickle.loads(state)
    return np.array([[s // n for s in row] if n else list(old) for row, n, old in zip(sums, counts, centroids, strict=True)], np.int64)


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(digest, n, cluster, distance) of (digest, n, q)."""

    def make():  # noqa: ANN202
        def each(batch: pa.RecordBatch):  # noqa: ANN202
            best, distance = nearest(matrix(batch.column(2), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.int32()), pa.array(distance)], ["digest", "n", "cluster", "distance"])

        return each

    return map_batches(distinct.select("digest", "n", "q"), make, "digest string, n long, cluster int, distance long")


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["q"] for r in rows.select(order.alias("hash"), "q").orderBy("hash", "q").limit(k).collect()], np.int64)


def cluster_vectors(df: DataFrame, dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, multiplicity) of every kept vector of (vec_id, embedding)."""
    spark, rows = df.sparkSession, quantised(df, dims, scale)
    centroids = seeds(rows, k, seed)
    schema = f"vec_id {df.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, multiplicity long"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    distinct = cut(rows.groupBy("digest", "q").agg(F.count("*").alias("n")))
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    found = cut(assigned(distinct, centroids))

    total = F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)"))
    own = {r["cluster"]: (int(r["total"]), r["n"]) for r in found.groupBy("cluster").agg(total.alias("total"), F.sum("n").alias("n")).collect()}  # k rows at most
    whole_inertia, vectors = sum(x for x, _ in own.values()), sum(n for _, n in own.values())
    fits = lambda x: x if x < 1 << 63 else None
    told = [(c, fits(x), fits(whole_inertia), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, (x, _) in own.items()]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    hot = F.col("n") * HOT_SHARE > vectors  # fewer than HOT_SHARE vectors can have so many rows
    heavy = found.where(hot).join(F.broadcast(clusters), "cluster").withColumnRenamed("n", "multiplicity")
    light = found.where(~hot).join(F.broadcast(clusters), "cluster").withColumnRenamed("n", "multiplicity")
    ids = rows.select("vec_id", "digest")
    names = [c.split()[0] for c in schema.split(", ")]
    by_hot = ids.join(F.broadcast(heavy), "digest").select(*names)
    others = ids.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return by_hot.union(others.join(light, "digest").select(*names))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after another, over all vectors one by one."""
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = f"SELECT v.vec_id, v.q, arg_min(c.c, {distance} * 1000 + c.c) AS c, min({distance}) AS d FROM kept v, centroids{{0}} c GROUP BY v.vec_id, v.q"
    parts = [f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
centroids0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, q FROM kept ORDER BY c LIMIT {k})"""]
    for r in range(rounds):
        parts.append(f"""near{r} AS MATERIALIZED ({near.format(r)}),
sums{r} AS (SELECT c, pos, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM near{r}) GROUP BY c, pos),
means{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS q FROM sums{r} GROUP BY c),
centroids{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.q, o.q) AS q FROM centroids{r} o LEFT JOIN means{r} m ON o.c = m.c)""")
    return "WITH " + ",\n".join(parts) + f""",
last AS MATERIALIZED ({near.format(rounds)})
SELECT l.vec_id, CAST(l.c AS INTEGER) AS cluster, CAST(l.d AS BIGINT) AS distance, CAST(sum(l.d) OVER (PARTITION BY l.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(l.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY l.q) AS multiplicity
FROM last l JOIN centroids{rounds} c ON l.c = c.c"""


OP11_SQL = _op11_sql()
