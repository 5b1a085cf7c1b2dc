"""Centroid clustering by annulus search: exact integer k-means in which norms rule most centroids out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Longer vectors (in scaled units) are left out: the square of a distance between two of them need not fit in 64 bits.
LONGEST = 2.0**30
#: Rows compared at once, and how far square roots of integers below 2^62 and their sums may be off, relatively.
BATCH, SLACK = 8192, 1e-12


def scaled(v: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as int, null where the vector is none: another length, null or non-finite
    components, or longer than ``LONGEST``."""
    points = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    missing = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") * scale, 2))
    return F.when((F.size(v) == dim) & ~missing & (norm <= LONGEST**2 / 4), points).cast("array<int>")


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact in 64-bit integers."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Annuli:
    """Centroids sorted by norm."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt(np.einsum("ij,ij->i", centroids, centroids).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.centroids, self.norms = centroids, norms[self.order]
        self.compared = 0

    def assign(self, points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each point (ties: the smaller number) and the squared distance.

        The distance to centroid ``start`` bounds the nearest one's from above, and the norm of no centroid within it
        differs from the point's by more; such centroids are an interval of the sorted norms, found by two binary
        searches, and all of them are compared exactly, those on its edges included.
        """
        best, least = start.astype(np.int64), squares(points, self.centroids[start])
        norm = np.sqrt(np.einsum("ij,ij->i", points, points).astype(np.float64))
        reach = np.sqrt(least.astype(np.float64))
        slack = SLACK * (norm + reach) + 1e-9
        low = np.searchsorted(self.norms, norm - reach - slack, "left")
        high = np.searchsorted(self.norms, norm + reach + slack, "right")
        for at in range(low.min(initial=0), high.max(initial=0)):
            number = self.order[at]
            rows = np.flatnonzero((low <= at) & (at < high) & (start != number))
            self.compared += len(rows)
            d = squares(points[rows], self.centroids[number])
            nearer = (d < least[rows]) | ((d == least[rows]) & (number < best[rows]))
            best[rows[nearer]], least[rows[nearer]] = number, d[nearer]
        return best, least


def _points(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(-1, dim).astype(np.int64)


def _assign(centroids: np.ndarray, held: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (row, q, home) with their nearest centroid as ``home`` and its ``distance``, without q unless ``held``."""
    dim = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                home, distance = annuli.assign(_points(batch, "q", dim), np.asarray(batch.column("home")))
                names = ["row", "id", *(["q"] if held else [])]
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(home, pa.int32()), pa.array(distance, pa.int64())], names=[*names, "home", "distance"])

    return assign


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each centroid and component that the task's rows have: (cluster, at, total, n)."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, total, n = Annuli(centroids), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                points = _points(batch, "q", dim)
                home, _ = annuli.assign(points, np.asarray(batch.column("home")))
                order = np.argsort(home, kind="stable")
                own, first = np.unique(home[order], return_index=True)
                if len(own):
                    total[own] += np.add.reduceat(points[order], first)
                    n += np.bincount(home, minlength=k)
        own = np.flatnonzero(n)
        columns = (np.repeat(own, dim), np.tile(np.arange(dim), len(own)), total[own].ravel(), np.repeat(n[own], dim))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "at", "total", "n"])

    return sums


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector that is kept.

    Vectors of ``dim`` finite components are kept and scaled to integers, ``floor(scale * x)``.  Centroids start as
    the ``clusters`` vectors whose ids hash smallest (sha256 of ``seed:id``; of equal ids, by components), or as many
    as there are.  In each round every vector goes to its nearest centroid (ties: the smaller number), then each
    centroid becomes the floor of the mean of its vectors, and stays where it has none.  Sums are exact.

    The scaled vectors are stored once with the first round's centroid, whose present place bounds each search of the
    later rounds, so that a round reads them, writes nothing, and shuffles one partial sum for each task, centroid and
    component: a centroid that holds a third of all vectors is summed where they lie.  Only centroids (``clusters``
    times ``dim`` numbers, both parameters) reach the driver.

    A vector that is null, of another length, with null or non-finite components, or longer than 2^29 scaled units
    (whose squared distances may not fit in 64 bits) gives no row.  A null id is a vector like others, and hashes as
    the empty text.  Repeated rows and ids each give a row.  An inertia beyond 64 bits is null.  Other columns are
    left aside; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    rows = vectors.select(F.col(id_col).alias("id"), scaled(F.col(vector_col), dim, scale).alias("q")).filter(F.col("q").isNotNull())
    rows = scratch.store(rows.withColumn("row", F.monotonically_increasing_id()), "scaled")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(key, "q", "row").limit(clusters).select("q").collect()
    kind = vectors.schema[id_col].dataType
    if not first:
        fields = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return rows.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in fields.split(", "))])
    centroids = np.array([r["q"] for r in first], np.int64)
    fields = f"row long, id {kind.simpleString()}, home int, distance long"
    placed = rows.withColumn("home", F.lit(0)).mapInArrow(_assign(centroids, True), fields.replace("home", "q array<int>, home"))
    placed = scratch.store(placed, "placed")
    scratch.drop(rows)
    for _ in range(rounds):
        sums = placed.select("q", "home").mapInArrow(_sums(centroids), "cluster long, at long, total long, n long")
        sums = sums.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        moved = centroids.copy()
        for r in sums.collect():
            moved[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
        if (moved == centroids).all():
            break  # the rounds that are left would change nothing
        centroids = moved
    last = scratch.store(placed.select("row", "id", "q", "home").mapInArrow(_assign(centroids, False), fields), "assigned")
    scratch.drop(placed)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total = last.groupBy("home").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    fits = lambda x: x if x < 2**63 else None
    whole = fits(sum(int(r["total"]) for r in total))
    known = spark.createDataFrame([(r["home"], fits(int(r["total"])), whole, shas[r["home"]]) for r in total], "home int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = last.join(F.broadcast(known), "home")  # at most one row for each of ``clusters``
    return out.select(F.col("id").alias(id_col), F.col("home").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _round(n: int) -> str:
    """A round of OP13_SQL: the nearest centroid of each vector among c{n-1}, then the new centroids c{n}."""
    return f"""
d{n} AS MATERIALIZED (
  SELECT v.vec_id, c.k, sum((v.q - c.q) * (v.q - c.q))::BIGINT AS d FROM q v JOIN c{n - 1} c USING (i) GROUP BY v.vec_id, c.k),
a{n} AS MATERIALIZED (
  SELECT vec_id, k, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM d{n}) AS x WHERE r = 1),
m{n} AS MATERIALIZED (
  SELECT a.k, v.i, sum(v.q)::BIGINT AS s, count(*) AS n FROM a{n} a JOIN q v USING (vec_id) GROUP BY a.k, v.i),
c{n} AS MATERIALIZED (
  SELECT c.k, c.i, CASE WHEN m.n IS NULL THEN c.q ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS q
  FROM c{n - 1} c LEFT JOIN m{n} m ON m.k = c.k AND m.i = c.i)"""


OP13_SQL = (
    """
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (
  SELECT vec_id, i, floor(x::DOUBLE * 1024)::BIGINT AS q
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept) AS y),
first AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM kept QUALIFY k < 8),
c0 AS MATERIALIZED (SELECT f.k, v.i, v.q FROM first f JOIN q v USING (vec_id)),"""
    + ",".join(_round(n) for n in range(1, ROUNDS + 2))
    + f""",
shas AS (SELECT k, sha256(string_agg(q::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT a.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, s.centroid_sha256
FROM a{ROUNDS + 1} a JOIN shas s ON s.k = a.k
"""
)
