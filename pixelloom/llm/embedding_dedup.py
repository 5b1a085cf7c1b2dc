"""Embedding near-duplicates by an inverted multi-index: a product grid of cells, visited nearest first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .components import components

COSINE = 0.95
#: Vectors aimed at for each cell; most codes for a half; rows of the sample that codebooks are fitted on, at least and for each code.
CELL_ROWS, MOST_CODES, SAMPLE, CODE_ROWS, KMEANS_ROUNDS = 100, 1024, 8192, 32, 12
#: Cells are visited until this share of made-up neighbours at the very threshold is reached.
RECALL, TRIALS = 0.95, 2048
#: Rows of one side of a tile.
TILE = 1024


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    out = np.array(rows, np.float64)
    out /= np.abs(out).max(1)[:, None]  # keeps squares of tiny and huge values in range
    out /= np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(vectors.flatten()).reshape(-1, dim)


def codebook(points: np.ndarray, codes: int, rounds: int = KMEANS_ROUNDS) -> np.ndarray:
    """k-means of a bounded sample."""
    order = np.random.default_rng(7).permutation(len(points))
    centres = points[order[:codes]].copy()
    for _ in range(rounds):
        own = distances(points, centres).argmin(1)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1))


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    visits: int

    def visit(self, units: np.ndarray, visits: int | None = None) -> np.ndarray:
        """For each row its nearest cells in rising order of distance, by multi-sequence traversal of the two sorted halves."""
        half = units.shape[1] // 2
        d = [distances(units[:, :half], self.first), distances(units[:, half:], self.second)]
        order = [x.argsort(1, kind="stable") for x in d]
        d = [np.take_along_axis(x, o, 1) for x, o in zip(d, order)]
        n = min(visits or self.visits, len(self.first) * len(self.second))
        out = np.empty((len(units), n), np.int64)
        for row in range(len(units)):
            u, v = d[0][row], d[1][row]
            heap, at = [(u[0] + v[0], 0, 0)], 0
            while at < n:
                _, i, j = heapq.heappop(heap)
                out[row, at] = order[0][row, i] * len(self.second) + order[1][row, j]
                at += 1
                if j + 1 < len(v):
                    heapq.heappush(heap, (u[i] + v[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(u):
                    heapq.heappush(heap, (u[i + 1] + v[0], i + 1, 0))
        return out


def codes_for(rows: int, cell_rows: int = CELL_ROWS) -> int:
    return int(min(MOST_CODES, max(1, math.sqrt(rows / cell_rows))))


def fit(units: np.ndarray, codes: int, cosine: float = COSINE, recall: float = RECALL) -> Index:
    """Codebooks on either half of a sample of unit vectors, ``codes`` each, and the visits it takes.

    For the visits, neighbours at a cosine of just ``cosine`` in random directions are made up for sampled vectors;
    cells are visited until the share ``recall`` of the neighbours' own cells is among them.  Real links are nearer.
    """
    half = units.shape[1] // 2
    codes = min(codes, len(units))
    out = Index(codebook(units[:, :half], codes), codebook(units[:, half:], codes), 1)
    draw = np.random.default_rng(11)
    base = units[draw.integers(0, len(units), TRIALS)]
    side = draw.standard_normal(base.shape)
    side -= (side * base).sum(1)[:, None] * base
    side /= np.maximum(1e-12, np.sqrt((side**2).sum(1)))[:, None]
    near = cosine * base + math.sqrt(1 - cosine**2) * side
    cells = codes * codes
    visits = 1
    while visits < cells:
        # a pair is met if either of the two visits the other's cell
        a, b = out.visit(base, visits), out.visit(near, visits)
        if ((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean() >= recall:
            break
        visits += max(1, visits // 4)
    out.visits = min(visits, cells)
    return out


_TILE_ROW = "cell, block, probes_block, row, n, probes, v, home"


def _cells(index: Index, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cells that each vector (row, n, v) visits, its own first."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                visited = index.visit(unit_rows(matrix(part.column("v"), dim))).astype(np.int32)
                probes = pa.FixedSizeListArray.from_arrays(pa.array(visited.ravel()), visited.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, probes], names=["row", "n", "v", "probes"])

    return cells


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that tie together what a boolean matrix ties."""
    rows, columns = np.ones(links.shape[0], bool), np.ones(links.shape[1], bool)
    out = []
    for start in np.flatnonzero(links.any(1)):
        todo = [start] if rows[start] else []
        rows[start] = False
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(links[i] & columns):
                columns[j] = False
                out.append((i, j))
                for k in np.flatnonzero(links[:, j] & rows):
                    rows[k] = False
                    todo.append(k)
                    out.append((k, j))
    return out


def _verify(cosine: float, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tiles (cell, block, probe block) sorted with the cell's own rows first: how many new links each row has, and
    edges that tie the linked ones: rows (a, b, n) with b null for the counts."""

    def tile(home: list, visiting: list) -> pa.RecordBatch | None:
        own, other = (np.array([r[0] for r in side], np.int64) for side in (home, visiting))
        here, there = (unit_rows(np.stack([r[3] for r in side])) for side in (home, visiting))
        met = (there @ here.T >= cosine) & (other[:, None] != own)
        i, j = np.nonzero(met)
        if not len(i):
            return None
        # Where the two visit each other's cell, the pair counts only in the tile that the smaller row visits.
        probes, homes = np.array([r[2] for r in home])[j], np.array([r[2][0] for r in visiting])[i]
        again = (probes == homes[:, None]).any(1) & (other[i] > own[j])
        met[i[again], j[again]] = False
        ids = np.concatenate([own, other])
        counts = np.concatenate([np.array([r[1] for r in visiting], np.int64) @ met, met @ np.array([r[1] for r in home], np.int64)])
        ids, counts = ids[counts > 0], counts[counts > 0]
        tied = spanning(met)
        a = np.concatenate([ids, other[[i for i, _ in tied]]])
        b = pa.array([None] * len(ids) + own[[j for _, j in tied]].tolist(), pa.int64())
        n = np.concatenate([counts, np.zeros(len(tied), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(n, pa.int64())], names=["a", "b", "n"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, visiting = None, [], []
        for batch in batches:
            vectors = matrix(batch.column("v"), dim)
            columns = [batch.column(c).to_pylist() for c in ("cell", "block", "probes_block", "row", "n", "probes", "home")]
            for *now, row, n, probes, is_home, v in zip(*columns, vectors):
                if now != key:
                    if home and visiting and (out := tile(home, visiting)):
                        yield out
                    key, home, visiting = now, [], []
                (home if is_home else visiting).append((row, n, probes, v))
        if home and visiting and (out := tile(home, visiting)):
            yield out

    return verify


def usable(v: Column, dim: int) -> Column:
    """Whether a vector is one at all: ``dim`` finite values, not all zero."""
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, infinite) & F.exists(v, lambda x: x != 0), F.lit(False))


def links(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for each row of ``vectors``.

    Equal vectors are folded into one with their number.  Codebooks for the two halves of the vectors are fitted on a
    bounded sample (``sample`` rows, or ``CODE_ROWS`` for each code, by hash of the row) and every distinct vector is
    indexed in the cell of its two nearest codes, about ``cell_rows`` to a cell.  Each visits its nearest cells in turn,
    and pairs met are verified by their cosine in double precision, so nothing below ``cosine`` links.  Cells are
    compared in tiles of at most about ``TILE`` vectors a side, which gives counts and edges that tie its links, not
    all pairs.  Vectors are shuffled in the type they have in the table.

    The dimension is that of most rows (1 included).  A vector that is null, zero, of another dimension, or has null or
    non-finite values links with nothing: 0 links, its own id as component.  Repeated ids are told apart as rows; a
    null id is never a component of others.  Other columns are left aside; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.store(rows.withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit("vector"), "v")), "vectors")
    sizes = rows.filter(F.size("v") > 0).groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    plain = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if sizes is None:
        return plain
    dim = sizes["dim"]
    good = rows.filter(usable(F.col("v"), dim))
    folded = scratch.store(good.groupBy("a", "b").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    count = folded.count()
    if not count:
        return plain
    single = good.select("row", "v").join(folded.select(F.col("first").alias("row"), "n"), "row").select("row", "n", "v")
    codes = codes_for(count, cell_rows)
    sample = max(sample, CODE_ROWS * codes)
    drawn = single.filter(F.xxhash64(F.lit("sample"), "row") / 2.0**64 + 0.5 <= min(1.0, sample / count)).orderBy("row").limit(2 * sample).select("v").toArrow()
    units = unit_rows(matrix(drawn.column("v").combine_chunks(), dim)) if drawn.num_rows else np.eye(dim)[:1]
    index = fit(units, codes, cosine)

    kind = rows.schema["v"].dataType.simpleString()
    placed = scratch.store(single.mapInArrow(_cells(index, dim), f"row long, n long, v {kind}, probes array<int>"), "cells")
    cells = placed.select("row", F.explode("probes").alias("cell"), (F.col("probes")[0] == F.col("cell")).alias("home"))
    plan = cells.groupBy("cell").agg(F.ceil(F.count_if("home") / TILE).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("probe_blocks"))
    plan = F.broadcast(scratch.store(plan.filter(F.col("blocks") > 0), "plan"))  # at most MOST_CODES squared cells
    home = placed.withColumn("cell", F.col("probes")[0]).join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    home = home.withColumn("probes_block", F.explode(F.sequence(F.lit(0), F.col("probe_blocks") - 1))).withColumn("home", F.lit(True))
    probe = placed.withColumn("cell", F.explode("probes")).withColumn("probes", F.slice("probes", 1, 1)).join(plan, "cell")
    probe = probe.withColumn("probes_block", F.pmod(F.xxhash64("row"), F.col("probe_blocks")).cast("int"))
    probe = probe.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("home", F.lit(False))
    names = _TILE_ROW.split(", ")
    tiles = home.select(names).unionAll(probe.select(names)).repartition("cell", "block", "probes_block").sortWithinPartitions("cell", "block", "probes_block", F.desc("home"), "row")
    found = scratch.store(tiles.mapInArrow(_verify(cosine, dim), "a long, b long, n long"), "links")

    counts = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("linked"))
    labels = components(found.filter(F.col("b").isNotNull()).select("a", "b"), scratch)
    classes = folded.join(counts, "first", "left").join(labels.withColumnRenamed("node", "first"), "first", "left")
    classes = scratch.store(classes.select("a", "b", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "first").alias("class")), "classes")
    known = rows.withColumn("good", usable(F.col("v"), dim)).drop("v")
    known = scratch.store(known.filter("good").join(classes, ["a", "b"]).select("id", "row", "n_links", "class"), "linked")
    least = scratch.store(known.groupBy("class").agg(F.min("id").alias("least")), "least")
    scratch.keep(rows, known, least)
    out = known.join(least, "class").select("id", "n_links", F.when(F.col("n_links") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
    out = out.unionAll(rows.filter(~usable(F.col("v"), dim)).select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
