"""Clustering of vectors around centroids over a VA-file: few-bit cells first, full vectors only where cells can't tell.

1. One pass gives each dimension's range, mean and spread, and with them up to CELLS cells; another writes the file, per
   vector a key, its cells (six bits a dimension), and the whole vector in a column of its own.
2. A lookup table has, for each dimension, cell and centroid, the least and the largest share that a component of that cell
   can have in the vector's distance. Summed over the dimensions that is an interval per centroid. Centroids whose interval starts
   above the least upper end are out; where one is left, the vector is assigned without being looked at. Distances are taken
   relative to the one to a common point (the centroids' mean), the part of them that is the same for all centroids: this
   makes their share linear in the component and the intervals narrow.
3. The first round needs every vector for the sums. Later rounds read cells alone and keep the sums up to date: only
   vectors with overlapping intervals, or of another cluster than before, are fetched, by key. Where those are more than
   ``fetch_share`` of all, the round streams the file's cells and vectors side by side instead, which shuffles nothing,
   and looks at a vector for its distances only where intervals overlap.
4. The last assignment asks for every distance, so it streams both again.

All arithmetic is on integers. What reaches the driver: 4 numbers a dimension, and per round a sum and a count of each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curation.llm.common import KeyFilter, table, written

#: Cells of a dimension, as many as six bits tell apart, and how many standard deviations to either side they divide.
CELLS, SPREAD = 64, 3.0
#: Share of all vectors up to which a round fetches them by key.
FETCH_SHARE = 0.1
#: Components beyond this would let distances of 64 dimensions overflow 64 bits; they are refused.
LARGEST = 1 << 27


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def packed(cells: np.ndarray) -> pa.Array:
    """Rows of cells as binaries: the six bits of four dimensions are three bytes."""
    a, b, c, d = np.moveaxis(np.pad(cells, ((0, 0), (0, -cells.shape[1] % 4))).reshape(len(cells), -1, 4), 2, 0)
    rows = np.stack([a << 2 | b >> 4, (b & 15) << 4 | c >> 2, (c & 3) << 6 | d], axis=2).reshape(len(cells), -1)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    a, b, c = np.moveaxis(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1, 3), 2, 0)
    return np.stack([a >> 2, (a & 3) << 4 | b >> 4, (b & 15) << 2 | c >> 6, c & 63], axis=2).reshape(len(column), -1)[:, :dims]


class Grid:
    """Cells per dimension: inner edges around the mean, outer cells up to the ends of the range."""

    def __init__(self, low: np.ndarray, high: np.ndarray, mean: np.ndarray, spread: np.ndarray):
        steps = np.linspace(-SPREAD, SPREAD, CELLS - 1)
        self.edges = np.rint(mean[:, None] + spread[:, None] * steps).astype(np.int64)
        self.least = np.concatenate([low[:, None], self.edges], axis=1)
        self.most = np.concatenate([self.edges - 1, high[:, None]], axis=1)

    def cells(self, v: np.ndarray) -> np.ndarray:
        found = np.empty(v.shape, np.uint8)
        for d in range(v.shape[1]):
            found[:, d] = np.searchsorted(self.edges[d], v[:, d], side="right")
        return found


class Intervals:
    """The lookup tables of a grid and its centroids."""

    def __init__(self, grid: Grid, centroids: np.ndarray):
        self.centroids = centroids
        middle = np.rint(centroids.mean(axis=0)).astype(np.int64)
        # (x - c)^2 - (x - m)^2 = c^2 - m^2 - 2 x (c - m), least and largest at the ends of a cell
        square, slope = (centroids**2 - middle**2).T[:, None, :], 2 * (centroids - middle).T[:, None, :]
        ends = [square - grid.least[:, :, None] * slope, square - grid.most[:, :, None] * slope]
        self.low, self.high = np.minimum(*ends), np.maximum(*ends)

    def possible(self, cells: np.ndarray) -> np.ndarray:
        """Per vector and centroid: may it be the nearest? Centroids that may tie are all possible."""
        low = np.zeros((len(cells), len(self.centroids)), np.int64)
        high = np.zeros_like(low)
        for d in range(len(self.low)):
            low += self.low[d][cells[:, d]]
            high += self.high[d][cells[:, d]]
        return low <= high.min(axis=1, keepdims=True)

    def nearest(self, possible: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and distance: exact distances only to possible centroids; of equal ones the smaller number."""
        best = np.full(len(v), np.iinfo(np.int64).max)
        cluster = np.zeros(len(v), np.int64)
        for c, centroid in enumerate(self.centroids):
            rows = np.flatnonzero(possible[:, c])
            distance = ((v[rows] - centroid) ** 2).sum(axis=1)
            closer = distance < best[rows]
            best[rows[closer]], cluster[rows[closer]] = distance[closer], c
        return cluster, best


class Sums:
    """A task's count and vector sum of each cluster, as rows."""

    def __init__(self, k: int, dims: int):
        self.n, self.total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)

    def add(self, cluster: np.ndarray, v: np.ndarray, sign: int = 1) -> None:
        for c in np.unique(cluster):
            rows = cluster == c
            self.n[c] += sign * int(rows.sum())
            self.total[c] += sign * v[rows].sum(axis=0)

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        some = np.flatnonzero((self.n != 0) | self.total.any(axis=1))
        own = {"cluster": pa.array(some, pa.int32()), "n": pa.array(self.n[some]), "total": pa.array(list(self.total[some]), pa.list_(pa.int64()))}
        return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(some), f.type)) for f in schema], schema=schema)

    @staticmethod
    def collected(df: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all tasks' rows in ``df``: k counts and k sums."""
        one = df.where("n is not null").select("cluster", "n", F.posexplode("total").alias("d", "x"))
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        # at most k * dims rows
        for r in one.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
            n[r["cluster"]], total[r["cluster"], r["d"]] = r["n"], r["x"]
        return n, total


STATE = pa.schema([("key", pa.int64()), ("cells", pa.binary()), ("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
STATE_SQL = "key long, cells binary, cluster int, n long, total array<long>"


def state_rows(key: pa.Array, cells: pa.Array, cluster: np.ndarray) -> pa.RecordBatch:
    count = len(key)
    return pa.RecordBatch.from_arrays([key, cells, pa.array(cluster, pa.int32()), pa.nulls(count, pa.int64()), pa.nulls(count, pa.list_(pa.int64()))], schema=STATE)


class VectorFile:
    """The vectors of ``df`` as a VA-file: key, id, cells, v."""

    def __init__(self, df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int):
        x = F.col(vector_col).cast("array<double>")
        finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
        kept = df.where(F.coalesce((F.size(x) == dims) & finite, F.lit(False)))
        self.dims = dims
        self.vectors = kept.select(F.col(id_col).alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"))
        self.grid = self._grid()

    def _grid(self) -> Grid | None:
        dims = self.dims

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, low, high, total, squares = 0, None, None, np.zeros(dims), np.zeros(dims)
            for batch in batches:
                v = matrix(batch.column(0), dims)
                if not len(v):
                    continue
                n += len(v)
                low = v.min(axis=0) if low is None else np.minimum(low, v.min(axis=0))
                high = v.max(axis=0) if high is None else np.maximum(high, v.max(axis=0))
                total += v.sum(axis=0, dtype=float)
                squares += (v.astype(float) ** 2).sum(axis=0)
            if n:
                if max(-int(low.min()), int(high.max())) > LARGEST:
                    raise ValueError(f"scaled components beyond {LARGEST} are not supported")
                yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims), *map(pa.array, (low, high, total, squares))], names=["d", "n", "low", "high", "total", "squares"])

        parts = self.vectors.select("v").mapInArrow(task, "d int, n long, low long, high long, total double, squares double")
        found = parts.groupBy("d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).orderBy("d").collect()
        self.count = found[0]["n"] if found else 0
        if not found:
            return None
        low, high = (np.array([r[c] for r in found], np.int64) for c in ("low", "high"))
        mean, squares = (np.array([r[c] / r["n"] for r in found]) for c in ("total", "squares"))
        return Grid(low, high, mean, np.sqrt(np.maximum(squares - mean**2, 0)))

    def first(self, k: int, prefix: str) -> np.ndarray:
        """The vectors of the smallest hashes of their ids; those without id come last, equal hashes in the vectors' order."""
        digest = F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")).cast("binary"), 256)
        rows = self.vectors.select(digest.alias("digest"), "v").orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
        return np.array([r["v"] for r in rows], np.int64)

    def write(self, centroids: np.ndarray) -> None:
        """Write the file, with the first assignment and its sums."""
        dims, grid, tables = self.dims, self.grid, Intervals(self.grid, centroids)
        schema = pa.schema([*STATE, ("id", pa.int64()), ("v", pa.list_(pa.int32()))])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, sums = TaskContext.get().partitionId() << 40, Sums(len(centroids), dims)
            for batch in batches:
                v = matrix(batch.column(1), dims)
                if not len(v):
                    continue
                cells = grid.cells(v)
                cluster, _ = tables.nearest(tables.possible(cells), v)
                sums.add(cluster, v)
                keys = pa.array(np.arange(key, key + len(v)))
                key += len(v)
                state = state_rows(keys, packed(cells), cluster)
                yield pa.RecordBatch.from_arrays([*state.columns, batch.column(0), pa.array(list(v.astype(np.int32)), pa.list_(pa.int32()))], schema=schema)
            yield sums.rows(schema)

        rows = self.vectors.select(F.col("id").cast("long"), "v").mapInArrow(task, f"{STATE_SQL}, id long, v array<int>")
        self.file = written(rows)
        self.state = self.file.select(*STATE.names)

    def streamed(self, centroids: np.ndarray) -> DataFrame:
        """The state after an assignment that reads cells and vectors side by side."""
        dims, tables = self.dims, Intervals(self.grid, centroids)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(len(centroids), dims)
            for batch in batches:
                if batch.num_rows:
                    v = matrix(batch.column(2), dims).astype(np.int64)
                    cluster, _ = tables.nearest(tables.possible(unpacked(batch.column(1), dims)), v)
                    sums.add(cluster, v)
                    yield state_rows(batch.column(0), batch.column(1), cluster)
            yield sums.rows(STATE)

        return self.file.where("key is not null").select("key", "cells", "v").mapInArrow(task, STATE_SQL)

    def judged(self, centroids: np.ndarray) -> DataFrame:
        """key, cells, was, now (null: intervals overlap), from the cells alone."""
        dims, tables = self.dims, Intervals(self.grid, centroids)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    possible = tables.possible(unpacked(batch.column(1), dims))
                    now = pa.array(possible.argmax(axis=1), pa.int32(), mask=possible.sum(axis=1) > 1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, now], names=["key", "cells", "was", "now"])

        return self.state.where("key is not null").select("key", "cells", "cluster").mapInArrow(task, "key long, cells binary, was int, now int")

    def fetched(self, wanted: DataFrame, centroids: np.ndarray) -> DataFrame:
        """The state of ``wanted`` (rows of ``judged``), and what their moves add to and take from the sums."""
        dims, tables = self.dims, Intervals(self.grid, centroids)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(len(centroids), dims)
            for batch in batches:
                if batch.num_rows:
                    was, v = batch.column(2).to_numpy(), matrix(batch.column(3), dims).astype(np.int64)
                    cluster, _ = tables.nearest(tables.possible(unpacked(batch.column(1), dims)), v)
                    moved = cluster != was
                    sums.add(cluster[moved], v[moved])
                    sums.add(was[moved], v[moved], -1)
                    yield state_rows(batch.column(0), batch.column(1), cluster)
            yield sums.rows(STATE)

        full = KeyFilter(wanted, ["key"], self.count).marked(self.file.where("key is not null").select("key", "v"), ["key"], "_wanted")
        rows = wanted.select("key", "cells", "was").join(full.where("_wanted").select("key", "v"), "key")
        return rows.select("key", "cells", "was", "v").mapInArrow(task, STATE_SQL)

    def assign(self, centroids: np.ndarray, sums: tuple, fetch_share: float) -> tuple[np.ndarray, np.ndarray]:
        """Assign every vector anew; the sums of the clusters then. Returns counts and sums."""
        k = len(centroids)
        judged = written(self.judged(centroids))
        open_ = judged.where("now is null or now <> was")
        self.fetch_counts.append(open_.count())
        if self.fetch_counts[-1] > fetch_share * self.count:
            self.state = written(self.streamed(centroids))
            return Sums.collected(self.state, k, self.dims)
        fetched = written(self.fetched(open_, centroids))
        n, total = Sums.collected(fetched, k, self.dims)
        settled = judged.where("now = was").select("key", "cells", F.col("now").alias("cluster"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<long>").alias("total"))
        self.state = settled.unionByName(fetched.where("n is null"))
        return sums[0] + n, sums[1] + total

    def measured(self, centroids: np.ndarray) -> DataFrame:
        """id, cluster, distance of every vector."""
        dims, tables = self.dims, Intervals(self.grid, centroids)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cluster, distance = tables.nearest(tables.possible(unpacked(batch.column(1), dims)), matrix(batch.column(2), dims).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

        return self.file.where("key is not null").select("id", "cells", "v").mapInArrow(task, "id long, cluster int, distance long")


def moved(centroids: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Each centroid that has vectors at the floor of their mean; the others stay."""
    return np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 16, rounds: int = 3, dims: int = 64,
    scale: int = 64, prefix: str = "1:", fetch_share: float = FETCH_SHARE, fetch_counts: list | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every usable vector, and the final centroids, as integers.

    Vectors that are null, of another length, or have a null, NaN or infinite component are left out. Rows that repeat an
    id count each for itself, equal vectors get equal answers, a null id is handed through and starts no cluster while
    others can. Fewer vectors than ``k`` give as many clusters; an empty table no rows. Other columns are not read.
    ``fetch_counts`` takes how many vectors the cells left open or moved in each round after the first.
    """
    file = VectorFile(df, id_col, vector_col, dims, scale)
    file.fetch_counts = [] if fetch_counts is None else fetch_counts
    if not file.count:
        empty = file.vectors.where("false").select(F.col("id").cast("long").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty, np.empty((0, dims), np.int64)
    centroids = file.first(k, prefix)
    file.write(centroids)
    sums = Sums.collected(file.state, len(centroids), dims)
    for i in range(rounds):
        if i:
            sums = file.assign(centroids, sums, fetch_share)
        centroids = moved(centroids, *sums)
    return file.measured(centroids).withColumnRenamed("id", id_col), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    found = written(found)
    # at most 16 rows
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids] or [""]
    sums = [inertia.get(c, 0) for c in range(len(digests))]

    def of(values: list, kind: str) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1).cast(kind)

    return found.select("vec_id", "cluster", "distance", of(sums, "long").alias("cluster_inertia"), F.lit(sum(sums)).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def _oracle(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds one after the other: d are all distances, a the assignments, c the centroids."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::BIGINT"
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS c, v AS w FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k}))",
        "rows_ AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, v FROM kept)",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': {distance}, 'c': c}}) AS best FROM rows_, c{i} GROUP BY r)")
        if i < rounds:
            parts.append(f"e{i} AS (SELECT best.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY ALL)")
            floor = "list((s - ((s % n) + n) % n) // n ORDER BY i)"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.w, o.w) AS w FROM c{i} o LEFT JOIN (SELECT c, {floor} AS w FROM e{i} GROUP BY c) m USING (c))")
    last = f"a{rounds}"
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, best.c AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,"
        f" sum(best.d) OVER ()::BIGINT AS inertia, sha256(list_aggregate(w, 'string_agg', ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} ON best.c = c"
    )


ORACLE = _oracle()
