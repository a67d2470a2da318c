"""Exact integer centroid clustering with sorted scans of the centroids.

Vectors become integers once and are kept as blocks of some thousands in a table
of the shared folder, with their present clusters.  A round is one pass without
a shuffle of vectors: each block reads the centroids (k small rows, sent with
the task), assigns its vectors and adds its sums by cluster to its row; the sums
are then added by Spark from that column alone, and only the k new centroids
reach the driver.  Where a round leaves every centroid as it was, the rounds
that would follow change nothing and are left out.

A block's vectors of one cluster scan the other centroids by their distance from
that cluster's centroid, nearest first.  By the triangle inequality a centroid
strictly beyond twice a vector's distance from its present centroid is strictly
farther, and so are all after it: the vector stops there, and ties are still
seen.  Vectors are held in order of that distance, so those that go on are a
prefix.  All distances are exact integers: products of components below 2**23
are sums of doubles below 2**53, larger ones are taken as Python integers.

Defined results for odd input
-----------------------------
* a vector that is null, of another length, or has a null, NaN or infinite component is not kept and gives no row;
* null, equal and repeated ids: every row is a vector of its own; a null id is hashed as ``<seed>:``;
* starting vectors with one hash (equal ids) go by their components; fewer kept vectors than centroids give fewer centroids;
* vectors at equal distance of two centroids go to the smaller number; a centroid without vectors stays where it is;
* scaled components beyond 2**62 count as 2**62; a distance or a sum of distances that no long can hold is null;
* an empty table gives no rows; further columns, of any name, are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm.shared import shared_dir

#: Vectors of a block at most.
BLOCK = 8192
#: Components below this are multiplied as doubles without loss.
NARROW = 1 << 23
#: Scaled components end here; parts of sums are split at this bit.
FAR, PART = 1 << 62, 31


@dataclass(frozen=True)
class Settings:
    k: int = 8
    rounds: int = 10
    seed: int = 3
    dims: int = 64
    scale: int = 1024


@dataclass(frozen=True)
class Clustering:
    """``rows``: (id, cluster, distance) of every kept vector; ``inertias``: distances summed by cluster, None beyond a long."""

    rows: DataFrame
    centroids: list[list[int]]
    inertias: list[int | None]


class Centroids:
    """Integer centroids and, for each, the others by distance."""

    def __init__(self, points: list[list[int]]):
        self.k = len(points)
        self.exact = np.array(points, object)
        self.narrow = bool(self.k) and max(abs(x) for p in points for x in p) < NARROW
        if self.narrow:
            self.points = np.array(points, np.float64)
            self.squares = np.array([sum(x * x for x in p) for p in points], np.int64)
        #: For each centroid the numbers of the others and their squared distances, nearest first.
        self.order = []
        for a in range(self.k):
            apart = [(int(((self.exact[a] - self.exact[b]) ** 2).sum()), b) for b in range(self.k) if b != a]
            self.order.append(sorted(apart))

    def assign(self, vectors: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector and the squared distance; ``present`` are the clusters that scans start from."""
        narrow = self.narrow and (not vectors.size or int(np.abs(vectors).max()) < NARROW)
        values = vectors.astype(np.float64 if narrow else object)
        clusters, distances = np.empty(len(vectors), np.int32), np.empty(len(vectors), np.int64 if narrow else object)

        def apart(rows: np.ndarray, squares: np.ndarray, c: int) -> np.ndarray:
            if narrow:
                return squares - 2 * (rows @ self.points[c]).astype(np.int64) + self.squares[c]
            return ((rows - self.exact[c]) ** 2).sum(axis=1)

        for c in np.unique(present).tolist():
            at = np.flatnonzero(present == c)
            rows = values[at]
            squares = (rows * rows).sum(axis=1).astype(np.int64) if narrow else np.zeros(len(at), object)
            own = apart(rows, squares, c)
            back = np.argsort(-own, kind="stable")  # the farthest first: those that scan on are a prefix
            at, rows, squares, own = at[back], rows[back], squares[back], own[back]
            best, where, reach = own.copy(), np.full(len(at), c, np.int32), -4 * own
            for between, other in self.order[c]:
                n = int(np.searchsorted(reach, -between, side="right"))
                if not n:
                    break  # strictly beyond twice the distance of every vector
                new = apart(rows[:n], squares[:n], other)
                nearer = (new < best[:n]) | ((new == best[:n]) & (other < where[:n]))
                best[:n][nearer] = new[nearer]
                where[:n][nearer] = other
            clusters[at], distances[at] = where, best
        return clusters, distances


def _parts(values: np.ndarray, clusters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the sums of int64 ``values`` (rows, columns) by cluster: neither overflows in a block."""
    high, low = np.zeros((k, values.shape[1]), np.int64), np.zeros((k, values.shape[1]), np.int64)
    for c in np.unique(clusters).tolist():
        own = values[clusters == c]
        high[c], low[c] = (own >> PART).sum(axis=0), (own & ((1 << PART) - 1)).sum(axis=0)
    return high, low


def _state(id_type: str) -> str:
    return f"ids array<{id_type}>, vectors binary, wide boolean, clusters array<int>, distances array<long>, counts array<long>, high array<long>, low array<long>, unfit array<long>, far array<long>, near array<long>"


def _list(values) -> pa.Array:
    """One row that holds the array ``values``."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, integer vectors, cluster 0 for each) of rows (id, components)."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, s.dims)
            with np.errstate(over="ignore"):
                whole = np.floor(x * s.scale)
            edge = np.abs(whole) >= FAR
            vectors = np.where(edge, 0, whole).astype(np.int64)
            vectors[edge] = np.where(whole[edge] > 0, FAR, -FAR)
            yield part.column(0), vectors, np.zeros(part.num_rows, np.int32)


def _stored(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The same of blocks that an earlier round wrote."""
    for batch in batches:
        for k in range(batch.num_rows):
            wide = batch.column(2)[k].as_py()
            vectors = np.frombuffer(batch.column(1)[k].as_buffer(), "<i8" if wide else "<i4").reshape(-1, s.dims)
            yield batch.column(0)[k].values, vectors, batch.column(3)[k].values.to_numpy(zero_copy_only=False)


def _advance(source: DataFrame, read, centroids: list[list[int]], s: Settings, id_type: str) -> DataFrame:
    """The blocks of ``source`` with the clusters, distances and sums under ``centroids``."""
    names = [part.split()[0] for part in _state("x").split(", ")]

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Centroids(centroids)
        for ids, vectors, present in read(batches, s):
            clusters, distances = model.assign(vectors, present)
            wide = vectors.itemsize == 8 and bool(len(vectors)) and int(np.abs(vectors).max()) >= 1 << 31
            fits = distances <= np.iinfo(np.int64).max
            fit = np.where(fits, distances, 0).astype(np.int64)
            high, low = _parts(vectors.astype(np.int64), clusters, model.k)
            far, near = _parts(fit[:, None], clusters, model.k)
            columns = [
                _list(ids),
                pa.array([vectors.astype("<i8" if wide else "<i4").tobytes()], pa.binary()),
                pa.array([wide]),
                _list(clusters),
                _list(pa.array(fit, mask=~fits.astype(bool))),
                _list(np.bincount(clusters, minlength=model.k)),
                _list(high.ravel()),
                _list(low.ravel()),
                _list(np.bincount(clusters[~fits.astype(bool)], minlength=model.k)),
                _list(far.ravel()),
                _list(near.ravel()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(advance, _state(id_type))


def _sums(table: DataFrame, *columns: str) -> dict[str, list[int]]:
    """Elementwise sums of array columns of ``table``: as many numbers as an array has, whatever the rows."""
    rows = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("values")) for c in columns])).alias("x"))
    each = rows.select("x.name", F.posexplode("x.values").alias("pos", "v"))
    found = each.groupBy("name", "pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = {c: [0] * (1 + max([-1, *[r.pos for r in found if r.name == c]])) for c in columns}
    for r in found:
        out[r.name][r.pos] = int(r.v)
    return out


def _whole(high: list[int], low: list[int]) -> list[int]:
    return [(a << PART) + b for a, b in zip(high, low, strict=True)]


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, s: Settings) -> DataFrame:
    """(id, x): the ids and components, as doubles, of the vectors that are whole."""
    x = F.col(vec_col).cast("array<double>")
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), x.alias("x")).filter((F.size("x") == s.dims) & ~odd)


def starting_vectors(kept: DataFrame, s: Settings) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids, as integers."""
    name = F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = kept.select(F.sha2(name, 256).alias("hash"), "x").orderBy("hash", "x").limit(s.k).collect()
    if not rows:
        return []
    batch = pa.RecordBatch.from_arrays([pa.nulls(len(rows)), pa.array([r.x for r in rows], pa.list_(pa.float64()))], ["id", "x"])
    return [vector.tolist() for _, block, _ in _packed(iter([batch]), s) for vector in block]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings = Settings()) -> Clustering:
    """Clusters of all whole vectors after ``settings.rounds`` rounds and a last assignment.

    A round's table replaces the one before it, which nothing reads any more once the new one is whole.
    """
    s, spark = settings, vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vec_col, s)
    id_type = kept.schema["id"].dataType.simpleString()
    centroids = starting_vectors(kept, s)
    if not centroids:
        return Clustering(spark.createDataFrame([], f"id {id_type}, cluster int, distance long"), [], [])
    source, read, earlier = kept, _packed, None
    for left in range(s.rounds, -1, -1):
        path = shared_dir(spark)
        _advance(source, read, centroids, s, id_type).write.option("compression", "none").parquet(path)
        table = spark.read.schema(_state(id_type)).parquet(path)
        if earlier:
            _delete(spark, earlier)
        source, read, earlier = table, _stored, path
        if not left:
            break
        found = _sums(table, "counts", "high", "low")
        whole = _whole(found["high"], found["low"])
        new = [
            [x // n for x in whole[c * s.dims : (c + 1) * s.dims]] if n else centroids[c]
            for c, n in enumerate(found["counts"])
        ]
        if new == centroids:
            break  # the table holds the last assignment already
        centroids = new
    found = _sums(table, "unfit", "far", "near")
    most = np.iinfo(np.int64).max
    inertias = [None if unfit or x > most else x for unfit, x in zip(found["unfit"], _whole(found["far"], found["near"]), strict=True)]
    rows = table.select(F.explode(F.arrays_zip("ids", "clusters", "distances")).alias("r"))
    return Clustering(rows.select(F.col("r.ids").alias("id"), F.col("r.clusters").alias("cluster"), F.col("r.distances").alias("distance")), centroids, inertias)


def oracle(s: Settings = Settings()) -> str:
    """The same in DuckDB SQL over ``embeddings``, every distance computed."""
    floor = "(({a}) - ((({a}) % n) + n) % n) // n"
    parts = [
        "kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = "
        f"{s.dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)",
        "v AS MATERIALIZED (SELECT r, d, CAST(floor(CAST(embedding[d] AS DOUBLE) * "
        f"{s.scale}) AS BIGINT) AS x FROM kept, generate_series(1, {s.dims}) AS t(d))",
        f"starts AS (SELECT r, row_number() OVER (ORDER BY sha256('{s.seed}:' || vec_id), embedding) - 1 AS c FROM kept QUALIFY c < {s.k})",
        "c0 AS MATERIALIZED (SELECT c, d, x FROM starts JOIN v USING (r))",
    ]
    for k in range(s.rounds + 1):
        parts.append(f"d{k} AS MATERIALIZED (SELECT r, c, sum((v.x - c{k}.x) * (v.x - c{k}.x)) AS dist FROM v JOIN c{k} USING (d) GROUP BY r, c)")
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, c, dist FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1)")
        if k < s.rounds:
            mean = f"m{k} AS (SELECT c, d, sum(v.x) AS s, count(*) AS n FROM v JOIN a{k} USING (r) GROUP BY c, d)"
            new = f"c{k + 1} AS MATERIALIZED (SELECT c, d, CASE WHEN n IS NULL THEN x ELSE {floor.format(a='s')} END AS x FROM c{k} LEFT JOIN m{k} USING (c, d))"
            parts += [mean, new]
    last = s.rounds
    return (
        "WITH " + ",\n".join(parts) + f",\ndigest AS (SELECT c, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY d)) AS h FROM c{last} GROUP BY c)\n"
        "SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,\n"
        "CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, h AS centroid_sha256\n"
        f"FROM a{last} JOIN kept USING (r) JOIN digest USING (c)"
    )
