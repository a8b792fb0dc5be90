"""Centroid clustering of integer vectors: distances by blocked matrix products, sums by a tree of tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsky.llm.common import cut, table, unused

#: Below it doubles hold every integer.
EXACT = float(1 << 53)
#: The integers that a long holds.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Vectors of a block.
BLOCK = 2048
#: Sums go up through so many levels of tasks.
DEPTH = 3


def quantised(x: np.ndarray, scale: int = 64) -> np.ndarray:
    """floor(scale * x): as float64 where all products of two such numbers stay exact, as int64 where longs hold them, else Python integers."""
    x = x.astype(np.float64)
    most = float(np.abs(x).max(initial=0))
    if most * scale < EXACT:
        return np.floor(x * scale)
    whole = lambda v: int(v) * scale if abs(v) >= EXACT else int(np.floor(v * scale))
    return np.array([[whole(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest row of centroids, the smaller number on ties, and the squared distance.

    |x|^2 - 2 x.c + |c|^2, by one matrix product. No term and no partial sum is above 4 x dimensions x (largest component)^2; below 2^53 doubles are exact, below 2^63
    longs are, and beyond that Python integers compute.
    """
    largest = max([abs(int(v)) for m in (x, centroids) if m.size for v in (m.max(), m.min())], default=0)
    bound = 4 * max(1, x.shape[1]) * largest * largest
    kind = np.float64 if bound < EXACT else np.int64 if bound < 1 << 63 else object
    x, c = (m if m.dtype == kind else (m.astype(np.int64) if kind is not object else np.vectorize(int, otypes=[object])(m) if m.size else m).astype(kind) for m in (x, centroids))
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    best = np.argmin(d, axis=1)
    return best, d[np.arange(len(x)), best]


def _block(raw: bytes, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind).reshape(-1, dim)


def blocks(vectors: DataFrame, column: str, dim: int, others: list[str]) -> DataFrame:
    """Rows of up to BLOCK vectors: `rows` (the other columns, as an Arrow stream) and `block` (components as bytes, in the column's own type)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                rows, sink = part.select(others), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                values = part.column(column).flatten().to_numpy(zero_copy_only=False)
                assert len(values) == part.num_rows * dim
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["rows", "block"])

    return vectors.select(*others, column).mapInArrow(run, "rows binary, block binary")


def round_of(packed: DataFrame, kind: str, centroids: np.ndarray, scale: int) -> tuple[list[int], list[list[int]], list[int]]:
    """Of each cluster: its number of vectors, their sum, and their summed squared distance, all exact.

    A task gives one sum for each cluster, whatever its number of vectors, and a tree of tasks adds them, so the driver gets a few of them.
    """
    n, dim = centroids.shape
    shared = packed.sparkSession.sparkContext.broadcast(centroids)

    def add(total: list | None, row: Iterable[bytes]) -> list:
        x = quantised(_block(row[0], kind, dim), scale)
        cluster, distance = nearest(x, shared.value)
        total = total or [[0] * n, [[0] * dim for _ in range(n)], [0] * n]
        for k in np.unique(cluster).tolist():
            own = cluster == k
            some = x[own]
            if some.dtype != object and float(np.abs(some).max(initial=0)) * len(some) >= EXACT:
                some = some.astype(np.int64).astype(object)
            total[0][k] += int(own.sum())
            total[1][k] = [a + int(b) for a, b in zip(total[1][k], some.sum(axis=0).tolist(), strict=True)]
            total[2][k] += sum(map(int, distance[own].tolist()))
        return total

    def both(a: list | None, b: list | None) -> list | None:
        if not a or not b:
            return a or b
        return [[p + q for p, q in zip(a[0], b[0], strict=True)], [[p + q for p, q in zip(s, t, strict=True)] for s, t in zip(a[1], b[1], strict=True)], [p + q for p, q in zip(a[2], b[2], strict=True)]]

    found = packed.select("block").rdd.treeAggregate(None, add, both, DEPTH)
    shared.unpersist()
    return found or ([0] * n, [[0] * dim for _ in range(n)], [0] * n)


def first_centroids(vectors: DataFrame, key: str, column: str, dim: int, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest hashes of `seed:key`. Ties, of rows with one key, go by the vector; null keys come last."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).asc_nulls_last(), F.col(column)]
    rows = vectors.orderBy(*order).limit(k).select(column).collect()
    return _narrow(quantised(np.array([r[0] for r in rows], dtype=np.float64).reshape(len(rows), dim), scale))


def _narrow(x: np.ndarray) -> np.ndarray:
    """As int64 where longs hold all of x."""
    whole = [[int(v) for v in row] for row in x.tolist()]
    fits = all(LEAST <= v <= MOST for row in whole for v in row)
    return np.array(whole, dtype=np.int64 if fits else object).reshape(x.shape)


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", *, dim: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64) -> DataFrame:
    """Adds to each kept row of vectors: cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Kept are vectors with exactly `dim` components, none null or not finite; a component x counts as floor(scale * x), of any size. The k first centroids are the vectors
    of the smallest key hashes, fewer if there are fewer vectors; a round assigns each vector to the nearest one, ties to the smaller number, and moves each
    centroid that has vectors to the floor of their mean. Repeated rows are vectors of their own, and count as often; a null key is kept, and
    comes last among the first centroids; no kept vector gives no rows. The other columns stay, of any groupable type and name;
    one named as a result is replaced. Distances and inertias beyond a long are its largest value.
    The driver has k sums at a time; vectors are read once from their table, and then from blocks in the shared folder, once a round.
    """
    spark = vectors.sparkSession
    results = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    others = [c for c in vectors.columns if c != column and c not in results]
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.where((F.size(column) == dim) & ~bad)
    kind = "<f4" if dict(vectors.dtypes)[column] == "array<float>" else "<f8"
    kept = kept if kind == "<f4" else kept.withColumn(column, F.col(column).cast("array<double>"))
    schema = kept.select(*others).schema
    centroids = first_centroids(kept, key, column, dim, k, seed, scale)
    packed = cut(blocks(kept, column, dim, others), "blocks")
    added = "cluster int, distance long"
    if not len(centroids):
        inertia: list[int] = []
    else:
        for _ in range(rounds):
            count, total, _ = round_of(packed, kind, centroids, scale)
            centroids = _narrow(np.array([[v // m for v in t] if m else c for m, t, c in zip(count, total, centroids.tolist(), strict=True)], dtype=object))
        inertia = round_of(packed, kind, centroids, scale)[2]
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw in zip(batch.column(0), batch.column(1), strict=True):
                own = pa.ipc.open_stream(rows.as_py()).read_next_batch()
                found, distance = nearest(quantised(_block(raw.as_py(), kind, dim), scale), shared.value)
                near = pa.array([min(MOST, int(d)) for d in distance.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found.astype(np.int32)), near], names=[*own.schema.names, "cluster", "distance"])

    each = packed.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), added]))
    digest = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids.tolist()]
    places = [(i, min(MOST, s), h) for i, (s, h) in enumerate(zip(inertia, digest, strict=True))]
    c = unused(each, "_c")
    names = spark.createDataFrame(places, f"{c} int, cluster_inertia long, centroid_sha256 string")  # a row for each centroid
    return each.join(F.broadcast(names), F.col("cluster") == F.col(c)).select(*others, "cluster", "distance", "cluster_inertia", F.lit(min(MOST, sum(inertia))).cast("long").alias("inertia"), "centroid_sha256")


def cluster_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _rounds(n: int) -> str:
    """CTEs a1 to an: each vector's nearest centroid of c0 to c(n-1), and the centroids after each."""
    return ",\n".join(
        f"""d{i + 1} as materialized (
  select r, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from v cross join c{i}
), a{i + 1} as materialized (
  select * exclude (n) from (select *, row_number() over (partition by r order by distance, cluster) as n from d{i + 1}) where n = 1
), m{i + 1} as (
  select cluster, k, floor(sum(x[k])::double / count(*))::bigint as y from a{i + 1}, unnest(range(1, 65)) as t(k) group by cluster, k
), c{i + 1} as materialized (
  select c{i}.cluster, coalesce(any_value(m.c), any_value(c{i}.c)) as c from c{i} left join (select cluster, list(y order by k) as c from m{i + 1} group by cluster) m on m.cluster = c{i}.cluster group by c{i}.cluster
)"""
        for i in range(n)
    )


ORACLE = f"""
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda y: floor(64 * y::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0
), c0 as materialized (
  select (row_number() over (order by h, x) - 1)::integer as cluster, x as c from (select x, sha256('1:' || vec_id) as h from v) order by h, x limit 16
), {_rounds(4)}
select vec_id, a.cluster, distance, sum(distance) over (partition by a.cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256
from a4 a join c3 on c3.cluster = a.cluster
"""

QUERIES = {"op12_centroid_clusters": cluster_embeddings}
ORACLES = {"op12_centroid_clusters": ORACLE}
