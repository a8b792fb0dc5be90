"""Exact top-k by inner product: a Voronoi kNN join."""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietsky.llm.common import cut, table

#: Below it doubles hold every integer.
EXACT = float(1 << 53)
#: The scores that a long holds.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as double; null if the vector or a component is null or not finite, before or after scaling."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(scale * x.cast("double")) == float("inf")))
    whole = lambda y: F.when(F.abs(y) >= EXACT, y).otherwise(F.floor(y).cast("double"))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: whole(scale * x.cast("double"))))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _ranked(score: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, lowest: float | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores of the k best of each row of score, ties to the smaller column, what is `own` left out."""
    score[own] = lowest
    least = np.sort(np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k :], axis=1)[:, :1] if len(ids) > k else np.full((len(score), 1), lowest)
    row, col = np.nonzero((score >= least) & ~own)
    s = score[row, col]
    rank = np.lexsort((col, s * -1.0 if s.dtype == float else ~s, row))
    row, col, s = row[rank], col[rank], s[rank]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], s[keep]


def _best(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of data for each query, ties to the smaller id, a query's own id left out: query ids, ids, scores.

    Products that doubles do not hold exactly are made of integers: of 64 bits where these hold them, else of any size, and of such a score what a
    long can hold is returned. Rows with large components are solved apart, so that a few of them do not slow the others.
    """
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    dim = max(1, data.shape[1])
    large = lambda m: np.abs(m).max(axis=1, initial=0) ** 2 * dim >= EXACT
    out = [(np.zeros(0, dtype=np.int64),) * 3]
    for q_large in (False, True):
        for x_large in (False, True):
            qs, xs = np.flatnonzero(large(queries) == q_large), np.flatnonzero(large(data) == x_large)
            if not len(qs) or not len(xs):
                continue
            x, own_ids = data[xs], ids[xs]
            bound = dim * float(np.abs(queries[qs]).max(initial=0)) * float(np.abs(x).max(initial=0))
            for a in range(0, len(qs), 256):
                some = qs[a : a + 256]
                own = query_ids[some, None] == own_ids[None, :]
                if bound < EXACT:
                    row, col, s = _ranked(queries[some] @ x.T, own, own_ids, k, -np.inf)
                elif bound < 2.0**62:
                    row, col, s = _ranked(queries[some].astype(np.int64) @ x.T.astype(np.int64), own, own_ids, k, LEAST)
                else:
                    row, col, s = [], [], []
                    wide = [[int(v) for v in r] for r in x]
                    for i, q in enumerate([int(v) for v in r] for r in queries[some]):
                        each = [(-min(MOST, max(LEAST, sum(map(operator.mul, q, r)))), j) for j, r in enumerate(wide) if not own[i, j]]
                        for score, j in sorted(each)[:k]:
                            row.append(i)
                            col.append(j)
                            s.append(-score)
                    row, col, s = (np.array(v, dtype=np.int64) for v in (row, col, s))
                out.append((query_ids[some][row], own_ids[col], s.astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, n_pivots: int | None = None, group_size: int | None = None, block_size: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with every other row of vectors(vec_id, v).

    v: integral components as doubles; rows with a null id or v take no part. Rows with the query's own id are its own.
    As in SQL, every row counts: a row of data in two copies is two partners, and the rows of a repeated query id rank
    their partners together, so of two equal query rows each partner comes twice.
    Queries and data only meet where they have the same number of components. Other columns than vec_id, v and those of is_query are not read.

    Vectors may have any finite components, which only makes their products slower; a score beyond the range of a long is the end of that
    range, and what is equal then ranks by id. Ties rank by id; an empty table, or one without queries, gives no rows.

    n_pivots vectors, chosen by hash, divide both sides into Voronoi cells: without a number, an eighth of the root of the rows, from 32 to 1024. Of each cell the driver gets its count, its
    radius and its largest norm: at most n_pivots rows for each length of vector, and one for a length without pivots. Query cells are joined to groups of about
    group_size. Pivots are rows too, so a query's k-th best score is not below its k-th best pivot's. From the least of these in a cell and from the summaries comes, for each group, a score that its
    k-th best can't be below, and for each data cell one that it can't exceed; a cell goes to a group only if it may hold a better one. What a group needs lies in
    blocks of near cells, a large cell in several by hash, and a query goes only to blocks with a cell that may hold a better one for that query. So a hot cell,
    or one vector in very many copies, is many tasks. Each block is solved alone, and what it finds is merged by query, k rows for each block.
    Groups and blocks have at most about 2^20 components and 16,384 rows, if no size is given, so memory is bounded for long vectors too, down to 256 of these.
    """
    spark = vectors.sparkSession
    data = cut(vectors.where("vec_id is not null and v is not null").select("vec_id", "v", F.size("v").alias("dim"), is_query.alias("is_query")), "vectors")
    if n_pivots is None:
        n_pivots = min(1024, max(32, math.isqrt(data.count()) // 8))
    lists = data.where("dim > 0").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(n_pivots).collect()
    pivots = [np.array(r["v"]) for r in lists]
    pivot_ids = np.array([r["vec_id"] for r in lists], dtype=np.int64)
    dims = np.array([len(p) for p in pivots], dtype=np.int64)

    def cells(batches):
        for batch in batches:
            v = batch.column(1).to_pylist()
            ids, asks, least = batch.column(0).to_numpy(), batch.column(3).fill_null(False).to_numpy(zero_copy_only=False), np.full(len(v), -np.inf)
            cell, away, norm = np.full(len(v), -1, dtype=np.int32), np.full(len(v), np.inf), np.array([math.sqrt(sum(y * y for y in x)) if len(x) not in dims else 0.0 for x in v])
            for d in np.unique(dims):
                rows = np.array([i for i, x in enumerate(v) if len(x) == d], dtype=np.int64)
                if not len(rows):
                    continue
                x, own = np.array([v[i] for i in rows]), np.flatnonzero(dims == d)
                p = np.array([pivots[i] for i in own])
                wants = np.flatnonzero(asks[rows])
                least[rows[wants]] = _kth_best(x[wants], ids[rows[wants]], p, pivot_ids[own], k)
                gap = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :], 0))
                near = gap.argmin(1)
                cell[rows], away[rows], norm[rows] = own[near], gap[np.arange(len(rows)), near], np.sqrt((x * x).sum(1))
            cols = [*batch.columns, pa.array(cell), pa.array(away), pa.array(norm), pa.array(least)]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "dim", "is_query", "cell", "away", "norm", "least"])

    placed = cut(data.mapInArrow(cells, "vec_id long, v array<double>, dim int, is_query boolean, cell int, away double, norm double, least double"), "cells")
    summary = placed.groupBy("dim", "cell", "is_query").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm"), F.min("least").alias("least")).collect()
    own = placed.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("is_query").alias("asks")).where("asks").agg(F.max("n")).first()[0] or 0
    routes, group_of = _routes(summary, pivots, k, own, group_size, block_size)
    if not routes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")  # no queries
    plan = spark.createDataFrame(routes, "dim int, cell int, grp int, parts int, first int, blocks int")
    groups = spark.createDataFrame([(d, c, g, parts) for (d, c), (g, parts) in group_of.items()], "dim int, cell int, grp int, parts int")
    shapes: dict = {}  # by length and cell
    for r in summary:
        radius, far = shapes.get((r["dim"], r["cell"]), (0.0, 0.0))
        shapes[r["dim"], r["cell"]] = (max(radius, r["radius"]), max(far, r["norm"]))
    of_group: dict = {}
    for d, c, g, _, first, n in routes:
        of_group.setdefault((d, g), []).append((c, first, n))
    needs = {g: (d, np.array(each, dtype=np.int32).T) for (d, g), each in of_group.items()}  # cells and their blocks
    names = ["dim", "grp", "part", "block", "query_id", "q"]

    def asked(batches):
        for batch in batches:
            grp, v, norm, least = batch.column(1).to_numpy(), batch.column(4), batch.column(5).to_numpy(), batch.column(6).to_numpy()
            row, block = [], []
            for g in np.unique(grp):
                own = np.flatnonzero(grp == g)
                x = _matrix(pa.chunked_array([v.take(pa.array(own))]))
                d, (cell, first, n) = needs[g]
                radius, far = np.array([shapes[d, c] for c in cell.tolist()]).T
                wanted = _most(x, norm[own], pivots, cell, radius, far) >= least[own, None]
                for at, many in sorted(set(zip(first.tolist(), n.tolist(), strict=True))):
                    some = own[wanted[:, first == at].any(axis=1)]
                    for i in range(many):
                        row.append(some)
                        block.append(np.full(len(some), at + i, dtype=np.int32))
            for some, b in zip(row, block, strict=True):
                if len(some):
                    cols = [batch.column(i).take(pa.array(some)) for i in range(5)]
                    yield pa.RecordBatch.from_arrays([*cols[:3], pa.array(b), *cols[3:]], names=names)

    both = names[:4]
    # fresh reads, so that the two sides of the cogroup share no columns; a data row goes to every part of each group that needs its cell, in its block there
    by_hash = F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")
    right = placed.select(*[F.col(c).alias(c) for c in placed.columns]).join(F.broadcast(plan), ["dim", "cell"]).withColumn("block", by_hash).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*both, F.col("vec_id").alias("id"), F.col("v").alias("x"))
    part = F.pmod(F.xxhash64("v", "vec_id"), F.col("parts")).cast("int").alias("part")
    left = placed.where("is_query").join(F.broadcast(groups), ["dim", "cell"]).select("dim", "grp", part, "vec_id", "v", "norm", "least")
    left = left.mapInArrow(asked, "dim int, grp int, part int, block int, query_id long, q array<double>")

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        if not len(q) or not len(x):
            found = [np.zeros(0, dtype=np.int64)] * 3
        else:
            found = _best(_matrix(q.column("q")), q.column("query_id").to_numpy(), _matrix(x.column("x")), x.column("id").to_numpy(), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    found = left.groupBy(*both).cogroup(right.groupBy(*both)).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth_best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """A score that the k-th best of all rows can't be below: that of some rows, a query's own id left out, less what rounding may add; without k of them, no bound."""
    out = np.full(len(queries), -np.inf)
    if len(rows) < k or not len(queries):
        return out
    with np.errstate(over="ignore", invalid="ignore"):
        score = queries @ rows.T
        wide = np.sqrt((queries * queries).sum(1)) * np.sqrt((rows * rows).sum(1)).max()
        score[query_ids[:, None] == ids[None, :]] = -np.inf
        kth = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k]
        bound = np.clip(kth, LEAST, MOST) - 1e-6 - 1e-9 * np.minimum(wide, 2.0**64)
    known = np.isfinite(wide) & np.isfinite(kth)
    out[known] = bound[known]
    return out


def _most(queries: np.ndarray, norm: np.ndarray, pivots: list[np.ndarray], cell: np.ndarray, radius: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For each query and each cell a score that no row of the cell exceeds, by norms and by the cell's pivot and radius, more by what rounding may take away."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = norm[:, None] * far[None, :]
        near = np.flatnonzero((cell >= 0) & np.isfinite(radius))
        if len(near):
            p = np.array([pivots[c] for c in cell[near]])
            by_pivot = queries @ p.T + norm[:, None] * radius[near][None, :]
            most[:, near] = np.fmin(most[:, near], np.where(np.isfinite(by_pivot), by_pivot, np.inf))
        wide = norm[:, None] * (far + np.where(np.isfinite(radius), radius, 0.0))[None, :]
        most = np.clip(most, LEAST, MOST) + 1e-6 + 1e-9 * np.minimum(wide, 2.0**64)
    return np.where(np.isfinite(most) & np.isfinite(wide), most, np.inf)


def _bundles(cells: list[int], sizes: dict[int, int], gaps: np.ndarray, place: dict[int, int], most: int) -> list[tuple[list[int], int]]:
    """Cells joined with their nearest ones while they have at most `most` rows together; with their sums. gaps: distances of the cells that have a place."""
    out, left = [], sorted(cells)
    while left:
        seed = left.pop(0)
        bundle, size = [seed], sizes[seed]
        if seed >= 0 and size < most:
            others = [c for c in left if c >= 0]
            for i in np.argsort(gaps[place[seed], [place[c] for c in others]], kind="stable") if others else ():
                c = others[i]
                if size + sizes[c] > most:
                    break
                bundle.append(c)
                left.remove(c)
                size += sizes[c]
        out.append((bundle, size))
    return out


def _routes(summary: list, pivots: list[np.ndarray], k: int, own_rows: int, group_size: int | None, block_size: int | None) -> tuple[list, dict]:
    """Which data cells each group of query cells needs: (dim, cell, group, parts, first block, blocks); and each query cell's group and parts.

    own_rows: the most rows that any query's id has, in all cells; a bound from summaries needs k rows besides them.
    """
    routes, group_of, number = [], {}, 0
    for dim in sorted({r["dim"] for r in summary}):
        rows = max(256, min(16384, (1 << 20) // max(1, dim)))
        own = [r for r in summary if r["dim"] == dim]
        data = {}
        for r in own:
            n, radius, norm = data.get(r["cell"], (0, 0.0, 0.0))
            data[r["cell"]] = (n + r["n"], max(radius, r["radius"]), max(norm, r["norm"]))
        asks = {r["cell"]: (r["n"], r["radius"], r["norm"], r["least"]) for r in own if r["is_query"]}
        cells = sorted(data)
        m, rx, norm = (np.array(c) for c in zip(*[data[c] for c in cells], strict=True))
        place = {c: i for i, c in enumerate(c for c in cells if c >= 0)}
        p = np.array([pivots[c] for c in place]).reshape(len(place), dim)
        with np.errstate(over="ignore", invalid="ignore"):
            product, size_of = p @ p.T, np.sqrt((p * p).sum(1))
            gaps = size_of[:, None] ** 2 - 2 * product + size_of[None, :] ** 2
        has = np.array([c >= 0 for c in cells]) & np.isfinite(rx)
        for group, size in _bundles(list(asks), {c: a[0] for c, a in asks.items()}, gaps, place, group_size or rows):
            parts = max(1, -(-size // (group_size or rows)))
            needed = set()
            for i in group:
                _, rq, qnorm, least = asks[i]
                with np.errstate(over="ignore", invalid="ignore"):
                    low, high = -qnorm * norm, qnorm * norm
                    if i >= 0 and math.isfinite(rq):
                        at = np.array([place[c] for c, h in zip(cells, has, strict=True) if h], dtype=np.int64)
                        middle, one = product[place[i], at], size_of[place[i]]
                        slack = one * rx[has] + size_of[at] * rq + rq * rx[has] + 1e-9 * one * size_of[at]
                        low[has], high[has] = np.fmax(low[has], middle - slack), np.fmin(high[has], middle + slack)
                    low, high = (np.clip(np.where(np.isnan(b), none, b), LEAST, MOST) for b, none in ((low, -np.inf), (high, np.inf)))
                    order = np.argsort(-low, kind="stable")
                    enough = np.flatnonzero(np.cumsum(m[order]) >= k + own_rows)
                    if len(enough):
                        least = max(least, float(low[order[enough[0]]]))
                    slack = 1e-6 if math.isinf(least) else 1e-6 + 1e-9 * abs(least)
                    needed |= {cells[j] for j in np.flatnonzero(high + 1e-9 * np.abs(high) + slack >= least)}
            for c in group:
                group_of[dim, c] = (number, parts)
            first = 0
            for bundle, n in _bundles(list(needed), {c: d[0] for c, d in data.items()}, gaps, place, block_size or rows):
                blocks = max(1, -(-n // (block_size or rows)))
                routes += [(dim, j, number, parts, first, blocks) for j in sorted(bundle)]
                first += blocks
            number += 1
    return routes, group_of


def top_k_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % 20 == 0)


QUERIES = {"op10_voronoi_top_k": top_k_embeddings}

ORACLES = {
    "op10_voronoi_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id query_id, x.vec_id, list_inner_product(q.e, x.e)::bigint score from v q join v x on q.vec_id % 20 = 0 and q.vec_id <> x.vec_id and len(q.e) = len(x.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 20
""",
}
