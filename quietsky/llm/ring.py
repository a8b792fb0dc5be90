"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietsky.llm.common import cut, table, unused

#: Copies of one row that are expanded at once.
RUN = 4096


def virtual_nodes(n_shards: int, vnodes: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and shards of all virtual nodes, in ring order. A shard's nodes do not depend on the other shards."""
    at = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big"), s)
        for s in range(n_shards)
        for v in range(vnodes)
    )
    return np.array([p * cells >> 64 for p, _ in at]), np.array([s for _, s in at])


def deal(counts: np.ndarray, n_shards: int, vnodes: int, load_factor: float) -> list[tuple[int, int, int, int, int]]:
    """Deals the ring's cells to shards: pieces (cell, from, to, shard, first slot), ranks within the cell.

    Keys first fill the shard of the next virtual node, in ring order and up to its
    capacity; what finds it full goes on clockwise to the next shard with room.
    At load_factor 1 capacities are the mean rounded down or up, so counts are at most one apart.
    """
    cells, total = len(counts), int(counts.sum())
    if load_factor < 1:
        raise ValueError("load_factor below 1 leaves keys without a shard")
    if load_factor == 1:
        room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    else:
        room = [int(np.ceil(load_factor * total / n_shards))] * n_shards
    node_cell, node_shard = virtual_nodes(n_shards, vnodes, cells)
    first = np.searchsorted(node_cell, np.arange(cells), side="left") % len(node_cell)
    load = [0] * n_shards
    pieces, over = [], []
    for cell in np.flatnonzero(counts):
        shard, n = int(node_shard[first[cell]]), int(counts[cell])
        fits = min(n, room[shard] - load[shard])
        if fits:
            pieces.append((int(cell), 0, fits, shard, load[shard]))
            load[shard] += fits
        if fits < n:
            over.append((int(cell), fits, n))
    for cell, lo, n in over:
        node = int(first[cell])
        while lo < n:
            shard = int(node_shard[node])
            fits = min(n - lo, room[shard] - load[shard])
            if fits:
                pieces.append((cell, lo, lo + fits, shard, load[shard]))
                load[shard] += fits
                lo += fits
            node = (node + 1) % len(node_cell)
    return pieces


def ring_shards(rows: DataFrame, keys: list[str], n_shards: int, *, vnodes: int = 128, cells: int = 16384, load_factor: float = 1.0) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard) to every row.

    A key's place on the ring is the hash of `keys`. The ring has `cells` cells, so what the driver
    sees and what is broadcast is bounded by cells and shards, whatever the number of rows. Equal rows
    are counted before the shuffle and expanded after it, by RUN copies at a time in as many tasks, so a hot key is one row in any one sort.
    Null keys have a place like any other; repeated rows get slots of their own; ties on the ring are broken by the columns' values;
    keys may be of any length; an empty table gives an empty result. All columns of `rows` must be groupable, and none be named
    shard or slot; pass the light ones.
    """
    spark, names = rows.sparkSession, rows.columns
    n, at, cell, rank, lo, hi, base, run = (unused(rows, c) for c in ("_n", "_at", "_cell", "_rank", "_lo", "_hi", "_base", "_run"))
    grouped = rows.groupBy(*names).agg(F.count("*").alias(n))
    place = F.xxhash64(*keys)
    bits = (cells - 1).bit_length()
    light = cut(grouped.withColumns({at: place, cell: F.shiftrightunsigned(place, 64 - bits).cast("int")}), "ring")
    counts = np.zeros(1 << bits, dtype=np.int64)
    for c, m in light.groupBy(cell).agg(F.sum(n)).collect():  # at most a row for each cell
        counts[c] = m
    pieces = spark.createDataFrame(deal(counts, n_shards, vnodes, load_factor), f"{cell} int, {lo} long, {hi} long, shard int, {base} long")
    before = W.partitionBy(cell).orderBy(at, *names).rowsBetween(W.unboundedPreceding, -1)
    ranked = light.withColumn(rank, F.coalesce(F.sum(n).over(before), F.lit(0)))
    last = F.col(rank) + F.col(n) - 1
    few = ranked.where(F.col(n) <= RUN).withColumn(rank, F.explode(F.sequence(F.col(rank), last)))
    many = ranked.where(F.col(n) > RUN).withColumn(hi, last).withColumn(run, F.explode(F.sequence(F.col(rank), last, F.lit(RUN).cast("long")))).repartition(cell, run)
    many = many.withColumn(rank, F.explode(F.sequence(F.col(run), F.least(F.col(run) + RUN - 1, F.col(hi))))).drop(hi, run)
    dealt = few.unionByName(many).join(F.broadcast(pieces), cell).where((F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
    return dealt.select(*names, "shard", (F.col(base) + F.col(rank) - F.col(lo)).alias("slot"))


def shard_documents(spark: SparkSession, sf_dir: str, n_shards: int = 24, **ring) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return ring_shards(rows, ["doc_id"], n_shards, **ring).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op1_ring_shards": shard_documents}
