"""A Merkle manifest of a dataset: a hash tree for each group of rows and one over all groups, reduced by superblocks of several levels."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsky.llm.common import cut, table

#: Children of a node, and levels that a superblock collapses: a task holds 16^3 nodes of a block.
FANOUT, LEVELS = 16, 3


def field(column: Column) -> Column:
    """A column as a leaf has it: `-` if null, else its number of UTF-8 bytes, `:`, and its value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The hash of a row."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def combined(hashes: list[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def folded(hashed: Column, left: Column, right: Column) -> Column:
    """The root that a hash has with the siblings left and right of it at each level."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), hashed, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]), 256))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `_rank`: gapless numbers from 0 in the order of these columns, null first, as a table in the shared folder.

    Rows are dealt by ranges and sorted within; a row's number is its place in its range after the sizes of the ranges before it, of
    which there are as many as shuffle partitions. Rows that are equal may lie in several ranges, as each row's own number is the last key.
    """
    own = cut(rows.withColumn("_own", F.monotonically_increasing_id()), "rows")
    keys = [*order, "_own"]
    dealt = cut(own.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftrightunsigned("_at", 33)
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy(part).count().collect())  # a row for each range
    begins, total = [], 0
    for p, n in sizes:
        begins.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(begins, "_part long, _begin long")
    at = F.col("_at").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_begin") + at).drop("_part", "_begin", "_at", "_own")


def depth(n: int, fanout: int) -> int:
    """Levels above n leaves, until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def block_levels(n: int, fanout: int, levels: int) -> int:
    """Levels that a superblock of a tree of n nodes collapses: all of the tree's if it is the only one."""
    return levels if n > fanout**levels else depth(n, fanout)


def collapsed(hashes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, hashes first; the last level has one."""
    every = [hashes]
    for _ in range(levels):
        below = every[-1]
        every.append([combined(below[a : a + fanout]) for a in range(0, len(below), fanout)])
    return every


def reduced(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Nodes (tree, idx, n: nodes of the tree at this level, hash) to the roots of their superblocks, in the same columns."""
    span = fanout**levels

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        n = int(block["n"].iloc[0])
        root = collapsed(block["hash"].tolist(), block_levels(n, fanout, levels), fanout)[-1][0]
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "idx": [int(block["idx"].iloc[0]) // span], "n": [-(-n // span)], "hash": [root]})

    return nodes.groupBy("tree", F.floor(F.col("idx") / span).alias("block")).applyInPandas(run, "tree long, idx long, n long, hash string")


def reductions(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every superblock level that has more than one for a tree, lowest first, and all trees' roots (tree, hash)."""
    each, roots = [nodes], None
    while True:
        above = cut(reduced(each[-1], fanout, levels), "nodes")
        done = above.where("n = 1").select("tree", "hash")
        roots = done if roots is None else roots.unionByName(done)
        more = above.where("n > 1")
        if more.isEmpty():
            return each, roots
        each.append(more)


PATH = "left array<string>, right array<string>"


def paths(nodes: DataFrame, above: DataFrame, fanout: int, levels: int, names: list[str], fields: str, digest: str | None = None, path: bool = True) -> DataFrame:
    """Joins each superblock's nodes with the path above it (tree, idx, left, right), which its nodes' own siblings precede.

    With digest, the name of a column of hashes to fold, also proof_sha256 and folded_root. Columns of nodes stay (names; fields: their schema).
    """
    span = fanout**levels
    block = F.floor(F.col("idx") / span)

    def run(own: pa.Table, upper: pa.Table) -> pa.Table:
        own = own.sort_by("idx").select(names)
        n = own.column("n")[0].as_py()
        every = collapsed(own.column("hash").to_pylist(), block_levels(n, fanout, levels), fanout)
        sides = []  # of each node of each level but the last, what stands left and right of it in its run
        for hashes in every[:-1]:
            runs = [hashes[a : a + fanout] for a in range(0, len(hashes), fanout)]
            sides.append([("".join(r[:i]), "".join(r[i + 1 :])) for r in runs for i in range(len(r))])
        top_left, top_right = upper.column("left")[0].as_py(), upper.column("right")[0].as_py()
        up = list(zip(top_left, top_right, strict=True))
        steps = lambda i: [*(s[i // fanout**k] for k, s in enumerate(sides)), *up]
        added: list[pa.Array] = []
        if path:
            for side in (0, 1):
                added.append(pa.array([[e[side] for e in steps(i)] for i in range(own.num_rows)], pa.list_(pa.string())))
        if digest is not None:
            proofs, roots = [], []
            for i, h in enumerate(own.column(digest).to_pylist()):
                each = steps(i)
                for a, b in each:
                    h = combined([a, h, b])
                proofs.append(combined([x for pair in each for x in pair]))
                roots.append(h)
            added += [pa.array(proofs, pa.string()), pa.array(roots, pa.string())]
        return pa.Table.from_arrays([*own.columns, *added], names=[*names, *["left", "right"] * path, *["proof_sha256", "folded_root"] * (digest is not None)])

    out = ", ".join([fields, *[PATH] * path, *["proof_sha256 string, folded_root string"] * (digest is not None)])
    return nodes.groupBy("tree", block.alias("block")).cogroup(above.groupBy("tree", F.col("idx").alias("block"))).applyInArrow(run, out)


def tree_paths(each: list[DataFrame], tops: DataFrame, fanout: int, levels: int, names: list[str], fields: str, digest: str | None, path: bool) -> DataFrame:
    """Paths of the lowest nodes, from the highest superblocks down; tops has the path above each tree's root (tree, left, right)."""
    place = ["tree", "idx", "left", "right"]
    tops = tops.withColumn("idx", F.lit(0).cast("long"))
    above = None
    for level in reversed(range(len(each))):
        nodes = each[level]
        ended = nodes.where((F.col("idx") == 0) & (F.col("n") <= fanout**levels)).select("tree")
        roots = tops.join(ended, "tree").select(place)
        uppers = roots if above is None else above.unionByName(roots)
        if level:
            above = cut(paths(nodes, uppers, fanout, levels, ["tree", "idx", "n", "hash"], "tree long, idx long, n long, hash string"), "paths").select(place)
    return paths(nodes, uppers, fanout, levels, names, fields, digest, path)


def manifest(rows: DataFrame, group: str, order: str, hashed: str, claimed: str | None = None, *, fanout: int = FANOUT, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """Adds to each row subroot, root, proof_sha256, folded_root and verified, which replace columns of these names; with proofs, also left and right, from which folded() finds the root.

    rows has a group (nodes of a group form one tree), an order within it, the row's hash, and, if named, the hash that the row is claimed to have, which is then the one that is
    folded along the proof. Nulls come first and are values like others, and a null hash counts as an empty one; rows of the same order go by hash, and repeated rows are leaves of their own. A group of one row has that row's hash as its subroot, one group its
    subroot as the root. An empty table gives none. Groups are cut into superblocks of fanout ^ levels leaves, so no task
    holds a group; roots of superblocks are reduced alike until each tree has one, and proofs are built from the top down and written nowhere but by superblock. Pass light columns: they go through two shuffles;
    they may have any name that does not begin with an underscore.
    """
    spark = rows.sparkSession
    results = ["subroot", "root", "proof_sha256", "folded_root", "verified", *["left", "right"] * proofs]
    kept = [c for c in rows.columns if c not in results]
    alias = {c: f"_k{i}" for i, c in enumerate(kept)}  # so that no name clashes within
    light = rows.select(*(F.col(f"`{c}`").alias(a) for c, a in alias.items()))
    g, o, h, w = alias[group], alias[order], alias[hashed], alias[claimed or hashed]
    leaves = ranked(light, g, o, h)
    groups = cut(leaves.groupBy(g).agg(F.min("_rank").alias("tree"), F.count("*").alias("n")), "groups")
    nodes = leaves.join(groups.withColumnRenamed(g, "_g"), F.col(g).eqNullSafe(F.col("_g"))).drop("_g")
    nodes = cut(nodes.withColumns({"idx": F.col("_rank") - F.col("tree"), "hash": F.coalesce(h, F.lit("")), "claim": F.coalesce(w, F.lit(""))}).drop("_rank"), "leaves")
    each, subroots = reductions(nodes.select("tree", "idx", "n", "hash"), fanout, levels)
    subroots = cut(subroots, "subroots")
    total = subroots.count()
    if not total:
        kinds = ["string"] * 4 + ["boolean"] + ["array<string>"] * 2
        return rows.select(*kept, *(F.lit(None).cast(k).alias(c) for c, k in zip(results, kinds, strict=False)))
    places = ranked(subroots.withColumnRenamed("tree", "group"), "group")
    top = cut(places.select(F.lit(0).cast("long").alias("tree"), F.col("_rank").alias("idx"), F.lit(total).cast("long").alias("n"), "hash", "group"), "top")
    upper, root = reductions(top.select("tree", "idx", "n", "hash"), fanout, levels)
    root = root.first()["hash"]
    none = spark.createDataFrame([(0, [], [])], f"tree long, {PATH}")
    tops = cut(tree_paths([top, *upper[1:]], none, fanout, levels, top.columns, "tree long, idx long, n long, hash string, group long", None, True), "tops").select(F.col("group").alias("tree"), "left", "right", F.col("hash").alias("subroot"))
    carried = nodes.select("tree", "idx", "n", "hash", "claim", *alias.values())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema)
    proved = tree_paths([carried, *each[1:]], tops.select("tree", "left", "right"), fanout, levels, carried.columns, fields, "claim", proofs)
    proved = proved.join(tops.select("tree", "subroot"), "tree")
    return proved.select(*(F.col(a).alias(c) for c, a in alias.items()), "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), *["left", "right"] * proofs)


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    own = leaf(*map(F.col, columns))
    leaves = docs.select("doc_id", "source", own.alias("leaf"), F.when(tampered, leaf(*map(F.col, columns[:-1]), lower)).otherwise(own).alias("claimed"))
    return manifest(leaves, "source", "doc_id", "leaf", "claimed").drop("claimed", "source")


ORACLE = """
with recursive crc_table as (
  select list(c order by n) as t from (
    select n, list_reduce(list_concat([n], range(8)), lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) as r(n)
  )
), docs as materialized (
  select doc_id, source, lang, n_chars, text,
    coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)), lambda a, b: xor(t[xor(a, b) % 256 + 1], a // 256)), 4294967295) % 5 = 0, false) as tampered,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered
  from documents, crc_table
), hashed as (
  select doc_id, source, tampered, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head, coalesce(strlen(text) || ':' || text, '-') as body, coalesce(strlen(lowered) || ':' || lowered, '-') as other
  from docs
), leaves as materialized (
  select doc_id, source, sha256(head || body) as leaf, sha256(head || case when tampered then other else body end) as claimed,
    dense_rank() over (order by source nulls first) as tree, row_number() over (partition by source order by doc_id nulls first, sha256(head || body)) - 1 as idx
  from hashed
), lower_nodes as (
  select tree, 0 as level, idx, leaf as h, count(*) over (partition by tree) as n from leaves
  union all
  (select tree, level + 1, idx // 16, sha256(string_agg(h, '' order by idx)), any_value((n + 15) // 16) from lower_nodes where n > 1 group by tree, level, idx // 16)
), top_leaves as materialized (
  select tree as own, h as subroot, level as height, row_number() over (order by tree) - 1 as idx from lower_nodes where n = 1
), upper_nodes as (
  select 0 as level, idx, subroot as h, count(*) over () as n from top_leaves
  union all
  (select level + 1, idx // 16, sha256(string_agg(h, '' order by idx)), any_value((n + 15) // 16) from upper_nodes where n > 1 group by level, idx // 16)
), runs as materialized (
  select tree, level, idx // 16 as run, list(h order by idx) as hs from lower_nodes where n > 1 group by tree, level, idx // 16
), upper_runs as materialized (
  select level, idx // 16 as run, list(h order by idx) as hs from upper_nodes where n > 1 group by level, idx // 16
), steps as (
  select l.tree, l.idx, r.level, r.hs, (l.idx // (16 ** r.level)::bigint) % 16 as place from leaves l join runs r on r.tree = l.tree and r.run = l.idx // (16 ** (r.level + 1))::bigint
  union all
  select l.tree, l.idx, t.height + u.level, u.hs, (t.idx // (16 ** u.level)::bigint) % 16 from leaves l join top_leaves t on t.own = l.tree join upper_runs u on u.run = t.idx // (16 ** (u.level + 1))::bigint
), sides as (
  select tree, idx, list({'a': array_to_string(hs[1:place], ''), 'b': array_to_string(hs[place + 2:], '')} order by level) as s from steps group by tree, idx
), proved as (
  select l.*, coalesce(list_reduce(list_concat([claimed], list_transform(s, lambda p: p.a || '.' || p.b)), lambda h, p: sha256(split_part(p, '.', 1) || h || split_part(p, '.', 2))), claimed) as folded_root,
    sha256(coalesce(array_to_string(list_transform(s, lambda p: p.a || p.b), ''), '')) as proof_sha256
  from leaves l left join sides using (tree, idx)
)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified
from proved join top_leaves on own = tree, (select h as root from upper_nodes where n = 1)
"""

QUERIES = {"op11_merkle_manifest": manifest_documents}
ORACLES = {"op11_merkle_manifest": ORACLE}
