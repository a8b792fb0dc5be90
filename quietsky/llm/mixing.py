"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietsky.llm.common import cut, table, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds target (double) to a table of one row for each source: source, source_size.

    Sources by code point, null last, weigh `weights`, repeating. A target stops at max_repeat times its
    source's size; the excess is shared by weight among the rest. In the order of cap over weight the capped
    sources come first, so the level at which the rest stand is a running sum away, without iteration.
    """
    w = F.element_at(F.array(*[F.lit(x).cast("double") for x in weights]), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("_w", w).withColumn("_cap", (max_repeat * F.col("source_size")).cast("double"))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_w").over(
        order.rowsBetween(0, W.unboundedFollowing)
    )
    found = ranked.withColumn("_level", level).withColumn("_level", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(everything))
    return found.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def copies(strata: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Expected copies of each stratum of a source, of sum words: proportional to its affinity, at most max_repeat, and the target in all."""
    own = W.partitionBy("source")
    order = own.orderBy(F.col("affinity").desc())
    spare = F.col("target") - F.coalesce(F.sum(max_repeat * F.col("words")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = F.try_divide(spare, F.sum(F.col("affinity") * F.col("words")).over(order.rowsBetween(0, W.unboundedFollowing)))
    found = strata.withColumn("_level", level).withColumn("_level", F.max(F.when(F.col("_level") * F.col("affinity") <= max_repeat, F.col("_level"))).over(own))
    expected = F.greatest(F.lit(0.0), F.least(F.lit(float(max_repeat)), F.coalesce(F.col("_level") * F.col("affinity"), F.lit(float(max_repeat)))))
    full = found.withColumn("expected", expected)
    rest = F.col("target") - F.sum(F.floor("expected") * F.col("words")).over(own)
    return full.withColumn("rest", rest).select("source", "source_size", "target", "affinity", F.floor("expected").alias("certain"), (F.col("expected") - F.floor("expected")).alias("odds"), "rest")


def affinity(size: Column) -> Column:
    """By the bits of the number of words: a document of 2**b words gets 1 + b / 8, so longer ones are likelier, mildly."""
    return 1 + F.length(F.bin(size)) / 8


def pareto_order(key: Column, odds: Column, seed: str = "mix") -> Column:
    """Logarithm of a document's random odds over its inclusion odds; the smallest are taken."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    u = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.ln(u) - F.ln(1 - u) - (F.ln(odds) - F.ln(1 - odds))


def _below(rows: DataFrame, bins: Column, inside: list[str]) -> DataFrame:
    """Splits rows of a source by bins of their order: side -1 below the bin where the source's rest ends, 0 in it, 1 above; rest then counts from the bin."""
    binned = rows.withColumn("_bin", bins)
    sums = binned.groupBy("source", *inside, "_bin").agg(F.sum("size").alias("_words"), F.first("rest").alias("_rest"))
    order = W.partitionBy("source", *inside).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("_to", F.sum("_words").over(order))
    side = F.when(F.col("_to") <= F.col("_rest"), -1).when(F.col("_to") - F.col("_words") <= F.col("_rest"), 0).otherwise(1)
    sides = sums.select(F.col("source").alias("_s"), F.col("_bin").alias("_b"), side.alias("side"), (F.col("_rest") - F.col("_to") + F.col("_words")).alias("_left"))
    return binned.join(sides, (F.col("source").eqNullSafe(F.col("_s"))) & (F.col("_bin") == F.col("_b"))).drop("_s", "_b", "_bin", "rest").withColumnRenamed("_left", "rest")


def mix(docs: DataFrame, *, key: str = "doc_id", weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """How often the mix takes each row of docs(key, source, size): adds source_size, target, copies and taken.

    Every document has expected copies, equal to its affinity times its source's level. The whole part is certain.
    The rest is a Pareto order sample: documents rank by random odds over inclusion odds, and those before the point
    where the source's words are used up get one copy more, so a source ends within half a document of its target.
    Ranks are cut by two histograms of that order (bounded bins for each source), and only the bin that holds the
    cut is sorted: no task gets a whole source. Null sources are one source, the last; null or repeated keys
    share their random number and are told apart by size, and of rows that are alike in all three some may be taken and others not; empty
    documents take nothing; an empty table gives none. Only key, source and size are read, whatever other columns docs has; how long a text is
    matters by its size alone.
    """
    docs = cut(docs.select(key, "source", "size"), "mix-docs").withColumn("affinity", affinity(F.col("size")))
    strata = docs.groupBy("source", "affinity").agg(F.sum("size").alias("words"))
    per_source = targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeat)
    plan = copies(strata.join(per_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), max_repeat)
    plan = plan.withColumnsRenamed({"source": "_s", "affinity": "_a"})
    rows = docs.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("affinity") == F.col("_a"))).drop("_s", "_a", "affinity")
    chancy = (F.col("odds") > 0) & (F.col("size") > 0)
    rows = cut(rows.withColumn("_order", F.when(chancy, pareto_order(F.col(key), F.col("odds"), seed))), "mix-rows")
    whole = rows.where("_order is null").withColumn("more", F.lit(0))
    out = [key, "source", "size", "source_size", "target", "certain", "more"]
    coarse = _below(rows.where("_order is not null"), F.floor(F.col("_order") * 16), [])
    coarse = cut(coarse.withColumn("_coarse", F.floor(F.col("_order") * 16)), "mix-coarse")
    done = coarse.where("side <> 0").withColumn("more", F.when(F.col("side") < 0, 1).otherwise(0))
    fine = _below(coarse.where("side = 0").drop("side"), F.floor(F.col("_order") * 4096), ["_coarse"])
    order = W.partitionBy("source").orderBy("_order", F.col(key).asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    edge = fine.where("side = 0").withColumn("more", F.when(F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0))
    fine_done = fine.where("side <> 0").withColumn("more", F.when(F.col("side") < 0, 1).otherwise(0))
    every = whole.select(out).unionByName(done.select(out)).unionByName(fine_done.select(out)).unionByName(edge.select(out))
    n = (F.col("certain") + F.col("more")).cast("long")
    return every.select(key, "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op3_mix_sources": mix_documents}

ORACLES = {
    "op3_mix_sources": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
a as (select *, 1 + length(bin(size)) / 8 affinity from d),
s as (select source, sum(size)::bigint source_size from d group by source),
s1 as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] w, 3.0::double * source_size cap from s),
s2 as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) lv from s1),
s3 as (select *, max(case when lv * w <= cap then lv end) over () l from s2),
t as (select source, source_size, least(cap, coalesce(l * w, cap)) target from s3),
b as (select source, affinity, sum(size)::bigint words from a group by all),
b1 as (select b.source, b.affinity, words, source_size, target from b join t on b.source is not distinct from t.source),
b2 as (select *, (target - coalesce(sum(3 * words) over (partition by source order by affinity desc rows between unbounded preceding and 1 preceding), 0)::double)
  / nullif(sum(affinity * words) over (partition by source order by affinity desc rows between current row and unbounded following), 0) lv from b1),
b3 as (select *, max(case when lv * affinity <= 3 then lv end) over (partition by source) l from b2),
b4 as (select *, greatest(0.0, least(3.0, coalesce(l * affinity, 3.0))) e from b3),
p as (select source, affinity, source_size, target, floor(e)::bigint certain, e - floor(e) odds, target - sum(floor(e) * words) over (partition by source) rest from b4),
u as (select a.doc_id, a.source, a.size, source_size, target, certain, odds, rest,
  ((('0x' || substr(md5('mix:' || coalesce(a.doc_id::varchar, '')), 1, 13))::bigint) + 0.5::double) / 4503599627370496.0::double u
  from a join p on a.source is not distinct from p.source and a.affinity = p.affinity),
q as (select *, case when odds > 0 and size > 0 then ln(u) - ln(1 - u) - (ln(odds) - ln(1 - odds)) end o from u),
c as (select *, case when o is not null and coalesce(sum(case when o is not null then size end) over (partition by source order by o nulls last, doc_id nulls last, size rows between unbounded preceding and 1 preceding), 0)
  + size / 2 <= rest then 1 else 0 end more from q)
select doc_id, size, source_size, target, ((certain + more) * size)::bigint taken, source, (certain + more)::bigint copies from c
""",
}
