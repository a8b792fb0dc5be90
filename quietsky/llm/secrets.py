"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsky.llm.common import apart, cut, table

#: Kinds in their order, each with its pattern, the group that holds the value, and the value's least length.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "live")
#: Words that may be credentials whatever stands before them.
WORDS = r"[A-Za-z0-9+/_=-]{24,}"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Matches of pattern as structs of start, kind, end (code points, end exclusive) and value.

    split() gives what lies between the matches, so offsets are running sums of lengths.
    """
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap"), hits.alias("hit"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))

    def step(so_far: Column, part: Column) -> Column:
        start = so_far["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(so_far["out"], one).alias("out"))

    empty = F.array().cast(SPAN)
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), F.filter(found, lambda s: F.length(s["value"]) >= least)).otherwise(empty)


def joined(s: Column) -> Column:
    """Spans as kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(s), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def live_looking(value: Column) -> Column:
    return (F.length(value) >= 20) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def ownership(candidates: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """One row for each hash: owners, repositories, and owned, true if so few hold it that it is no copied example.

    Counted in steps that each start with partial sums: a value that a third of all documents hold is a few rows.
    """
    places = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = places.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    by_hash = owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    return by_hash.withColumn("owned", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", owner: str = "source", max_owners: int = 2, max_repositories: int = 20) -> DataFrame:
    """One row for each row of docs(key, owner, text): key, owner, text_hash, base, live and examples.

    base: spans of assignments, access keys and long hex runs. All their values, and other long words with letters and
    digits, are candidates. Their hashes are counted over the whole corpus by distinct repositories (documents) and
    owners (sources). A candidate that more than max_owners owners or max_repositories documents hold is a copied
    example; the others become live spans. Base spans stay in either case.
    A null or empty text has no spans; a null owner is an owner, a null key a document; repeated rows are counted once
    as a repository, and each is returned; a document without candidates is returned with empty arrays. Only key, owner and
    text are read, whatever other columns docs has; spans with equal starts go by kind, then end. A text of any length is one row, with time linear
    in its length and quadratic in the number of its matches.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.concat(spans(text, ASSIGN, 2, 8, 0), spans(text, ACCESS, 0, 16, 1), spans(text, HEX, 0, 32, 2))
    light = docs.select(key, F.col(owner).alias("owner"), F.xxhash64("text").alias("text_hash"), base.alias("base"), spans(text, WORDS, 0, 24, 3).alias("words"))

    def candidate(s: Column) -> Column:
        return F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"))

    looks = F.concat("base", F.filter("words", lambda s: live_looking(s["value"])))
    light = light.withColumn("candidates", F.array_sort(F.array_distinct(F.transform(looks, candidate))))
    light = light.withColumn("base", F.transform("base", lambda s: s.dropFields("value"))).drop("words")
    light = cut(light, "secrets")
    own = [key, "owner", "text_hash", "base", "candidates"]
    rows = light.where(F.size("candidates") > 0).groupBy(*own).agg(F.count("*").alias("_n"))
    rows = cut(rows, "candidates")
    each = rows.withColumn("c", F.explode("candidates")).withColumn("hash", F.col("c.hash"))
    verdicts = ownership(each.withColumn("repository", F.col(key)), max_owners, max_repositories)
    # an owned hash is in few documents, so of a join on these none is hot; what is not owned is counted by subtraction
    owned = cut(verdicts.where("owned").select("hash"), "owned")
    span = F.struct(F.col("c.start").alias("start"), F.lit(3).alias("kind"), F.col("c.end").alias("end"))
    may, _ = apart(each.select(*own, "c", "hash"), F.xxhash64("hash"), owned.select(F.xxhash64("hash").alias("h")))
    live = may.join(owned, "hash").groupBy(*own).agg(F.array_sort(F.collect_list(span)).alias("live"))
    same = reduce(and_, [rows[c].eqNullSafe(live[c]) for c in own])
    judged = rows.join(live, same, "left").select(*[rows[c] for c in own], "_n", F.coalesce(live["live"], F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("live"))
    judged = judged.withColumn("examples", (F.size("candidates") - F.size("live")).cast("long"))
    judged = judged.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    out = [key, "owner", "text_hash", "base", "live", "examples"]
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rest = light.where(F.size("candidates") == 0).withColumns({"live": none, "examples": F.lit(0).cast("long")})
    return rest.select(out).unionByName(judged.select(out))


def redact(text: Column, live: Column, mark: str = "[SECRET]") -> Column:
    """The text with mark in place of each live span; spans that overlap have one mark."""

    def step(so_far: Column, s: Column) -> Column:
        more = F.concat(so_far["out"], F.substring(text, so_far["at"] + 1, s["start"] - so_far["at"]), F.lit(mark))
        return F.when(s["start"] < so_far["at"], F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), so_far["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), more.alias("out")))

    done = F.aggregate(live, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def of(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(of, range(3)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "live")).alias("spans"), F.size("live").cast("long").alias("n_live"), F.col("examples").alias("n_example"))


QUERIES = {"op4_secret_scan": scan_documents}


def _sql_spans(kind: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""select doc_id, source, t, {kind} kind, v[i] "value", st::int "start", (st + length(h[i]))::int "end" from (
      select *, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) st from (
        select *, unnest(generate_series(1, len(h))) i from (
          select doc_id, source, t, regexp_extract_all(t, '{p}') h, string_split_regex(t, '{p}') g, regexp_extract_all(t, '{p}', {group}) v from d) where len(h) > 0))
      where length(v[i]) >= {least}"""


ORACLES = {
    "op4_secret_scan": f"""
with d as (select doc_id, source, coalesce(text, '') t from documents),
b as ({_sql_spans(0, ASSIGN, 2, 8)} union all {_sql_spans(1, ACCESS, 0, 16)} union all {_sql_spans(2, HEX, 0, 32)}),
w as (select * from b union all {_sql_spans(3, WORDS, 0, 24)}),
c as (select distinct doc_id, source, "end" - length("value") "start", "end", sha256("value") hash from w
  where kind < 3 or (length("value") >= 20 and regexp_matches("value", '[0-9]') and regexp_matches("value", '[A-Za-z]'))),
o as (select hash, count(distinct coalesce(source, '')) + count(distinct case when source is null then 1 end) owners, count(distinct doc_id) repositories from c group by hash),
l as (select c.*, owners <= 2 and repositories <= 20 owned from c join o using (hash)),
n as (select unnest(['assign', 'access', 'hex', 'live']) name, unnest([0, 1, 2, 3]) kind),
s as (select doc_id, b.kind, "start", "end", name from b join n using (kind) union all select doc_id, 3, "start", "end", 'live' from l where owned),
j as (select doc_id, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex, count(*) filter (kind = 3) n_live,
  coalesce(string_agg(concat_ws(':', name, "start", "end"), ',' order by "start", kind) filter (kind < 3), '') base,
  coalesce(string_agg(concat_ws(':', name, "start", "end"), ',' order by "start", kind, "end"), '') spans from s group by doc_id),
e as (select doc_id, count(*) filter (not owned) n_example from l group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex, sha256(coalesce(base, '')) base_sha256,
  coalesce(spans, '') spans, coalesce(n_live, 0)::bigint n_live, coalesce(n_example, 0)::bigint n_example from d left join j using (doc_id) left join e using (doc_id)
""",
}
