"""A corpus pipeline: language, near duplicates, secrets, mixing, tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps. All but the last return
the columns of docs. run() writes what each stage returns and reads it again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from quietsky.llm import jaccard, language, mixing, secrets, sentence
from quietsky.llm.common import apart, cut, setting, shared_dir, table, unused, word_count

#: An ambiguous decision with a score below this is a rejection.
LEAST_SCORE = 0.5
#: Rows that Python workers are given at once, and bytes of text in a block of the encoding: stages follow one another in the same executors, whose heaps have grown by then.
ROWS_A_BATCH, BLOCK_BYTES = 1000, 8 << 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: those with no letters, and those between codewords. The model is learned from docs.

    Null and empty texts have no letters, so their rows go; repeated rows are judged alike, texts of any length whole; an empty table stays empty, other columns stay.
    """
    found = language.language_of(F.col("text"), language.learned(docs), spark)
    return docs.where((found["lang_pred"] != language.UNKNOWN) & ~(found["ambiguous"] & (found["score"] < LEAST_SCORE)))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group linked by five-word shingles at 0.8.

    Rows with the same doc_id and text, by a 64-bit hash, are one, of which one row stays; rows that share a doc_id but not
    the text are linked, or not, by their texts. Rows with a null doc_id stay. Only rows that may have to go are shuffled.
    """
    k = unused(docs, "_k")
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_A_BATCH):
        groups = cut(jaccard.near_components(docs.select(key.alias("doc_id"), "text"), width=5, percent=80), "groups")
    nodes = groups.where("doc_id is not null").groupBy(F.col("doc_id").alias("k"), "component_id").agg(F.count("*").alias("n"))
    named = nodes.join(docs.select(key.alias("k"), "doc_id").where("k is not null").distinct(), "k")
    kept = cut(named.groupBy("component_id").agg(F.min(F.struct("doc_id", "k", "n")).alias("kept")).select("kept.k", "kept.n"), "kept")
    again = kept.where("n > 1").select(F.col("k").alias(k))
    touched = cut(nodes.select(F.col("k").alias(k)).distinct().join(kept.select(F.col("k").alias(k)), k, "left_anti").union(again), "touched")
    may, once = apart(docs, key, touched)
    may = may.withColumn(k, key)
    ordered = F.struct(*[f.name for f in docs.schema if not isinstance(f.dataType, MapType | VariantType)])
    first = may.join(again, k, "left_semi").groupBy(k).agg(F.min_by(F.struct(*docs.columns), ordered).alias("row")).select("row.*")
    return once.unionByName(may.join(touched, k, "left_anti").drop(k)).unionByName(first)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each live credential; copied examples and everything else stay, and every document does.

    Null and empty texts have none; a null doc_id or source is a document or an owner like any other; repeated rows count once as a document and are all marked;
    a text of any length is marked whole; an empty table stays empty, other columns stay as they are but n_chars, which follows the text.
    """
    d, o, h, live = (unused(docs, c) for c in ("_d", "_o", "_h", "_live"))
    found = secrets.scan_secrets(docs.select("doc_id", "source", "text")).where(F.size("live") > 0)
    found = cut(found.select(F.col("doc_id").alias(d), F.col("owner").alias(o), F.col("text_hash").alias(h), F.col("live").alias(live)).distinct(), "live")
    may, clean = apart(docs, F.xxhash64("text"), found.select(h))
    same = may["doc_id"].eqNullSafe(found[d]) & may["source"].eqNullSafe(found[o]) & (F.xxhash64(may["text"]) == found[h])
    marked = may.join(found, same, "left").withColumn("text", F.when(F.col(live).isNotNull(), secrets.redact(F.col("text"), F.col(live))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.when(F.col(live).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.unionByName(marked.select(docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times.

    Rows that share doc_id, source and number of words share their copies evenly; what is left over goes to the first of them by hash of the text.
    Null and empty texts have no words and are not taken; null ids and sources are values like others; an empty table stays empty; other columns stay.
    """
    d, o, s, copies, rows, number = (unused(docs, c) for c in ("_d", "_o", "_s", "_copies", "_rows", "_number"))
    size = word_count(F.col("text"))
    taken = mixing.mix(docs.select("doc_id", "source", size.alias("size"))).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    taken = taken.where(F.col(copies) > 0).withColumnsRenamed({"doc_id": d, "source": o, "size": s})
    taken = cut(taken, "taken")

    def of(some: DataFrame) -> DataFrame:
        return docs.join(some, docs["doc_id"].eqNullSafe(some[d]) & docs["source"].eqNullSafe(some[o]) & (size == some[s]))

    left = F.col(copies) % F.col(rows)
    whole = of(taken.where(left == 0)).withColumn(number, F.lit(1))
    shared = of(taken.where(left > 0)).withColumn(number, F.row_number().over(W.partitionBy(d, o, s).orderBy(F.xxhash64("text"))))
    each = whole.unionByName(shared).withColumn(copies, F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(number) <= left, 1).otherwise(0))
    return each.where(F.col(copies) > 0).withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (packed), n_tokens and roundtrip of each row: repeated rows each, null and empty texts without ids, texts of any length whole; an empty table gives none."""
    return sentence.encode(docs, sentence.load(), block_bytes=BLOCK_BYTES, packed=True)


STAGES = [
    ("language identification", known_language),
    ("n-gram jaccard join", one_of_near_copies),
    ("secret scan", without_secrets),
    ("mixing to target weights", mixed),
    ("sentencepiece encoding", tokens),
]

#: No SQL has the learned language model, or the vocabulary's best paths.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
