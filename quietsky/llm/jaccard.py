"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietsky.llm.common import apart, cut, table, tidied

SKETCH_BITS = 21
CHUNK = 1 << 14
MOST_MATCHES = 4
#: Words of 64 bits in the parity bitmap of a set.
PARITY = 4
#: Words whose hashes a task keeps.
MOST_WORDS = 100_000
#: Pairs that meet one copy of a set.
PAIRS_A_SET = 1000
#: Rows of a bucket's length class that one row of another component is compared to in a task.
ROWS_A_PART = 256
_BITS = tuple(f"bits{j}" for j in range(PARITY))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int, words: _Words) -> np.ndarray:
    """Hashes of the distinct shingles, ascending. With fewer words than width the sequence is one; without words, none."""
    found = (text or b"").lower().split()  # of bytes: A-Z alone change, and only space and the controls from tab to carriage return part words
    if not found:
        return np.zeros(0, dtype=np.uint64)
    a = np.array(list(map(words.__getitem__, found)), dtype=np.uint64)
    take = min(width, len(a))
    s = np.full(len(a) - take + 1, take, dtype=np.uint64)
    for j in range(take):
        s = s * _MIX[0] + a[j : len(a) - take + 1 + j]
    return np.unique(_mixed(s))


def _name(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh128_digest(s.tobytes(), seed=len(s))


def _parity(s: np.ndarray) -> bytes:
    """A bitmap with one bit flipped for each shingle. The ones in the xor of two sets' never exceed what one set has and the other lacks."""
    bit = (s >> np.uint64(8)) & np.uint64(64 * PARITY - 1)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=64 * PARITY) & 1).tobytes()


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_levels(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A level for each slot of a sketch over all documents' shingles, and the documents that each level stands for.

    Each task counts its documents into 2**SKETCH_BITS slots and sends them as chunks; sums by chunk go to the driver: a fixed
    size. What a slot holds beyond the noise of the mean is taken for a frequent shingle's. Levels only order
    shingles, so an error costs time, never a link.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, slots = _Words(), np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(_slots(shingles(text, width, words)))
                size += len(held[-1])
                if size > 1 << 20:
                    slots += np.bincount(np.concatenate(held), minlength=len(slots))
                    held, size = [], 0
            if held:
                slots += np.bincount(np.concatenate(held), minlength=len(slots))
        small = np.minimum(slots, 65535).astype("<u2")
        chunks = [small[a : a + CHUNK].tobytes() for a in range(0, len(small), CHUNK)]
        if small.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "counts"])

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, dtype=np.int64)
        for batch in rows:
            for c in batch.column(1).to_pylist():
                total += np.frombuffer(c, dtype="<u2")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])

    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    sums = docs.select("text").mapInArrow(tidied(count), "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    for r in sums.collect():  # a fixed number of chunks
        sketch[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], dtype=np.int64)
    mean = float(np.median(sketch))
    excess = np.maximum(sketch - mean - 3 * np.sqrt(mean) - 1, 0)
    levels = np.where(excess > 0, 1 + np.floor(2 * np.log2(1 + excess)), 0).astype(np.uint8)
    return levels, np.append(1.0, 2.0 ** (np.arange(1, 256) / 2))


def prefixes(docs: DataFrame, width: int, percent: int, levels: np.ndarray, stands: np.ndarray) -> DataFrame:
    """doc_id, n, name (digest of the set), matches, parity and tokens: the prefix of the document's shingles, rarest level first.

    With m required matches the prefix holds n - ceil(percent * n / 100) + m shingles, and two documents that link
    share m of them. m is the number, up to MOST_MATCHES, for which the estimated candidates are fewest.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((levels, stands))  # 2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, stands = shared.value
        words = _Words()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a in range(0, len(texts), 1000):
                n, name, parity, matches, size, tokens = [], [], [], [], [], []
                for text in texts[a : a + 1000]:
                    s = shingles(text, width, words)
                    n.append(len(s))
                    name.append(_name(s))
                    parity.append(_parity(s))
                    if not len(s):
                        matches.append(1)
                        size.append(0)
                        continue
                    level = levels[_slots(s)]
                    order = np.argsort(level, kind="stable")
                    least = -(-percent * len(s) // 100)
                    first = len(s) - least
                    most = min(MOST_MATCHES, least)
                    cost = np.cumsum(stands[level[order[: first + most]]])[first:]
                    m = 1 if cost[0] <= 2 * (first + 1) else 1 + int(np.argmin(cost / 4.0 ** np.arange(most)))
                    matches.append(m)
                    size.append(first + m)
                    tokens.append(s[order[: first + m]])
                flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, dtype=np.int64)
                offsets = pa.array(np.append(0, np.cumsum(size)), pa.int32())
                bits = np.frombuffer(b"".join(parity), dtype=np.int64).reshape(-1, PARITY)
                cols = [batch.column(0).slice(a, 1000), pa.array(n, pa.int32()), pa.array(name, pa.binary()), pa.array(matches, pa.int32()), *(pa.array(bits[:, j]) for j in range(PARITY)), pa.ListArray.from_arrays(offsets, pa.array(flat))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "name", "matches", *_BITS, "tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id long, n int, name binary, matches int, {', '.join(f'{b} long' for b in _BITS)}, tokens array<long>")


def _prefix(n: Column, matches: Column, percent: int) -> Column:
    """Shingles in a prefix."""
    return n - F.floor((percent * n + 99) / 100) + matches


def _overlap(na: Column, nb: Column, percent: int) -> Column:
    """The least number of shingles that two sets which link share."""
    return F.floor((percent * (na + nb) + (100 + percent) - 1) / (100 + percent))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Filters on one shared token at place i of n in each: by length, prefix, position, and by what each shares with any other.

    A pair's m-th shared token has at most m - 1 before it, so all pass of the first m of a pair that links. Of a document's
    prefix `lone` shingles are in nobody else's prefix, `before` of them rarer than the shared token. Those before it are not in
    the partner, whose prefix reaches the token too; all lone ones are not if its own prefix ends first, as one of the two does.
    """
    na, nb, ia, ib = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}i", f"{b}i"))
    m = F.least(f"{a}matches", f"{b}matches")
    overlap = _overlap(na, nb, percent)
    return (
        (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
        & (ia < _prefix(na, m, percent))
        & (ib < _prefix(nb, m, percent))
        & (F.least(na - ia, nb - ib) >= overlap - m + 1)
        & (F.least(na - F.col(f"{a}before"), nb - F.col(f"{b}before")) >= overlap)
        & (F.greatest(na - F.col(f"{a}lone"), nb - F.col(f"{b}lone")) >= overlap)
    )


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether the parity bitmaps differ in no more bits than sets that link differ in shingles."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    return sum((F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in _BITS), F.lit(0)) <= na + nb - 2 * _overlap(na, nb, percent)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component of edges(a, b). Labels pass along edges and then to their own label's, until none changes."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted(name, doc_id, and others) with tokens, the shingles of the set of that name. A bitmap picks the documents to read, so texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                sets = [shingles(t, width, words) for t in batch.column(0).slice(a, 500).cast(pa.binary()).to_pylist()]
                offsets = pa.array(np.append(0, np.cumsum([len(s) for s in sets])), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(map(_name, sets), pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], names=["name", "tokens"])

    may, _ = apart(docs.where("doc_id is not null").select("doc_id", "text"), F.xxhash64("doc_id"), wanted.select(F.xxhash64("doc_id").alias("h")).distinct())
    read = may.select("text").mapInArrow(tidied(run), "name binary, tokens array<long>").dropDuplicates(["name"])
    return read.join(wanted.drop("doc_id"), "name")


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs(a, b) whose sets link, by their exact intersection.

    Of a pair the set in fewer pairs travels to the other one, which is there once for each PAIRS_A_SET of its pairs.
    """
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    of = lambda end: degrees.select(F.col("node").alias(end), F.col("degree").alias(f"{end}_in"))
    turned = pairs.join(of("a"), "a").join(of("b"), "b")
    less = F.col("a_in") <= F.col("b_in")
    turned = turned.select(F.when(less, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("hub"), F.greatest("a_in", "b_in").alias("pairs"))
    turned = cut(turned.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("pairs") / PAIRS_A_SET).cast("long"))).drop("pairs"), "turned")
    hubs = turned.select(F.col("hub").alias("node"), "hub", "part").distinct()
    places = turned.withColumn("own", F.lit(True)).unionByName(hubs.withColumn("own", F.lit(False)))
    wanted = cut(places.join(nodes.select("node", "name", "doc_id"), "node"), "wanted")
    sets = cut(_sets(docs, wanted, width), "sets")
    met = sets.where("own").select("hub", "part", "node", F.col("tokens").alias("x")).join(sets.where("not own").select("hub", "part", F.col("tokens").alias("y")), ["hub", "part"])
    same = F.size(F.array_intersect("x", "y"))
    return met.where(100 * same >= percent * (F.size("x") + F.size("y") - same)).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def near_components(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their distinct word shingles; a component's id is its
    smallest doc_id. Null and empty texts have no shingles and link with nothing, nor do rows with a null doc_id, whose
    component_id is null; repeated rows are returned each; an empty table gives none. Shingles are held as 64-bit hashes, sets
    are named by 128 bits. Other columns of docs are not read, whatever their names. A text of any length is one set.

    Equal sets are one node from the start, however many documents hold them. Prefix tokens meet in buckets.
    First each bucket's rows are compared to one of them only, that with the fewest rarer shingles; a large group of near
    copies is mostly one component then, and its pairs are not needed. What lies in other components than most of its
    bucket is then joined with the neighbouring length classes of the bucket, under the length, position, parity and
    multi-match filters, and verified. A large class of a bucket is dealt to parts by node, and what meets it goes to all of them, so a token that
    very many sets hold is many tasks; joins by token alone have one row on their other side, so Spark splits them where they are skewed.
    So no bucket's pairs are all made, and no link between components is lost.
    """
    levels, stands = frequency_levels(docs, width)
    held = cut(prefixes(docs, width, percent, levels, stands), "prefixes")
    nodes = held.where("n > 0 and doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "matches", *_BITS, "tokens")])
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # read back, so the numbers stay
    rows = nodes.select("node", F.posexplode("tokens").alias("i", "token"))
    met = rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    # a node has at most its prefix of rows
    held_in = rows.join(met, "token").join(nodes.select("node", "n", "matches"), "node")
    lone = _prefix(F.col("n"), F.col("matches"), percent) - F.count("*").over(W.partitionBy("node"))
    before = F.col("i") + 1 - F.row_number().over(W.partitionBy("node").orderBy("i"))
    shared = cut(held_in.withColumns({"lone": lone.cast("int"), "before": before}), "shared")
    own = ("node", "n", "i", "matches", "lone", "before")
    hubs = shared.groupBy("token").agg(F.min(F.struct("before", *[c for c in own if c != "before"])).alias("hub"))
    stars = shared.join(hubs.select("token", *[F.col(f"hub.{c}").alias(f"h_{c}") for c in own]), "token")
    stars = stars.where((F.col("node") != F.col("h_node")) & _may_link("", "h_", percent))
    stars = stars.select(F.least("node", "h_node").alias("a"), F.greatest("node", "h_node").alias("b")).distinct()
    for end in ("a", "b"):
        stars = stars.join(nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}{c}") for c in ("n", *_BITS)]), end)
    stars = cut(stars.where(_alike("a", "b", percent)).select("a", "b"), "stars")
    links = cut(_linked(docs, nodes, stars, width, percent), "links")
    labels = components(links)

    labelled = nodes.select("node", *_BITS).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = shared.join(labelled.select("node", "label"), "node").groupBy("token", "label").agg(F.count("*").alias("c"))
    sizes = by_label.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("labels"))
    marked = cut(shared.join(sizes.where("labels > 1").select("token", "most"), "token").join(labelled, "node"), "marked")
    own = (*own, *_BITS)
    # sets of two classes that are not neighbours are too unlike in length
    length = F.floor(F.log("n") / (np.log(100 / percent) * (1 + 1e-9))).cast("int") if percent < 100 else F.col("n")
    near = F.explode(F.sequence(length - 1, length + 1))
    classed = marked.withColumn("class", length)
    large = classed.groupBy("token", "class").agg(F.ceil(F.count("*") / ROWS_A_PART).cast("int").alias("parts")).where("parts > 1")
    large = cut(large, "large")
    dealt = classed.join(large, ["token", "class"], "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    minor = marked.where("label <> most").withColumn("class", near).join(large, ["token", "class"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    minor = minor.select("token", "class", "part", *[F.col(c).alias(f"l_{c}") for c in (*own, "label")])
    once = (F.col("label") == F.col("most")) | (F.col("l_node") < F.col("node"))
    fits = (F.col("l_label") != F.col("label")) & once & _may_link("l_", "", percent) & _alike("l_", "", percent)
    met = minor.join(dealt, ["token", "class", "part"]).where(fits)
    need = F.least("l_matches", "matches")
    pairs = met.groupBy(F.least("l_node", "node").alias("a"), F.greatest("l_node", "node").alias("b"), need.alias("need")).agg(F.count("*").alias("c"))
    pairs = cut(pairs.where("c >= need").select("a", "b").join(stars, ["a", "b"], "left_anti"), "pairs")
    more = cut(_linked(docs, nodes, pairs, width, percent), "links")
    labels = components(links.unionByName(more))

    ids = nodes.select("node", "name", "doc_id")
    smallest = labels.join(ids, "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    reached = labels.join(smallest, "label").select("node", "component_id")
    own = ids.join(reached, "node", "left").select("name", F.coalesce("component_id", "doc_id").alias("component_id"))
    kept = held.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "name")
    linked = kept.where("n_shingles > 0 and doc_id is not null").join(own, "name").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(kept.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def jaccard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), width=4, percent=85)


QUERIES = {"op9_ngram_jaccard": jaccard_documents}

ORACLES = {
    "op9_ngram_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' '))) end s from w),
n as (select doc_id, len(s) n from s),
t as (select doc_id, unnest(s) t from s),
p as (select a.doc_id a, b.doc_id b, count(*) c from t a join t b on a.t = b.t and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
r as (select doc_id root, doc_id from n union select root, l.b from r join l on r.doc_id = l.a)
select n.doc_id, n.n::bigint n_shingles, m.component_id from n join (select doc_id, min(root) component_id from r group by doc_id) m using (doc_id)
""",
}
