"""Merkle manifests, centroid clusters and token counts: brute force, the tokenizer's library, and odd input."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quietsky.llm import centroids, merkle, transducer

SMALL = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


def rows(df):
    return Counter(map(tuple, df.collect()))


# Merkle manifests


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(hashes, fanout):
    every = [hashes]
    while len(every[-1]) > 1:
        every.append([sha(*every[-1][a : a + fanout]) for a in range(0, len(every[-1]), fanout)])
    return every


def plain_manifest(table, fanout):
    """table: (group, order, hash, claimed); one list of (group, order, hash, subroot, root, proof_sha256, folded_root)."""
    first = lambda v: (v is not None, v if not isinstance(v, str) else v.encode()) if v is not None else (False,)
    groups = {}
    for r in table:
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=first)
    trees = {g: levels_of([r[2] for r in sorted(groups[g], key=lambda r: (first(r[1]), r[2]))], fanout) for g in names}
    top = levels_of([trees[g][-1][0] for g in names], fanout)

    def siblings(every, i):
        for level in every[:-1]:
            a = i - i % fanout
            yield level[a:i], level[i + 1 : a + fanout]
            i //= fanout

    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(sorted(groups[g], key=lambda r: (first(r[1]), r[2]))):
            path = [*siblings(trees[g], i), *siblings(top, k)]
            h = r[3]
            for left, right in path:
                h = sha(*left, h, *right)
            out.append((g, r[1], r[2], trees[g][-1][0], top[-1][0], sha(*(x for left, right in path for x in left + right)), h))
    return out


@pytest.mark.parametrize(("sizes", "fanout", "levels"), [([70, 1, 9, 2], 2, 2), ([200, 3], 3, 1), ([30], 16, 3), ([1], 16, 3), ([1] * 40, 3, 2)])
def test_manifest_equals_brute_force(spark, sizes, fanout, levels):
    rng = random.Random(len(sizes))
    names = [None, "", "a", "é", "Z", *(f"g{i}" for i in range(40))]
    table = [(names[g], rng.choice([None, rng.randint(0, 5), i]), sha(f"{g}/{i % 50}")) for g, n in enumerate(sizes) for i in range(n)]
    table = [(*r, sha("x") if rng.random() < 0.2 else r[2]) for r in table]
    table += [table[-1]] * 2  # repeated rows
    df = spark.createDataFrame(table, "g string, o long, h string, c string").repartition(3)
    got = merkle.manifest(df, "g", "o", "h", "c", fanout=fanout, levels=levels, proofs=True)
    want = plain_manifest(sorted(table, key=str), fanout)
    assert rows(got.select("g", "o", "h", "subroot", "root", "folded_root", "proof_sha256").where("c = h")) == Counter((*r[:5], r[6], r[5]) for r in want if r[6] == r[4])
    assert got.where("verified != (c = h)").count() == 0
    assert got.where(merkle.folded(F.col("c"), F.col("left"), F.col("right")) != F.col("folded_root")).count() == 0
    assert got.where(F.sha2(F.concat_ws("", F.flatten(F.transform(F.arrays_zip("left", "right"), lambda p: F.array(p["left"], p["right"])))), 256) != F.col("proof_sha256")).count() == 0


def test_manifest_odd_input(spark):
    schema = "n long, hash string, tree long, idx string, root int, left map<int,int>"
    df = spark.createDataFrame([(1, None, 1, "x" * 100_000, 5, None), (None, "b", None, None, 6, {1: 2}), (1, "b", 1, "", None, None)], schema)
    got = merkle.manifest(df, "tree", "n", "hash")
    assert got.columns == ["n", "hash", "tree", "idx", "left", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.where("verified").count() == 3 and got.where("hash is null").count() == 1
    assert {r["subroot"] for r in got.where("tree is null").collect()} == {"b"}
    assert merkle.manifest(df.limit(0), "tree", "n", "hash", proofs=True).collect() == []


def test_leaf_of_nulls_and_lengths(spark):
    df = spark.createDataFrame([(1, None, "é"), (None, "", "a" * 5000)], "a long, b string, c string")
    assert [r[0] for r in df.select(merkle.leaf(F.col("a"), F.col("b"), F.col("c"))).collect()] == [sha("1:1-2:é"), sha("-0:5000:" + "a" * 5000)]


# centroid clusters


def plain_clusters(table, k=16, rounds=3):
    """table: (key, integers); (key, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    first = sorted(table, key=lambda r: (r[0] is None, sha(f"1:{r[0]}"), r[1]))[:k]
    c = [list(r[1]) for r in first]

    def assigned():
        for key, x in table:
            d = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in c]
            yield key, d.index(min(d)), min(d), x

    for _ in range(rounds):
        own = list(assigned())
        for i in range(len(c)):
            if some := [x for _, j, _, x in own if j == i]:
                c[i] = [sum(v) // len(some) for v in zip(*some, strict=True)]
    own = list(assigned())
    of = Counter()
    for _, j, d, _ in own:
        of[j] += d
    most = (1 << 63) - 1
    return Counter((key, j, min(most, d), min(most, of[j]), min(most, sum(of.values())), sha(",".join(map(str, c[j])))) for key, j, d, _ in own)


@pytest.mark.parametrize("large", [1.0, 2.0**21, 2.0**26, 1e15, 1e300])
def test_clusters_equal_brute_force(spark, large):
    rng = np.random.default_rng(int(np.log2(large)))
    x = rng.normal(size=(150, 5)) * np.where(rng.random((150, 1)) < 0.3, large, 1.0)
    x[40:60] = x[0]  # equal vectors, so ties
    x[60:70] = np.round(x[60:70], 1)
    keys = [None if i % 37 == 5 else i // 2 for i in range(150)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    got = centroids.cluster(df, dim=5)
    from fractions import Fraction

    whole = [tuple(int(Fraction(c) * 64 // 1) for c in v.tolist()) for v in x]
    assert Counter(tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == plain_clusters(list(zip(keys, whole, strict=True)))


def test_clusters_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0], 7), (2, [1.0, None], 7), (3, [nan, 1.0], 7), (4, [inf, 1.0], 7), (5, None, 7), (6, [1.0], 7), (None, [3.0, 2.0], 7), (1, [1.0, 2.0], 7)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, cluster int").withColumns({"block": F.lit("é"), "_c": F.lit(None).cast("string"), "rows": F.lit(2)})
    got = centroids.cluster(df, dim=2)
    assert got.columns == ["vec_id", "block", "_c", "rows", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(r["vec_id"] or 0 for r in got.collect()) == [0, 1, 1] and {r["distance"] for r in got.collect()} == {0}
    assert centroids.cluster(df.limit(0), dim=2).collect() == []
    assert centroids.cluster(df.withColumn("embedding", F.array(F.lit(1), F.lit(2))), dim=2).count() == 8


# token counts


@pytest.fixture(scope="module")
def tokenizer():
    return transducer.load()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


PARTS = ["a", "s", "t", "re", "ll", "ve", "'", "'s", "'re", "'ll", "'ve", "'m", " ", "  ", "\n", "\t", " ", "1", "23", "!", "?", "é", "漢", "\U0001f600", "R", "the", "ing", "<|endoftext|>", "<|end", "\x1c", "\x00", "aaaa", "==", "--"]


def test_counts_equal_the_library(tokenizer, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0, 0x7FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(200)) for _ in range(300)]
    texts += ["a" * 5000, "ab" * 3000, " " * 3000, "=" * 4000, "the" * 1000, "".join(rng.choice("abcdefghijklmnop") for _ in range(20_000))]
    assert tokenizer.counts(texts) == library(texts)


def test_every_character_has_the_librarys_class(tokenizer, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("a{0}a1{0}1!{0}!", "x {0}\n"):
        texts = ["".join(form.format(chr(c)) for c in points[a : a + 500]) for a in range(0, len(points), 500)]
        assert tokenizer.counts(texts) == library(texts)


def test_counts_by_short_stretches_and_few_states(tokenizer, library, monkeypatch):
    monkeypatch.setattr(transducer, "BATCH", 50)
    monkeypatch.setattr(transducer, "CHUNK", 7)
    monkeypatch.setattr(transducer, "MOST_STATES", 20)
    monkeypatch.setattr(transducer, "MOST_WORDS", 3)
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300))) for _ in range(150)] + ["b" * 400, " " * 500, "x" + " " * 120 + "y"]
    fresh = transducer.load()
    assert fresh.counts(texts) == library(texts)


def test_maps_compose_to_the_plain_run():
    rng = np.random.default_rng(3)
    symbols = np.concatenate([rng.integers(0, 12, 3000), np.full(1500, transducer.BLANK), rng.integers(0, 12, 77)]).astype(np.uint8)
    state, want = transducer.FRESH, []
    for c in symbols.tolist():
        state, marks = transducer.split_step(state, c)
        want.append(marks)
    assert transducer.marked(symbols).tolist() == want


def test_counts_of_odd_rows(spark, tokenizer, library):
    data = [(1, None, 1), (2, "", 1), (2, "", 1), (None, "word " * 30_000, 1), (3, "<|endoftext|>", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_tokens int")
    got = transducer.count_tokens(df, tokenizer)
    assert got.columns == ["doc_id", "text", "n_tokens", "n_bytes", "over_limit"]
    assert rows(got.select("doc_id", "n_bytes", "n_tokens", "over_limit")) == Counter([(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (None, 150_000, 30_001, True), (3, 13, 1, False)])
    assert transducer.count_tokens(df.limit(0), tokenizer).collect() == []
    bad = spark.sql("select cast(x'61ff62' as string) as text")
    assert transducer.count_tokens(bad, tokenizer).first()["n_tokens"] == library(["a�b"])[0]


@has_data
def test_document_counts_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = Counter((d["doc_id"], len((d["text"] or "").encode()), n, n > 512) for d, n in zip(docs, library([d["text"] or "" for d in docs]), strict=True))
    assert rows(transducer.count_documents(spark, SMALL)) == want


def test_other_tokenizers_raise(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        transducer.load(public_tokenizers.path("word_bpe_49k.json"))
