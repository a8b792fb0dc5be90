"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsky.llm.common import give_back, table, tidied

BITS = 12
#: Documents of each language that are learned from, about; a language's are chosen by hash of doc_id.
PER_LANGUAGE = 800
#: And of all languages.
MOST = 16_000
#: A decision whose loss is not this much below the next one's, for each bit, is ambiguous.
MARGIN = 0.15
UNKNOWN = "und"
#: Bytes of text whose n-grams are counted at once.
PIECE = 1 << 20
#: Lengths of n-grams, each with a multiplier for its hash.
GRAMS = ((2, 0x9E3779B1), (3, 0x85EBCA77))


def _slots(b: np.ndarray, n: int, salt: int) -> np.ndarray:
    """The slot of the n bytes from each place of b on."""
    code = b[: len(b) - n + 1].astype(np.uint32)
    for j in range(1, n):
        code = (code << np.uint32(8)) | b[j : len(b) - n + 1 + j]
    return ((code + np.uint32(1)) * np.uint32(salt)) >> np.uint32(32 - BITS)


def counts(texts: list[str | None]) -> np.ndarray:
    """Hashed counts of the byte bigrams and trigrams of each whole text, in lower case.

    Short texts are joined, and a long one is counted piece by piece, so memory holds the n-grams of a piece at a time.
    """
    raw = [(t or "").lower().encode() for t in texts]
    width = 1 << BITS
    out = np.zeros((len(raw), width), dtype=np.float32)
    begin = 0
    while begin < len(raw):
        end, total = begin, 0
        while end < len(raw) and (end == begin or total + len(raw[end]) < PIECE) and end - begin < 256:
            total += len(raw[end])
            end += 1
        if end == begin + 1:
            for n, salt in GRAMS:
                for a in range(0, total - n + 1, PIECE):
                    b = np.frombuffer(raw[begin], dtype=np.uint8, count=min(PIECE + n - 1, total - a), offset=a)
                    out[begin] += np.bincount(_slots(b, n, salt), minlength=width)
        else:
            b = np.frombuffer(b"".join(raw[begin:end]), dtype=np.uint8)
            doc = np.repeat(np.arange(end - begin), [len(r) for r in raw[begin:end]])
            slots = [(doc[: len(b) - n + 1] * width + _slots(b, n, salt))[doc[: len(b) - n + 1] == doc[n - 1 :]] for n, salt in GRAMS if len(b) >= n]
            if slots:
                out[begin:end] = np.bincount(np.concatenate(slots), minlength=(end - begin) * width).reshape(end - begin, width)
        begin = end
    return out


def features(c: np.ndarray) -> np.ndarray:
    x = np.sqrt(c)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)
    return x


def codewords(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of n languages: all dichotomies for few, else the best of seeded random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        return np.array([[1 if c == 0 or not (b >> (c - 1)) & 1 else -1 for b in range(1, 1 << (n - 1))] for c in range(n)], dtype=float)
    rng, length = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice([-1.0, 1.0], size=(n, length)) for _ in range(100)]
    return max(tries, key=lambda m: (np.abs(m.sum(axis=0)).max() < n, min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))))


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 120, ridge: float = 1e-5) -> np.ndarray:
    """Weights of one logistic classifier for each bit, the last row its bias, by accelerated gradient steps; x has 32-bit floats and ends in a column of ones."""
    target = ((code[y] + 1) / 2).astype(np.float32)
    weight = (1 / np.bincount(y, minlength=len(code))[y] / len(code)).astype(np.float32)[:, None]
    w = ahead = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32)
    for step in range(steps):
        p = 1 / (1 + np.exp(-(x @ ahead)))
        new = ahead - 2.0 * (x.T @ (weight * (p - target)) + ridge * ahead)
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return w


def decide(x: np.ndarray, w: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The language whose codeword has the least summed logistic loss, its share, and whether the next is about as near."""
    if code.shape[1] == 0:
        return np.zeros(len(x), dtype=int), np.ones(len(x)), np.zeros(len(x), dtype=bool)
    f = (x @ w[:-1] + w[-1]).astype(np.float64)
    loss = np.logaddexp(0, -f[:, None, :] * code[None, :, :]).sum(axis=2)
    best = loss.argmin(axis=1)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    nearest = np.sort(loss, axis=1)
    return best, 1 / share.sum(axis=1), (nearest[:, 1] - nearest[:, 0]) < MARGIN * code.shape[1]


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, codewords and weights, from labelled(doc_id, text, lang).

    Learns from about per_language documents of each language, and fewer of each where all would be over `most`, chosen by
    hash; their n-gram counts are made in tasks, and the fit, on that bounded sample, on the driver.
    """
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    code = codewords(len(langs))
    if code.shape[1] == 0:
        return langs, code, np.zeros(((1 << BITS) + 1, 0), dtype=np.float32)
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, min(per_language, most / len(langs)) / sizes[k]))])
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(uniform < F.element_at(share, F.col("lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = np.minimum(counts(batch.column(1).slice(a, 256).to_pylist()), 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "counts"])

    rows = sample.mapInArrow(tidied(run), "lang string, counts binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["counts"])))
    x, y = np.ones((len(rows), (1 << BITS) + 1), dtype=np.float32), np.array([langs.index(r["lang"]) for r in rows])
    for a in range(0, len(rows), 256):  # the sample is on the driver once, as what is fitted
        some = rows[a : a + 256]
        x[a : a + 256, :-1] = features(np.stack([np.frombuffer(r["counts"], dtype="<u2") for r in some]).astype(np.float32))
        rows[a : a + 256] = [None] * len(some)
    w = fit(x, y, code)
    del x
    give_back()  # on the driver, which has the sample's counts for a while
    return langs, code, w


def hash_of(key: str) -> Column:
    """crc32 of the key as text, by which rows are held out; a null key's is 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def language_of(text: Column, model: tuple[list[str], np.ndarray, np.ndarray], spark: SparkSession) -> Column:
    """A struct of lang_pred, score and ambiguous for each text.

    Only the text goes to the Python workers, and a few bytes come back; the other columns of the row stay where they are.
    Null texts and texts without a letter are `und` with score 0, and so is everything if nothing was learned. Equal texts get equal
    results, so repeated rows and ties between languages (the first by name) have one answer. Long texts are counted piece by piece.
    """
    shared = spark.sparkContext.broadcast(model)  # one row for each n-gram slot, one column for each bit

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def run(text: pa.Array) -> pa.Array:
        langs, code, w = shared.value
        out: tuple[list, list, list] = ([], [], [])
        give_back()  # what tasks before left in this worker
        for a in range(0, len(text), 256):
            texts = text.slice(a, 256).to_pylist()
            known = [bool(langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
            x = features(counts([t if k else "" for t, k in zip(texts, known, strict=True)]))
            best, score, near = decide(x, w, code) if langs else (np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool))
            out[0].extend(langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True))
            out[1].extend(np.where(known, score, 0.0).tolist())
            out[2].extend((near & known).tolist())
        return pa.StructArray.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_())], names=["lang_pred", "score", "ambiguous"])

    return run(text)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score and ambiguous of each row of docs(key, text), as language_of() has them; an empty table gives none."""
    return docs.select(key, language_of(F.col("text"), model, docs.sparkSession).alias("found")).select(key, "found.*")


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    return train(docs.where("lang is not null and doc_id is not null").where(hash_of("doc_id") % 4 != 2))


def identify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learned(docs)).withColumn("held_out", hash_of("doc_id") % 4 == 2)


QUERIES = {"op5_language_codes": identify_documents}
