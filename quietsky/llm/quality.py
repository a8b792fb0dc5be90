"""Quality classifier: a sparse ensemble of rules, compiled into column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsky.llm.common import table, word_count
from quietsky.llm.language import hash_of

#: Labelled documents that are learned from, about, chosen by hash.
SAMPLE = 20_000
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """What the rules test: rates over a whole text. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(text, r"[\x20\x09-\x0D]+")
    n = F.size(words)
    lines = F.split(text, "\n")
    rate = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    again = F.size(F.filter(F.zip_with(words, F.slice(words, 2, n), lambda a, b: a == b), lambda x: x))
    return {
        "words": word_count(text).cast("double"),
        "word_length": F.length(text) / n,
        "distinct": F.size(F.array_distinct(words)) / n,
        "again": again / n,
        "symbols": rate(r"[#$%&*]{2,}"),
        "bangs": rate("!!"),
        "bars": rate(r"\|"),
        "capitals": rate("[A-Z]{2,}"),
        "digits": rate("[0-9]+"),
        "stops": rate(r"\."),
        "line_words": n / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


def _tree(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, n_bins: int, depth: int, path: tuple, out: list, rows: np.ndarray, least: int) -> None:
    """Grows a tree on residuals and appends (path, rows, value) of each leaf, and the path of each inner node with value None."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for f in range(bins.shape[1]):
            b = bins[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, n_bins))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
    if best[1] is None:
        out.append((path, rows, -g / (h + 1)))
        return
    if path:
        out.append((path, rows, None))
    f, cut = best[1]
    low = bins[rows, f] <= cut
    _tree(bins, grad, hess, n_bins, depth - 1, (*path, (f, cut, True)), out, rows[low], least)
    _tree(bins, grad, hess, n_bins, depth - 1, (*path, (f, cut, False)), out, rows[~low], least)


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, n_bins: int = 48, rate: float = 0.2, penalty: float = 3e-4, steps: int = 400) -> tuple[float, list[tuple[float, tuple]]]:
    """A bias and weighted rules; a rule is a conjunction of (feature, threshold, at most). Few labels give few rules; one class gives none."""
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if len(y) < 20 or y.min() == y.max():
        return bias, []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score, paths = np.full(len(y), bias), {}
    for _ in range(trees):  # boosted trees, for their paths
        p = 1 / (1 + np.exp(-score))
        leaves: list = []
        _tree(bins, p - y, p * (1 - p), n_bins, depth, (), leaves, np.arange(len(y)), max(5, len(y) // 500))
        for path, rows, value in leaves:
            if value is not None:
                score[rows] += rate * value
            if path:
                bounds: dict[tuple[int, bool], int] = {}
                for f, cut, low in path:  # of several bounds on one side the narrowest
                    bounds[f, low] = min(bounds.get((f, low), cut), cut) if low else max(bounds.get((f, low), cut), cut)
                paths[tuple(sorted((f, c, low) for (f, low), c in bounds.items()))] = None
    rules = [p for p in paths if all(cut < len(edges[f]) for f, cut, _ in p)]
    r = np.ones((len(y), len(rules)), dtype=np.float32)
    for i, path in enumerate(rules):
        for f, cut, low in path:
            r[:, i] *= (bins[:, f] <= cut) == low
    keep = np.flatnonzero((r.mean(axis=0) > 0.002) & (r.mean(axis=0) < 0.998))
    r, rules = r[:, keep], [rules[i] for i in keep]
    # lasso logistic regression by accelerated proximal steps; the bias is not shrunk
    size = 4 / max(float(np.linalg.norm(r, 2)) ** 2 / len(y) + 1, 1e-9)
    w = ahead = np.zeros(len(rules) + 1)
    w[-1] = ahead[-1] = bias
    for step in range(steps):
        miss = 1 / (1 + np.exp(-(r @ ahead[:-1] + ahead[-1]))) - y
        new = ahead - size * np.append(r.T @ miss, miss.sum()) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * penalty, 0)
        ahead = new + step / (step + 3) * (new - w)
        w = new
    chosen = [(float(w[i]), tuple((f, float(edges[f][cut]), low) for f, cut, low in rules[i])) for i in np.flatnonzero(np.abs(w[:-1]) > 1e-3)]
    return float(w[-1]), chosen


def compiled(model: tuple[float, list[tuple[float, tuple]]], names: list[str]) -> Column:
    """The rules as one column: a score from 0 to 1."""
    bias, rules = model
    total = F.lit(bias)
    for weight, path in rules:
        holds = F.lit(True)
        for f, threshold, low in path:
            holds = holds & ((F.col(names[f]) <= threshold) if low else (F.col(names[f]) > threshold))
        total = total + F.when(holds, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list[tuple[float, tuple]]]:
    """Fits on the statistics of about `sample` labelled documents, chosen by hash; labels(doc_id, quality) without nulls."""
    n = labels.count()
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = labels.where(uniform < min(1.0, sample / max(n, 1))).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y"))
    stats = statistics(F.col("text"))
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"])  # a bounded sample: 12 bytes a row
    got = rows.select("_y", *[c.cast("double").alias(k) for k, c in stats.items()]).toPandas()
    got = got.sort_values(list(got.columns))  # the fit does not depend on the order of tasks
    return fit(got.iloc[:, 1:].to_numpy(dtype=np.float64), got["_y"].to_numpy(dtype=np.float64))


def score_quality(docs: DataFrame, model: tuple[float, list[tuple[float, tuple]]], keep: list[str]) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from THRESHOLD on) to the columns `keep` of docs; only the text counts.

    Null and empty texts are scored as empty ones; equal texts score alike; repeated rows are returned each; an empty table gives none. A long text
    is one row, of which the words are held at once. Columns of docs other than text and `keep` are not read, whatever their names.
    """
    stats = statistics(F.col("text"))
    wide = docs.select(*[F.col(c).alias(f"_k_{c}") for c in keep], *[c.cast("double").alias(k) for k, c in stats.items()])
    scored = wide.select(*[F.col(f"_k_{c}").alias(c) for c in keep], compiled(model, list(stats)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def learned(docs: DataFrame, labels: DataFrame) -> tuple[float, list[tuple[float, tuple]]]:
    return train(docs.select("doc_id", "text"), labels.where("doc_id is not null and quality is not null").where(hash_of("doc_id") % 5 != 0))


def quality_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, ["doc_id"]).withColumn("held_out", hash_of("doc_id") % 5 == 0)


QUERIES = {"op7_rule_ensemble": quality_documents}
