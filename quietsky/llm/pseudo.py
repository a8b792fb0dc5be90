"""Language-model scoring by masked pseudo-likelihood with a bidirectional window network."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsky.llm.common import cut, table

VOCABULARY = 4096
RARE = 256
CLASSES = 64
SIZE = 16
REACH = 2
ROUNDS = 2
BATCH = 2048
CHUNK = 1 << 14
#: Rows of a block, numbered by 16 bits, and the rare words after which it ends.
BLOCK = 1 << 14
BLOCK_WORDS = 1 << 19
#: Bytes of text, and rare words, for each range of hashes by which words are counted.
PART_BYTES, PART_WORDS = 1 << 24, 1 << 20
#: Logarithm of the odds of each letter of a word that no other document has.
LETTER = -float(np.log(32))
#: Parts in which a task's weights are summed first.
PARTS = 64


@dataclass(frozen=True)
class Vocabulary:
    """Frequent words, hash buckets for the rest, each token's class, its logarithmic share of its class, and each bucket's words in the corpus."""

    ids: dict[bytes, int]
    classes: np.ndarray
    share: np.ndarray
    buckets: np.ndarray

    def codes(self, text: bytes | None, memo: _Memo) -> np.ndarray:
        return np.array(list(map(memo.__getitem__, (text or b"").lower().split())), dtype=np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Tokens of codes."""
        return np.where(codes < 0, len(self.ids) + codes % RARE, codes).astype(np.int32)

    def tokens(self, text: bytes | None, memo: _Memo) -> np.ndarray:
        return self.of(self.codes(text, memo))


def _code(word: bytes) -> int:
    """63 bits of hash, negative."""
    return (xxhash.xxh64_intdigest(word) >> 1) - (1 << 63)


class _Memo(dict):
    """Codes of words: the vocabulary's tokens, and the hashes of rare words while there are not too many."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(vocab.ids)
        self.vocab = vocab
        #: Bytes of the rare words, by code.
        self.sizes: dict[int, int] = {}

    def trim(self) -> None:
        """Forgets rare words once there are many; only between blocks."""
        if len(self.sizes) > 600_000:
            self.clear()
            self.update(self.vocab.ids)
            self.sizes.clear()

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
            self.update(self.vocab.ids)
        value = self[word] = _code(word)
        self.sizes[value] = len(word)
        return value


def _narrow(n: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in the narrowest type that holds all of them."""
    return n.astype(np.min_scalar_type(int(n.max(initial=0)))).tobytes()


def _wide(packed: bytes, n: int) -> np.ndarray:
    """The n numbers of _narrow()."""
    return np.frombuffer(packed, dtype=f"u{len(packed) // max(n, 1) or 1}").astype(np.int64)


def _part(code: np.ndarray, parts: int) -> np.ndarray:
    """In which of so many equal ranges of hashes each code lies; it ascends with the code."""
    return ((code >> 31) + (1 << 32)) * parts >> 32


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    """From the counts of all words of all documents: the `size` most frequent ones, ties by code point.

    Tasks count their own words and send them by ranges of hashes, a row for each range, of which there are as many as the texts' bytes ask for.
    A range has all counts of its words and gives its most frequent ones; the driver gets the top and the sums of the hash buckets. Classes
    divide the tokens, by frequency, into runs of about equal mass, after a class for each of the most frequent words.
    """
    parts = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.update((text or b"").lower().split())
                if len(held) > 300_000:
                    yield dealt(held)
                    held.clear()
        yield dealt(held)

    def dealt(held: Counter) -> pa.RecordBatch:
        words, n = list(held), np.fromiter(held.values(), dtype=np.int64, count=len(held))
        code = np.fromiter(map(_code, words), dtype=np.int64, count=len(words))
        part = _part(code, parts)
        order, ends = np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))
        own = [order[a:b] for a, b in zip(np.append(0, ends[:-1]), ends, strict=True) if a < b]
        sums = np.bincount(code % RARE, n, RARE).astype(np.int64)  # part -1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *(int(part[i[0]]) for i in own)], pa.int32()),
                pa.array([None, *(b" ".join([words[j] for j in i.tolist()]) for i in own)], pa.binary()),
                pa.array([_narrow(sums), *(_narrow(n[i]) for i in own)], pa.binary()),
            ],
            names=["part", "words", "n"],
        )

    def top_of(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        sums = np.zeros(RARE, dtype=np.int64)
        for batch in batches:
            for words, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if words is None:
                    sums += _wide(n, RARE)
                    continue
                own = words.split(b" ")
                for word, m in zip(own, _wide(n, len(own)).tolist(), strict=True):
                    held[word] = held.get(word, 0) + m
        if key[0].as_py() < 0:
            word, bucket, n = [None] * RARE, list(range(RARE)), sums.tolist()
        else:
            best = heapq.nsmallest(size, ((-m, w) for w, m in held.items()))
            word, n = [w for _, w in best], [-m for m, _ in best]
            bucket = [_code(w) % RARE for w in word]
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], names=["word", "bucket", "n"])

    counts = docs.select("text").mapInArrow(count, "part int, words binary, n binary").groupBy("part").applyInArrow(top_of, "word binary, bucket int, n long").persist()
    top = counts.where("word is not null").orderBy(F.col("n").desc(), "word").limit(size).collect()
    sums_ = np.zeros(RARE)
    for r in counts.where("word is null").collect():
        sums_[r["bucket"]] = r["n"]
    counts.unpersist()
    for r in top:
        sums_[r["bucket"]] -= r["n"]
    n = np.append([r["n"] for r in top], sums_) + 0.5
    alone = min(CLASSES // 2, len(top))
    order = np.argsort(-n, kind="stable")
    classes = np.zeros(len(n), dtype=np.int32)
    classes[order[:alone]] = np.arange(alone)
    mass = np.cumsum(n[order[alone:]])
    classes[order[alone:]] = alone + np.minimum((CLASSES - alone) * (mass - n[order[alone:]]) // mass[-1], CLASSES - alone - 1)
    return Vocabulary({bytes(r["word"]): i for i, r in enumerate(top)}, classes, np.log(n / np.bincount(classes, n, CLASSES)[classes]), sums_)


def _packed(vocab: Vocabulary) -> type:
    """Of what size tokens are held in columns."""
    return np.int16 if len(vocab.classes) < 1 << 15 else np.int32


def encoded(docs: DataFrame, vocab: Vocabulary, key: str = "doc_id") -> DataFrame:
    """key and ids, the packed tokens of each row of docs(key, text), which train() and score() read in place of the text."""
    words = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = words.value
        memo, kind = _Memo(vocab), _packed(vocab)
        for batch in batches:
            ids = [vocab.tokens(x, memo).astype(kind).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[key, "ids"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids binary")


def blocks(docs: DataFrame, vocab: Vocabulary, key: str = "doc_id") -> DataFrame:
    """Tokens as encoded() makes them, and the places of rare words, in one table.

    A row of docs becomes key, block, place (its number within the block), ids and lost: the logarithms of the bucket
    counts of its rare words, summed. The rare words of a block that lie in one range of hashes become a row of block, part (the range) and, packed, word
    (their hashes), own and size (occurrences and bytes of each) and ids, the place of each occurrence. Blocks are runs of a task's rows of bounded size,
    and there are as many ranges as rare words ask for.
    """
    words = docs.sparkSession.sparkContext.broadcast(vocab)
    kind = f"{key} {docs.schema[key].dataType.simpleString()}"
    parts = 1 + int(vocab.buckets.sum()) // PART_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = words.value
        memo, packed, n = _Memo(vocab), _packed(vocab), len(vocab.ids)
        with np.errstate(divide="ignore"):
            weight = np.log(vocab.buckets)
        block, held, place, size = TaskContext.get().partitionId() << 32, [], 0, 0

        def out(keys: pa.Array, place: pa.Array, ids: pa.Array, lost: pa.Array, *words: pa.Array) -> pa.RecordBatch:
            words = words or (pa.nulls(len(ids), pa.int32()), *[pa.nulls(len(ids), pa.binary())] * 3)
            return pa.RecordBatch.from_arrays([keys, pa.array([block] * len(ids), pa.int64()), place, ids, lost, *words], names=[key, "block", "place", "ids", "lost", "part", "word", "own", "size"])

        def rare(like: pa.DataType) -> Iterator[pa.RecordBatch]:
            """The words of the block that ends here."""
            code, at = np.concatenate([c for c, _ in held]), np.concatenate([np.full(len(c), i, dtype=np.uint16) for c, i in held])
            order = np.argsort(code, kind="stable")
            code, at = code[order], at[order]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            ends, some = np.append(first, len(code)), code[first]
            own, sizes = np.diff(ends), np.fromiter(map(memo.sizes.__getitem__, some.tolist()), dtype=np.int64, count=len(some))
            part = _part(some, parts)
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            runs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            for i in range(0, len(runs), 64):
                few = runs[i : i + 64]
                packed_ = [[of(a, b) for a, b in few] for of in (lambda a, b: some[a:b].tobytes(), lambda a, b: _narrow(own[a:b]), lambda a, b: _narrow(sizes[a:b]))]
                ids = pa.array([at[ends[a] : ends[b]].tobytes() for a, b in few], pa.binary())
                yield out(pa.nulls(len(few), like), pa.nulls(len(few), pa.int32()), ids, pa.nulls(len(few), pa.float64()), pa.array([int(part[a]) for a, _ in few], pa.int32()), *(pa.array(c, pa.binary()) for c in packed_))
            memo.trim()

        like = None
        for batch in batches:
            like, texts, a = batch.column(0).type, batch.column(1).cast(pa.binary()), 0
            while a < batch.num_rows:
                ids, lost, start = [], [], place
                for text in texts.slice(a):
                    code = vocab.codes(text.as_py(), memo)
                    t, own = vocab.of(code), code[code < 0]
                    ids.append(t.astype(packed).tobytes())
                    lost.append(float(weight[t[code < 0] - n].sum()))
                    if len(own):
                        held.append((own, place))
                    place, size = place + 1, size + len(own)
                    if place == BLOCK or size >= BLOCK_WORDS:
                        break
                yield out(batch.column(0).slice(a, len(ids)), pa.array(range(start, place), pa.int32()), pa.array(ids, pa.binary()), pa.array(lost, pa.float64()))
                a += len(ids)
                if place == BLOCK or size >= BLOCK_WORDS:
                    if held:
                        yield from rare(like)
                    block, held, place, size = block + 1, [], 0, 0
        if held:
            yield from rare(like)

    return docs.select(key, "text").mapInArrow(run, f"{kind}, block long, place int, ids binary, lost double, part int, word binary, own binary, size binary")


def word_shares(parts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """block, place, gained and unseen, for rows that have rare words.

    gained: the logarithms of the counts of a row's rare words in all other documents, summed. A masked document does not vouch for its own
    words: one that no other row has is spelled by letters within its bucket, and counts as unseen. A range of hashes has all occurrences of its
    words; what it finds goes back by block, packed, a row for each block of the range.
    """
    shared = parts.sparkSession.sparkContext.broadcast(vocab.buckets)  # one number for each bucket

    def counted(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One range."""
        with np.errstate(divide="ignore"):
            bucket = np.log(shared.value)
        block, words, own, size, ids = [], [], [], [], []
        for batch in batches:
            for i, w, o, z, at in zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True):
                block.append(i)
                words.append(np.frombuffer(w, dtype=np.int64))
                own.append(_wide(o, len(words[-1])))
                size.append(_wide(z, len(words[-1])))
                ids.append(np.frombuffer(at, dtype=np.uint16))
        source = np.repeat(np.arange(len(words)), [len(w) for w in words])
        words, own, size, at = (np.concatenate(x) for x in (words, own, size, ids))
        _, same = np.unique(words, return_inverse=True)
        n = np.bincount(same, own).astype(np.int64)[same]
        row = np.repeat(np.arange(len(words)), own)
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])))  # a word's places ascend
        row, mine = row[first], np.diff(np.append(first, len(at)))
        other = n[row] - mine
        value = np.where(other > 0, np.log(np.maximum(other, 1)), bucket[words[row] % RARE] + LETTER * (1.0 + size[row]))
        slot, same = np.unique(source[row] * BLOCK + at[first], return_inverse=True)
        gained, unseen = np.bincount(same, mine * value), np.bincount(same, mine * (other == 0)).astype(np.int64)
        ends = np.searchsorted(slot, np.arange(len(block) + 1) * BLOCK).tolist()
        for i in range(0, len(block), 64):
            few = [slice(a, b) for a, b in zip(ends[i : i + 64], ends[i + 1 : i + 65], strict=False)]
            cols = [[(slot[s] % BLOCK).astype(np.uint16).tobytes() for s in few], [gained[s].tobytes() for s in few], [_narrow(unseen[s]) for s in few]]
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(few), pa.int32()), pa.array(block[i : i + 64], pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["part", "block", "at", "gained", "unseen"])

    def summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One block, its ranges in their order."""
        total, unseen, seen = np.zeros(BLOCK), np.zeros(BLOCK, dtype=np.int64), np.zeros(BLOCK, dtype=bool)
        rows = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True))
        for _, at, gained, none in rows:
            at = np.frombuffer(at, dtype=np.uint16)
            total[at] += np.frombuffer(gained)
            unseen[at] += _wide(none, len(at))
            seen[at] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(total[at]), pa.array(unseen[at])], names=["block", "place", "gained", "unseen"])

    found = parts.where("part is not null").select("part", "block", "word", "own", "size", "ids").groupBy("part").applyInArrow(counted, "part int, block long, at binary, gained binary, unseen binary")
    return found.groupBy("block").applyInArrow(summed, "block long, place int, gained double, unseen long")


def windows(t: np.ndarray, at: np.ndarray, n_tokens: int) -> np.ndarray:
    """The 2 * REACH tokens around each place; n_tokens stands for what lies beyond the text."""
    edge = np.full(REACH, n_tokens, dtype=t.dtype)
    padded = np.concatenate([edge, t, edge])
    return np.stack([padded[at + j] for j in range(2 * REACH + 1) if j != REACH], axis=1)


def initial(n_tokens: int) -> list[np.ndarray]:
    """Embeddings, a weight for each place of the window, the output layer and its bias."""
    rng = np.random.default_rng(11)
    return [
        rng.normal(0, 0.1, (n_tokens + 1, SIZE)).astype(np.float32),
        np.ones((2 * REACH, SIZE), dtype=np.float32),
        rng.normal(0, 0.1, (SIZE, CLASSES)).astype(np.float32),
        np.zeros(CLASSES, dtype=np.float32),
    ]


def _forward(p: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = p[0][context]
    h = np.tanh(sum(e[:, j] * p[1][j] for j in range(2 * REACH)))
    logit = h @ p[2] + p[3]
    logit -= logit.max(axis=1, keepdims=True)
    return e, h, logit


def step(p: list[np.ndarray], context: np.ndarray, goal: np.ndarray, rate: float) -> None:
    """One gradient step on a batch, in place."""
    e, h, logit = _forward(p, context)
    d = np.exp(logit)
    d /= d.sum(axis=1, keepdims=True)
    d[np.arange(len(goal)), goal] -= 1
    d *= 1 / len(goal)
    back = (d @ p[2].T) * (1 - h * h)
    place = np.einsum("bjd,bd->jd", e, back)
    order = np.argsort(context.ravel(), kind="stable")
    rows = context.ravel()[order]
    grads = (back[:, None, :] * p[1][None]).reshape(-1, SIZE)[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    p[0][rows[first]] -= rate * 40 * np.add.reduceat(grads, first)
    p[1] -= rate * place
    p[2] -= rate * (h.T @ d)
    p[3] -= rate * d.sum(axis=0)


def _flat(p: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p])


def _shaped(v: np.ndarray, n_tokens: int) -> list[np.ndarray]:
    out, at = [], 0
    for like in initial(n_tokens):
        out.append(v[at : at + like.size].reshape(like.shape).astype(np.float32))
        at += like.size
    return out


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, rate: float = 2.0) -> list[np.ndarray]:
    """Weights of the network, learned from every token of every row of docs, which has a text or ids.

    In each round every task goes on from the common weights over its own documents, and sends its weights with the number
    of tokens; the new common weights are their mean. A round predicts one token in `rounds`, by place, other ones each
    round: after the last round every token of every document was predicted once, in texts of any length. A model
    has one size whatever the input, and what is sent grows with the number of tasks.
    """
    sc = docs.sparkSession.sparkContext
    if "ids" not in docs.columns:
        docs = encoded(docs.select(F.lit(0).alias("_k"), "text"), vocab, "_k")
    n = len(vocab.classes)
    words = sc.broadcast(vocab)
    common = _flat(initial(n))
    for turn in range(rounds):
        start = sc.broadcast(common)

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            vocab, p, seen = words.value, _shaped(start.value, n), 0
            kind = _packed(vocab)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0

            def learn(context: np.ndarray, goal: np.ndarray) -> None:
                mixed = np.random.default_rng(len(goal)).permutation(len(goal))
                for a in range(0, len(goal), BATCH):
                    some = mixed[a : a + BATCH]
                    step(p, context[some], goal[some], rate * min(1.0, len(some) / BATCH) / (1 + turn))

            for batch in batches:
                for ids in batch.column(0).to_pylist():
                    t = np.frombuffer(ids, dtype=kind)
                    at = np.arange(turn, len(t), rounds)
                    held.append((windows(t, at, n), vocab.classes[t[at]]))
                    size += len(at)
                    if size >= 16 * BATCH:
                        learn(*(np.concatenate(c) for c in zip(*held, strict=True)))
                        held, seen, size = [], seen + size, 0
            if size:
                learn(*(np.concatenate(c) for c in zip(*held, strict=True)))
            v = _flat(p)
            parts = [v[a : a + CHUNK].tobytes() for a in range(0, len(v), CHUNK)]
            if seen + size:
                task = TaskContext.get().partitionId() % PARTS
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array([float(seen + size)] * len(parts)), pa.array(parts, pa.binary())], names=["chunk", "part", "n", "w"])

        def mean(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weight = 0.0, 0.0
            for batch in rows:
                for m, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    total = total + m * np.frombuffer(w, dtype=np.float32).astype(np.float64)
                    weight += m
            part = key[1].as_py() if len(key) > 1 else 0
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([part], pa.int32()), pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["chunk", "part", "n", "w"])

        schema = "chunk int, part int, n double, w binary"
        sent = docs.select("ids").mapInArrow(run, schema)
        got = sent.groupBy("chunk", "part").applyInArrow(mean, schema).groupBy("chunk").applyInArrow(mean, schema).collect()  # one model
        if not got:
            break
        common = common.copy()
        for r in got:
            v = np.frombuffer(r["w"], dtype=np.float32)
            common[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(v)] = v
    return _shaped(common, n)


def log_likelihood(p: list[np.ndarray], vocab: Vocabulary, t: np.ndarray, real: np.ndarray) -> np.ndarray:
    """log P(token | both sides) where real: the token's class by the network, times its share of the class."""
    out, places = np.zeros(len(t)), np.flatnonzero(real)
    for a in range(0, len(places), 4096):
        at = places[a : a + 4096]
        _, _, logit = _forward(p, windows(t, at, len(vocab.classes)))
        goal = t[at]
        own = logit[np.arange(len(at)), vocab.classes[goal]]
        out[at] = own - np.log(np.exp(logit).sum(axis=1)) + vocab.share[goal]
    return out


def score(docs: DataFrame, p: list[np.ndarray], vocab: Vocabulary, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, pll (summed conditional log-probabilities) and mean_pll of each row of docs(key, text), or docs(key, ids).

    Null texts and texts without words have no tokens, pll 0 and a null mean; repeated rows are returned each; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((p, vocab))
    if "ids" not in docs.columns:
        docs = encoded(docs, vocab, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, vocab = shared.value
        kind = _packed(vocab)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):  # short texts are scored together
                t = [np.frombuffer(x, dtype=kind) for x in batch.column(1).slice(a, 64).to_pylist()]
                gap = np.full(REACH, len(vocab.classes), dtype=kind)
                spread = np.concatenate([y for x in t for y in (x, gap)])
                value = log_likelihood(p, vocab, spread, spread < len(vocab.classes))
                size = np.array([len(x) for x in t])
                ends = np.cumsum(size + REACH)
                total = np.add.reduceat(value, ends - size - REACH)
                cols = [
                    batch.column(0).slice(a, 64),
                    pa.array(size, pa.int64()),
                    pa.array(total),
                    pa.array([v / m if m else None for v, m in zip(total.tolist(), size.tolist(), strict=True)], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "n_tokens", "pll", "mean_pll"])

    return docs.select(key, "ids").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, pll double, mean_pll double")


def score_words(docs: DataFrame, vocab: Vocabulary, key: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """As score() by a network that learns from docs, with every rare word by its count in the other rows of docs, and unseen, how many words have none.

    The network gives a rare word the mass of its bucket; of that the word has its own count over the bucket's, or, if no other row has
    it, the odds of its letters. So a text that is nowhere else scores lower than one that repeats. vocab is that of docs. The counts stay
    in Spark, as many as there are words. Null and empty texts have no tokens, pll 0 and a null mean; repeated rows are returned each and vouch
    for each other; a text of any length is one row; an empty table gives none.
    """
    parts = cut(blocks(docs, vocab, key), "tokens")
    ids = parts.where("part is null").select(F.struct(key, "block", "place", "lost").alias("at"), "ids")
    plain = score(ids, train(ids, vocab, rounds), vocab, "at").select("at.*", "n_tokens", "pll")
    pll = F.col("pll") + F.coalesce(F.col("gained") - F.col("lost"), F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens"))
    found = plain.join(word_shares(parts, vocab), ["block", "place"], "left").select(key, "n_tokens", pll.alias("pll"), F.coalesce("unseen", F.lit(0)).alias("unseen"))
    return found.select(key, "n_tokens", "pll", mean.alias("mean_pll"), "unseen")


def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = vocabulary(docs)
    return score_words(docs, vocab)


QUERIES = {"op8_masked_likelihood": score_documents}
