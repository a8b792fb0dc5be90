"""Token counts by two deterministic transducers, compiled from a tokenizer's vocabulary file.

The first one reads classes of characters and marks where words begin. It has a dozen states, so a chunk of text is a map from the state
before it to the state after it; the maps of all chunks of a batch are composed by a parallel prefix scan, whatever texts
the chunks belong to. The second one reads the bytes of a word, and each transition has the number of tokens that it emits; its states are compiled when they are first met.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from quietsky.llm.common import table

#: Characters that are worked on at once.
BATCH = 1 << 21
#: Symbols of a chunk, and symbols between two looks whether a chunk's states have become one.
CHUNK, LOOK = 256, 16
#: States of the second transducer, and words of up to so many bytes with their counts, that a worker keeps; beyond, it begins anew with those it meets.
MOST_STATES = MOST_WORDS = 1 << 18
SHORT = 32

# Classes of characters. The last but one are the letters of the endings 's 't 'm 'd, 're, 've, 'll; END follows each text.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, ONE, R, V, L, E, END = range(12)
# What a state has read since the last word began: nothing, letters, numbers, others, white space of length one or more that ends in a blank or another space, and parts of endings.
FRESH, WORD, DIGITS, SIGNS, BLANK1, SPACE1, BLANK2, SPACE2, Q, QR, QV, QL = range(12)
#: Marks on a transition: a word begins at this character, a word begins at the one before.
HERE, BEFORE = 1, 2


def split_step(state: int, symbol: int) -> tuple[int, int]:
    """Next state and marks."""
    letter = symbol in (LETTER, ONE, R, V, L, E)
    begun = WORD if letter else {NUMBER: DIGITS, OTHER: SIGNS, BLANK: BLANK1, SPACE: SPACE1, QUOTE: Q, END: FRESH}[symbol]
    if symbol == END:
        return FRESH, BEFORE if state in (QR, QV, QL) else 0
    if state in (BLANK1, SPACE1, BLANK2, SPACE2):
        if symbol in (BLANK, SPACE):
            return BLANK2 if symbol == BLANK else SPACE2, 0
        marks = BEFORE if state in (BLANK2, SPACE2) else 0
        if state in (BLANK1, BLANK2):  # the blank belongs to the word that follows
            return SIGNS if symbol == QUOTE else begun, marks
        return begun, marks | HERE
    if state == Q:
        if symbol in (ONE, R, V, L):
            return {ONE: FRESH, R: QR, V: QV, L: QL}[symbol], 0
        return (SIGNS, 0) if symbol in (OTHER, QUOTE) else (begun, HERE)
    if state in (QR, QV, QL):
        if symbol == (L if state == QL else E):
            return FRESH, 0
        after, marks = split_step(WORD, symbol)
        return after, marks | BEFORE
    same = {WORD: letter, DIGITS: symbol == NUMBER, SIGNS: symbol in (OTHER, QUOTE)}.get(state, False)
    return (state, 0) if same else (begun, HERE)


@cache
def split_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks, by 12 x state + symbol."""
    each = [split_step(s, c) for s in range(12) for c in range(12)]
    return np.array([e[0] for e in each], dtype=np.uint8), np.array([e[1] for e in each], dtype=np.uint8)


def classes() -> np.ndarray:
    """The class of each code point.

    Two Unicode tables, of different years, agree on nearly all; the others are what the library's own splitter takes them for.
    """
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[[ord(c) for c in m.group()]] = kind
    general = {"L": LETTER, "N": NUMBER}
    unsure = [c for c in every if out[ord(c)] != SPACE and general.get(unicodedata.category(c)[0], OTHER) != out[ord(c)]]
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for before, kind in (("!", OTHER), ("1", NUMBER), ("a", LETTER)):
        text = "".join(f"\n{before}{c}" for c in unsure)
        begins = {span[0] for _, span in split(text)}
        out[[ord(c) for i, c in enumerate(unsure) if 3 * i + 2 not in begins]] = kind
    for text, kind in ((" ", BLANK), ("'", QUOTE), ("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(c) for c in text]] = kind
    return out


def state_maps(symbols: np.ndarray) -> np.ndarray:
    """For each row of symbols, the state after it for each state before it.

    All states are followed until they have become one, which most rows reach at the first change of class.
    """
    step = split_tables()[0]
    n, length = symbols.shape
    maps = np.tile(np.arange(12, dtype=np.uint8), (n, 1))
    many, one, states = np.arange(n), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    for i in range(length):
        maps[many] = step[maps[many] * 12 + symbols[many, i, None]]
        states = step[states * 12 + symbols[one, i]]
        if i % LOOK == LOOK - 1 and len(many):
            met = (maps[many] == maps[many, :1]).all(axis=1)
            one, states, many = np.concatenate([one, many[met]]), np.concatenate([states, maps[many[met], 0]]), many[~met]
    maps[one] = states[:, None]
    return maps


def scanned(maps: np.ndarray) -> np.ndarray:
    """Each map after all maps before it, by doubling: as many rounds as the number of maps has bits."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return maps


def marked(symbols: np.ndarray) -> np.ndarray:
    """The marks of each symbol, of a stream that begins fresh."""
    n = len(symbols)
    rows = np.full((-(-n // CHUNK), CHUNK), END, dtype=np.uint8)
    rows.reshape(-1)[:n] = symbols
    after = scanned(state_maps(rows))[:, FRESH]
    state = np.concatenate([[FRESH], after[:-1]]).astype(np.uint8)
    step, mark = split_tables()
    out = np.empty_like(rows)
    for i in range(CHUNK):
        at = state * 12 + rows[:, i]
        out[:, i], state = mark[at], step[at]
    return out.reshape(-1)[:n]


class Merges:
    """The second transducer: bytes of a word to its number of tokens, as byte-pair merges by rank make them.

    A state has, for each suffix of what was read that begins a token, the suffix's place in the trie of tokens, the last token of the text before
    it, and how many tokens came since. The last token of a longer text is the only one that ends there and does not clash with the
    token before it, so a transition is found from the state alone; it emits the change of the count, which may be negative.
    """

    ROOT, NONE, LEVEL = 0, 0, 512

    def __init__(self, alphabet: list[int], merges: list[tuple[int, int, int]], spelling: dict[int, bytes]):
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.parts = {t: (a, b, r) for r, (a, b, t) in enumerate(merges)}
        if len(self.parts) != len(merges) or any(a not in spelling or b not in spelling for a, b, _ in merges):
            raise ValueError("each token must come from one merge of known tokens")
        self.go: dict[int, int] = {}
        self.token, self.inner = [self.NONE], [True]
        for t in [*alphabet, *self.parts]:
            if t in self.parts and self.clash(*self.parts[t]):
                continue  # merges never make it
            node = self.ROOT
            for b in spelling[t]:
                self.inner[node] = True
                if (at := node << 8 | b) not in self.go:
                    self.go[at] = len(self.token)
                    self.token.append(self.NONE)
                    self.inner.append(False)
                node = self.go[at]
            self.token[node] = t + 1
        self.clashes: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, int] = {}
        self.begin()

    def begin(self) -> None:
        self.states = [(self.packed(self.ROOT, self.NONE, 0),)]
        self.number = {self.states[0]: 0}
        self.transitions: dict[int, int] = {}

    def packed(self, node: int, last: int, since: int) -> int:
        return (since + self.LEVEL) << 48 | last << 24 | node

    def clash(self, a: int, b: int, before: int = 1 << 62) -> bool:
        """Whether a merge of a rank below `before` joins the end of token a with the beginning of token b before both are whole."""
        x, x_until = a, before
        while True:
            y, y_until = b, before
            while True:
                r = self.rank.get((x, y), before)
                if r < x_until and r <= y_until and r < before:
                    return True
                if y not in self.parts:
                    break
                y, _, y_until = self.parts[y]
            if x not in self.parts:
                return False
            _, x, x_until = self.parts[x]

    def compiled(self, state: int, byte: int) -> int:
        """The transition: next state << 12 | 2048 + tokens emitted."""
        kept, found, emitted = [], self.NONE, 0
        for entry in self.states[state]:
            node = self.go.get((entry & 0xFFFFFF) << 8 | byte)
            if node is None:
                continue
            last, since = entry >> 24 & 0xFFFFFF, (entry >> 48) - self.LEVEL
            t = self.token[node]
            if t and not found:
                if last and (clash := self.clashes.get((last, t))) is None:
                    clash = self.clashes[last, t] = self.clash(last - 1, t - 1)
                if not last or not clash:
                    found, emitted = t, 1 - since
            if self.inner[node]:
                kept.append((node, last, since))
        key = (*(self.packed(n, t, s + emitted) for n, t, s in kept), self.packed(self.ROOT, found, 0))
        fresh = len(self.states) >= MOST_STATES
        if fresh:
            self.begin()
            self.clashes = {}
        if (n := self.number.get(key)) is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
        out = n << 12 | 2048 + emitted
        if not fresh:
            self.transitions[state << 8 | byte] = out
        return out

    def count(self, word: bytes) -> int:
        if (n := self.known.get(word)) is None:
            n = self.run(word)
            if len(word) <= SHORT:
                if len(self.known) >= MOST_WORDS:
                    self.known.clear()
                self.known[word] = n
        return n

    def run(self, word: bytes) -> int:
        state = n = 0
        for b in word:
            at = self.transitions.get(state << 8 | b)
            if at is None:
                at = self.compiled(state, b)
            state = at >> 12
            n += (at & 4095) - 2048
        return n


@dataclass(frozen=True)
class Tokenizer:
    """What a vocabulary file says: bytes' ids, merges by rank as ids, spellings, and strings that are one token wherever they stand."""

    alphabet: list[int]
    merges: list[tuple[int, int, int]]
    spelling: dict[int, bytes]
    special: tuple[str, ...]
    classes: np.ndarray

    @cached_property
    def words(self) -> Merges:
        return Merges(self.alphabet, self.merges, self.spelling)

    @cached_property
    def apart(self) -> re.Pattern | None:
        longest = sorted(self.special, key=len, reverse=True)
        return re.compile("|".join(map(re.escape, longest))) if longest else None

    def begins(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Byte offsets of the words' begins, and each word's piece; and the bytes of all pieces."""
        text = "".join(pieces)
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum([len(p) for p in pieces])
        symbols = np.insert(self.classes[points], ends, END)
        width = np.insert((1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64), ends, 0)
        marks = marked(symbols)
        first = (marks & HERE) > 0
        first[:-1] |= (marks[1:] & BEFORE) > 0
        first &= symbols != END
        at = np.flatnonzero(first)
        return (np.cumsum(width) - width)[at], np.cumsum(symbols == END)[at], text.encode()

    def word_counts(self, begins: np.ndarray, data: bytes) -> np.ndarray:
        """Tokens of each word; each distinct word is read once."""
        offsets = np.append(begins, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        each = np.array([self.words.count(w) for w in words.dictionary.to_pylist()], dtype=np.int64)
        return each[words.indices.to_numpy(zero_copy_only=False)] if len(begins) else np.zeros(0, dtype=np.int64)

    def piece_counts(self, pieces: list[str]) -> np.ndarray:
        begins, piece, data = self.begins(pieces)
        total = np.zeros(len(pieces), dtype=np.int64)
        np.add.at(total, piece, self.word_counts(begins, data))
        return total

    def long_count(self, text: str) -> int:
        """Of a text of any length, by stretches: what follows the last word's begin is left to the next one."""
        n, at, length = 0, 0, BATCH
        while len(text) - at > length:
            begins, _, data = self.begins([text[at : at + length]])
            begins = begins[begins < len(data) - len(text[at + length - 1].encode())]  # whether the last character begins a word, the next one may decide
            if len(begins) < 2:
                length *= 2
                continue
            whole = data[: begins[-1]]
            n += int(self.word_counts(begins[:-1], whole).sum())
            at, length = at + len(whole.decode()), BATCH
        return n + int(self.piece_counts([text[at:]])[0])

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, special strings within it included."""
        out = [0] * len(texts)
        row, pieces, size = [], [], 0

        def flush() -> None:
            for i, n in zip(row, self.piece_counts(pieces).tolist() if pieces else [], strict=True):
                out[i] += n
            row.clear()
            pieces.clear()

        for i, text in enumerate(texts):
            parts = self.apart.split(text) if self.apart else [text]
            out[i] += len(parts) - 1
            for part in parts:
                if len(part) > BATCH:
                    out[i] += self.long_count(part)
                    continue
                row.append(i)
                pieces.append(part)
                size += len(part) + 1
                if size > BATCH:
                    flush()
                    size = 0
        flush()
        return out


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str | None = None) -> Tokenizer:
    """Reads a byte-level BPE file of the kind tokenizer.json; any other kind raises. By default byte_bpe_50k.json."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and file.get("normalizer") is None
    if not plain or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        raise ValueError("only byte-level BPE without a normalizer is compiled")
    added = file.get("added_tokens", [])
    if any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take white space or whole words are not compiled")
    letters, ids = byte_letters(), model["vocab"]
    spelling = {i: bytes(letters[c] for c in s) for s, i in ids.items() if all(c in letters for c in s)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return Tokenizer([ids[c] for c in letters], [(ids[a], ids[b], ids[a + b]) for a, b in merges], spelling, tuple(a["content"] for a in added), classes())


def token_count(text: Column, tokenizer: Tokenizer, spark: SparkSession) -> Column:
    """The number of tokens of each text, a long.

    Only texts go to the Python workers, each row by itself, so rows need no shuffle and repeated rows and ties have one answer. Null and empty texts have
    none. Texts of any length are read by stretches that are carried on in the state where the last word begins; bytes that are not UTF-8 count
    as U+FFFD. An empty table gives none. The broadcast has the size of the vocabulary file.
    """
    shared = spark.sparkContext.broadcast(tokenizer)

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [(b or b"").decode("utf-8", "replace") for b in batch.cast(pa.binary()).to_pylist()]
            yield pa.array(shared.value.counts(texts), pa.int64())

    return run(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, limit: int = 512) -> DataFrame:
    """docs(text and any other columns) with n_bytes (of UTF-8), n_tokens and over_limit, which replace columns of these names."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = docs.withColumns({"n_bytes": size, "n_tokens": token_count(F.col("text"), tokenizer, docs.sparkSession)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, load()).drop("text")


QUERIES = {"op13_token_counts": count_documents}
