"""SentencePiece encoding and decoding through a relational lattice.

Texts are cut into words where no piece of the vocabulary can lie across. The lattice of a word is made of rows: its
substrings, equi-joined to the piece table and grouped by word, and the best path is a fold over the group's array.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsky.llm.common import bucketed, cut, give_back, setting, table, tidied

SPACE = "▁"
#: Stands for U+2581 in a text, as that stands for a space in pieces; a noncharacter.
OWN_SPACE = "\U0010fffe"
#: Parts of words that are sent to all tasks as hashes and ids, at most.
COMMON = 1 << 19
#: The seed of Spark's xxhash64().
SEED = 42
#: Characters of text in a block.
BLOCK_BYTES = 32 << 20
#: Texts that a task holds beside its block.
ROWS_A_BATCH = 500
#: Slots for the pieces' short substrings, by hash.
GRAM_BITS = 22
#: Words whose lattices a task makes, about.
WORDS_A_TASK = 16_000
#: Characters of a word that are one lattice.
CHUNK = 128
#: The score of a way that no path takes.
NOWHERE = -1e300


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores; ids of the 256 byte pieces, for what no piece covers; and a pattern of words."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    size: int

    @cached_property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @cached_property
    def unknown(self) -> float:
        return min(s for _, _, s in self.pieces) - 10

    @cached_property
    def pattern(self) -> str:
        """Words of letters and digits, or of other characters, each with the spaces before it, unless a piece lies across."""
        if any(re.search(rf"[^{SPACE}]{SPACE}", p) for p, _, _ in self.pieces):
            return r"(?s).+"
        pairs = {p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1) if SPACE not in p[i : i + 2]}
        letters = {c for p in pairs for c in p if re.match(r"\w", c)}
        odd: set[str] = set()
        # letters that a piece has beside another character count as such
        while more := {c for p in pairs for c in p if c in letters - odd and not set(p) <= letters - odd}:
            odd |= more
        some = re.escape("".join(sorted(odd)))
        other = rf"(?:[^\w{SPACE}]|[{some}])" if odd else rf"[^\w{SPACE}]"
        return rf"{SPACE}*(?:[^\W{some}]+|{other}+)|{SPACE}+"

    @cached_property
    def grams(self) -> np.ndarray:
        """Slots taken by the pieces of two and three characters, and by all runs of four."""
        taken = np.zeros(1 << GRAM_BITS, dtype=bool)
        runs = {p for p, _, _ in self.pieces if 2 <= len(p) <= 3} | {p[i : i + 4] for p, _, _ in self.pieces for i in range(len(p) - 3)}
        for size in (2, 3, 4):
            some = "".join(r for r in runs if len(r) == size)
            if some:
                taken[_slots(_points(some), size)[::size]] = True
        return taken

    def uncut(self, points: np.ndarray) -> np.ndarray:
        """For each character, whether a piece may hold it and the one before. Slots that collide only cut less."""
        n = len(points)
        across = np.zeros(n + 4, dtype=bool)
        for size in (2, 3, 4):
            if n >= size:
                starts = np.flatnonzero(self.grams[_slots(points, size)])
                for j in range(1, size):
                    across[starts + j] = True
        return across[:n]

    def bytes_of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces, joined, and each id's start and length."""
        text = [b""] * self.size
        for p, i, _ in self.pieces:
            text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            text[i] = bytes([b])
        n = np.array([len(t) for t in text], dtype=np.int64)
        return np.frombuffer(b"".join(text), dtype=np.uint8), np.cumsum(n) - n, n


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a SentencePiece model file with byte pieces.

    Of a BPE model the scores are the ranks of merges. Paths are best by these scores, as a unigram model's would be; the tokenizer
    itself merges in order of rank, so its ids differ from these for some words.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    raw = {int(m.id_to_piece(i)[1:-1], 16): i for i in ids if m.is_byte(i)}
    if len(raw) != 256:
        raise ValueError("the model has no byte pieces")
    plain = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return Vocabulary(tuple((m.id_to_piece(i), i, m.get_score(i)) for i in plain), tuple(raw[b] for b in range(256)), len(ids))


def _scores(vocab: Vocabulary) -> Column:
    """The score of each code of an edge; a constant of the plan, as large as the vocabulary."""
    scores = [vocab.unknown] * vocab.size + [NOWHERE, vocab.unknown]
    for _, i, score in vocab.pieces:
        scores[i] = score
    return F.split(F.lit(",".join(map(repr, scores))), ",").cast("array<double>")


def _edge(end: Column, start: Column, code: Column) -> Column:
    return F.shiftleft(end.cast("long"), 40).bitwiseOR(F.shiftleft(start.cast("long"), 24)).bitwiseOR(code.cast("long"))


def _end(edge: Column) -> Column:
    return F.shiftright(edge, 40).cast("int")


def _start(edge: Column) -> Column:
    return F.shiftright(edge, 24).bitwiseAND(0xFFFF).cast("int")


def _code(edge: Column) -> Column:
    return edge.bitwiseAND(0xFFFFFF).cast("int")


def _edges(texts: DataFrame, keys: list[str], vocab: Vocabulary) -> DataFrame:
    """keys and edges of each row of texts(*keys, word, size): the pieces that begin at its first `size` characters, and each single character.

    An edge is one number, of its end, its start and its code: the piece's id or, without a piece, the vocabulary's size plus 1 plus the code point.
    """
    pieces = texts.sparkSession.createDataFrame([(p, i) for p, i, _ in vocab.pieces], "piece string, id int")
    starts = texts.select(*keys, "word", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("start"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(vocab.longest), F.length("word") - F.col("start")))
    rows = starts.select(*keys, "word", "start", F.explode(lengths).alias("m"))
    rows = rows.select(*keys, "start", (F.col("start") + F.col("m")).alias("end"), F.substring(F.col("word"), F.col("start") + 1, F.col("m")).alias("piece"))
    # the piece table has the size of the vocabulary, whatever the input
    rows = rows.join(F.broadcast(pieces), "piece", "left").where("id is not null or end = start + 1")
    code = F.coalesce(F.col("id"), vocab.size + 1 + F.ascii("piece"))
    return rows.select(*keys, _edge(F.col("end"), F.col("start"), code).alias("edge")).groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def _fold(edges: Column, entry: Column, vocab: Vocabulary) -> Column:
    """The best score of each place of a lattice that is entered at `entry`, and the edge it is reached by; of equal ones the longest."""
    scores = _scores(vocab)
    node = lambda score, via: F.struct(score.alias("score"), via.alias("via"))
    first = F.concat(F.array_repeat(node(F.lit(NOWHERE), F.lit(0).cast("long")), entry), F.array(node(F.lit(0.0), F.lit(0).cast("long"))))

    def step(best: Column, e: Column) -> Column:
        # edges come by end, so a place that is not there yet is the next
        score = F.get(best, _start(e))["score"] + F.get(scores, F.least(_code(e), F.lit(vocab.size + 1)))
        more = F.concat(F.slice(best, F.lit(1), _end(e)), F.array(node(score, e)))
        return F.when(score > F.coalesce(F.get(best, _end(e))["score"], F.lit(float("-inf"))), more).otherwise(best)

    return F.aggregate(edges, first, step)


def _path(best: Column, place: Column, entry: Column, vocab: Vocabulary) -> Column:
    """The ids on the best path from entry to place, -1 minus the code point for a character without a piece."""

    def at(so_far: Column, p: Column) -> Column:
        e = F.get(best, p)["via"]
        own = F.when(_code(e) < vocab.size, _code(e)).otherwise(vocab.size - _code(e))
        return F.when((so_far["at"] != p) | (p <= entry), so_far).otherwise(F.struct(_start(e).alias("at"), F.concat(F.array(own), so_far["ids"]).alias("ids")))

    none = F.array().cast("array<int>")
    return F.when(place <= entry, none).otherwise(F.aggregate(F.sequence(place, F.lit(1)), F.struct(place.alias("at"), none.alias("ids")), at)["ids"])


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once."""
    return F.transform(F.array(value), use)[0]


def lattice(words: DataFrame, keys: list[str], vocab: Vocabulary) -> DataFrame:
    """keys and ids, the best path of each row of words(*keys, word): pieces' ids, and -1 minus the code point of a character without a piece.

    The paths of highest summed score; of equal ones that whose last piece is longest. Rows must be unique by keys. Empty words have no row. The groups
    are made where words lies: partitioned by some of the keys, it is not shuffled again. A word of over CHUNK characters goes the way of long_paths().
    """
    short = words.where("word <> ''").where(F.length("word") <= CHUNK).withColumn("size", F.length("word"))
    start = F.lit(0)
    ids = _bound(_fold(F.col("edges"), start, vocab), lambda best: _path(best, F.size(best) - 1, start, vocab))
    found = _edges(short, keys, vocab).select(*keys, ids.alias("ids"))
    long = words.where(F.length("word") > CHUNK)
    return found if long.isEmpty() else found.unionByName(long_paths(long, keys, vocab))


def long_paths(words: DataFrame, keys: list[str], vocab: Vocabulary) -> DataFrame:
    """As lattice(), for long words, each cut into chunks of CHUNK characters that are groups of their own: time is linear in a word's length.

    A path enters a chunk at one of its first places. For each of these the chunk's lattice is folded to the scores of the places where
    pieces leave it; a fold over the word's chunks, of a few numbers each, finds the places that the best path goes through; with these each chunk
    gives its ids. Between equal paths into a chunk the one that enters earlier is taken.
    """
    reach = vocab.longest - 1
    parts = words.select(*keys, F.regexp_extract_all("word", F.lit(f"(?s).{{1,{max(CHUNK, reach)}}}"), F.lit(0)).alias("parts"))
    zipped = F.arrays_zip(F.col("parts").alias("own"), F.slice("parts", F.lit(2), F.size("parts")).alias("next"))
    each = parts.select(*keys, F.size("parts").alias("chunks"), F.posexplode(zipped).alias("c", "p"))
    beyond = F.coalesce(F.substring("p.next", 1, reach), F.lit(""))
    each = each.select(*keys, "chunks", "c", F.concat("p.own", beyond).alias("word"), F.length("p.own").alias("size"), F.length(beyond).alias("extra"))
    own = [*keys, "chunks", "c", "size", "extra"]
    # places beyond the chunk are there even where no piece ends
    filler = F.when(F.col("extra") > 0, F.transform(F.sequence(F.col("size"), F.col("size") + F.col("extra") - 1), lambda x: _edge(x + 1, x, F.lit(vocab.size))))
    edges = cut(_edges(each, own, vocab).withColumn("edges", F.sort_array(F.concat("edges", F.coalesce(filler, F.array().cast("array<bigint>"))))), "edges")

    def folded(entry: str) -> Column:
        return _fold(F.filter("edges", lambda e: _start(e) >= F.col(entry)), F.col(entry), vocab)

    entries = F.when(F.col("c") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.least(F.lit(reach), F.col("size"))))
    ways = edges.withColumn("enter", F.explode(entries)).select(*keys, "c", "enter", F.slice(folded("enter"), F.col("size") + 1, F.col("extra") + 1)["score"].alias("leave"))
    chunks = ways.groupBy(*keys, "c").agg(F.sort_array(F.collect_list(F.struct("enter", "leave")))["leave"].alias("ways"))
    whole = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("c", "ways")))["ways"].alias("chunks"))
    nowhere = F.struct(F.lit(float("-inf")).alias("score"), F.lit(0).alias("enter"))

    def through(so_far: Column, ways: Column) -> Column:
        def to(x: Column) -> Column:
            def over(best: Column, e: Column) -> Column:
                score = F.get(so_far["score"], e) + F.get(F.get(ways, e), x)
                return F.when(score > best["score"], F.struct(score.alias("score"), e.alias("enter"))).otherwise(best)

            return F.aggregate(F.sequence(F.lit(0), F.size(ways) - 1), nowhere, over)

        left = F.transform(F.sequence(F.lit(0), F.size(F.get(ways, F.lit(0))) - 1), to)
        return _bound(left, lambda v: F.struct(v["score"].alias("score"), F.concat(so_far["enter"], F.array(v["enter"])).alias("enter")))

    begin = F.struct(F.array(F.lit(0.0)).alias("score"), F.array().cast("array<array<int>>").alias("enter"))

    def back(enter: Column) -> Column:
        def at(so_far: Column, c: Column) -> Column:
            e = F.get(F.get(enter, c), so_far["leave"])
            return F.struct(e.alias("leave"), F.concat(so_far["out"], F.array(F.struct(c.alias("c"), e.alias("enter"), so_far["leave"].alias("leave")))).alias("out"))

        none = F.array().cast("array<struct<c:int,enter:int,leave:int>>")
        return F.aggregate(F.sequence(F.size(enter) - 1, F.lit(0)), F.struct(F.lit(0).alias("leave"), none.alias("out")), at)["out"]

    chosen = whole.select(*keys, F.explode(_bound(F.aggregate("chunks", begin, through)["enter"], back)).alias("way")).select(*keys, "way.*")
    ids = _bound(folded("enter"), lambda best: _path(best, F.col("size") + F.col("leave"), F.col("enter"), vocab))
    done = edges.join(chosen, [*keys, "c"]).select(*keys, "c", ids.alias("ids"))
    return done.groupBy(*keys).agg(F.flatten(F.sort_array(F.collect_list(F.struct("c", "ids")))["ids"]).alias("ids"))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _slots(points: np.ndarray, size: int) -> np.ndarray:
    """The slot of each run of so many characters."""
    h = np.full(len(points) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        h = (h + points[j : len(points) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)


def units(words: list[str], vocab: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct parts of the words between which no piece can lie, how many parts each word has, and which ones."""
    text = OWN_SPACE.join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    first = np.cumsum(size + 1) - size - 1
    begins = ~vocab.uncut(_points(text))
    begins[first] = True
    gaps = (first + size)[:-1]
    ends = begins.copy()
    ends[gaps] = True
    begins[gaps] = False
    at = np.flatnonzero(begins)
    edges = np.append(np.flatnonzero(ends), len(text))
    to = edges[np.searchsorted(edges, at, side="right")]
    found: defaultdict[str, int] = defaultdict()
    found.default_factory = found.__len__
    which = np.fromiter((found[text[a:b]] for a, b in zip(at.tolist(), to.tolist(), strict=True)), dtype=np.int64, count=len(at))
    return list(found), np.diff(np.append(np.searchsorted(at, first), len(at))), which


def _escaped(text: str) -> str:
    return SPACE + text.replace(SPACE, OWN_SPACE).replace(" ", SPACE) if text else ""


def _packed(codes: np.ndarray) -> bytes:
    """Numbers in groups of seven bits, the highest bit of a byte set if more follow."""
    return _groups(codes)[0].tobytes()


def _groups(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of _packed() and how many each number has."""
    v = codes.astype(np.uint32)
    most = max(1, -(-int(v.max(initial=0)).bit_length() // 7))
    n = np.ones(len(v), dtype=np.int64)
    out = np.empty((len(v), most), dtype=np.uint8)
    for j in range(most):
        more = (v >> np.uint32(7 * (j + 1))) > 0 if j < 4 else np.zeros(len(v), dtype=bool)
        out[:, j] = (v >> np.uint32(7 * j)).astype(np.uint8) & 127 | more.astype(np.uint8) << 7
        n += more
    return out[np.arange(most) < n[:, None]], n


def _unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    if not len(b):
        return b
    last = np.flatnonzero(b < 128)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127) << (7 * place), first)


@dataclass(frozen=True)
class _Common:
    """The common parts: hashes, ascending, each with the start and number of its ids."""

    hashes: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def find(self, parts: list[str]) -> np.ndarray:
        """The place of each part among the common ones, or -1."""
        h = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), dtype=np.uint64, count=len(parts))
        if not len(self.hashes):
            return np.full(len(parts), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def _expanded(lists: pa.ListArray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists, joined, with bytes for characters without a piece, and how many each has; none is empty."""
    values, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    bare = np.flatnonzero(values < 0)
    if not len(bare):
        return values, n
    byte_ids = np.array(vocab.byte_ids, dtype=np.int32)
    put = [byte_ids[list((SPACE if -1 - i == ord(OWN_SPACE) else chr(-1 - i)).encode())] for i in values[bare].tolist()]
    size = np.ones(len(values), dtype=np.int64)
    size[bare] = [len(p) for p in put]
    out, at = np.repeat(values, size), np.cumsum(size) - size
    for b, p in zip(bare, put, strict=True):
        out[at[b] : at[b] + len(p)] = p
    return out, np.add.reduceat(size, np.cumsum(n) - n)


def _gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that `which` names, joined, and the length of each."""
    m = n[which]
    end = np.cumsum(m)
    return flat[np.repeat(start[which] - end + m, m) + np.arange(int(end[-1]) if len(end) else 0)], m


def _ends(n: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(n))


def to_blocks(docs: DataFrame, vocab: Vocabulary, key: str, block_bytes: int) -> DataFrame:
    """Runs of a task's documents of bounded size as one row each.

    block (a name), parts (the distinct parts of its words), n and which (how many parts each distinct word has, and which), keys, codes (the
    documents' words by number, compressed), length (of the codes), sizes (bytes of codes of each document) and hashes (of the texts).
    """
    pattern, name = vocab.pattern, docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(pattern)
        local: defaultdict[str, int] = defaultdict()
        local.default_factory = local.__len__
        keys: list = []
        codes: list[np.ndarray] = []
        hashes: list = []
        size = 0
        pack = pa.Codec("zstd", compression_level=3)

        def found(text: str) -> Iterator[str] | list[str]:
            return words.findall(text) if len(text) < 1 << 20 else (m.group() for m in words.finditer(text))

        def block() -> pa.RecordBatch:
            """The more frequent a word of the block, the lower its number."""
            count = np.bincount(np.concatenate(codes), minlength=len(local))
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order))
            words = list(local)
            parts, n, which = units([words[i] for i in order], vocab) if words else ([], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
            streams, sizes, a = [], [], 0
            while a < len(codes):  # some documents of bounded length, or one
                z, many = a, 0
                while z < len(codes) and (z == a or many + len(codes[z]) <= 1 << 16):
                    many += len(codes[z])
                    z += 1
                some, m = _groups(rank[np.concatenate(codes[a:z])])
                streams.append(some.tobytes())
                sizes.append(np.diff(_ends(m)[_ends(np.array([len(c) for c in codes[a:z]]))]))
                a = z
            stream = b"".join(streams)
            digest = xxhash.xxh128(stream)
            for part in (*map(repr, keys), *parts):
                digest.update(part)
            lists = [pa.array([x], pa.list_(t)) for x, t in ((parts, pa.string()), (keys, kind), (hashes, pa.int64()))]
            plain = [pa.array([x]) for x in (digest.hexdigest(), _packed(n), _packed(which), pack.compress(stream, asbytes=True), len(stream), _packed(np.concatenate(sizes)))]
            return pa.RecordBatch.from_arrays([*plain, *lists], names=["block", "n", "which", "codes", "length", "sizes", "parts", "keys", "hashes"])

        for batch in batches:
            kind = batch.column(0).type
            for a in range(0, batch.num_rows, ROWS_A_BATCH):
                some = batch.slice(a, ROWS_A_BATCH)
                for k, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    keys.append(k)
                    codes.append(np.fromiter(map(local.__getitem__, found(_escaped(text or ""))), dtype=np.int32))
                    hashes.append(xxhash.xxh64_intdigest(text or "") - (1 << 63))
                    size += len(text or "")
                    if size >= block_bytes:
                        yield block()
                        keys, codes, hashes, size = [], [], [], 0
                        local.clear()
        if keys:
            yield block()

    struct = f"block string, n binary, which binary, codes binary, length long, sizes binary, parts array<string>, keys array<{name}>, hashes array<bigint>"
    return docs.select(key, "text").mapInArrow(tidied(run), struct)


def encode(docs: DataFrame, vocab: Vocabulary, *, key: str = "doc_id", common: int = COMMON, block_bytes: int = BLOCK_BYTES, packed: bool = False) -> DataFrame:
    """key, ids (an array, or if packed its numbers in little-endian order, two bytes each in a vocabulary of at most 2**16, else four), n_tokens and roundtrip (whether the decoded ids have the hash of the text) of each row of docs(key, text).

    Texts become blocks of bounded size: numbers of words, and the distinct parts of these, cut where no piece can lie across.
    Every distinct part of the corpus is encoded once, by its lattice. Those in most blocks, at most `common`, are sent to all tasks; the
    others are joined to the blocks that hold them. No text is shuffled, and the documents of a word never meet in one task.
    Null and empty texts have no ids; repeated rows are returned each; an empty table gives none; other columns are not read, whatever their names.
    A text's own U+2581 and any character without a piece become byte pieces. Decoding gives the text back but for a U+10FFFE, which becomes U+2581.
    Ties are as in lattice(). Parts are held by 64-bit hashes; of a document with two that collide roundtrip is false.
    """
    spark = docs.sparkSession
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_A_BATCH):
        blocks = bucketed(to_blocks(docs, vocab, key, block_bytes), "blocks", "block")
    each = blocks.select("block", F.posexplode("parts").alias("w", "word"))
    parts = cut(each.groupBy("word").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("word")), "parts", "zstd")
    by_n = parts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("parts")).orderBy(F.col("n").desc()).collect()  # at most 2**16 rows
    dealt = parts.repartition(max(1, sum(r["parts"] for r in by_n) // WORDS_A_TASK), "h")  # so that a task's lattices fit its memory
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 4 * WORDS_A_TASK):  # so many small groups fit
        paths = cut(lattice(dealt, ["h", "n"], vocab), "paths", "zstd")
    total, least = 0, (1 << 16) + 1
    for r in by_n:
        total += r["parts"]
        if total > common:
            break
        least = r["n"]
    got = paths.where(F.col("n") >= least).select("h", "ids").toArrow()  # at most `common` parts
    top = spark.createDataFrame(got.select(["h"])) if got.num_rows else spark.createDataFrame([], "h long")
    hashes = got.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    ids, lengths = _expanded(got.column("ids").combine_chunks().take(pa.array(order)), vocab) if len(order) else (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
    shared = spark.sparkContext.broadcast(_Common(hashes[order], ids, _ends(lengths)[:-1], lengths))
    del got, hashes, order, ids, lengths
    give_back()

    rare = each.select("block", "w", F.xxhash64("word").alias("h")).join(F.broadcast(top), "h", "left_anti").join(paths.where(F.col("n") < least).select("h", "ids"), "h")
    joined = blocks.join(rare.groupBy("block").agg(F.collect_list(F.struct("w", "ids")).alias("paths")), "block", "left")
    name, form = docs.schema[key].dataType.simpleString(), _form(vocab)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        raw, raw_start, raw_n = vocab.bytes_of()
        for batch in batches:
            for b in range(batch.num_rows):
                at = {n: batch.column(n).slice(b, 1) for n in batch.schema.names}
                n, which, sizes = (_unpacked(at[x][0].as_py()) for x in ("n", "which", "sizes"))
                found = common.find(at["parts"][0].as_py()) + 1
                start, many, flat = np.zeros(len(found), dtype=np.int64), np.zeros(len(found), dtype=np.int64), common.ids
                there = found > 0
                start[there], many[there] = common.starts[found[there] - 1], common.lengths[found[there] - 1]
                own = at["paths"].flatten()  # nothing where all of the block's parts are common
                if len(own):
                    w = own.field("w").to_numpy()
                    own_ids, own_n = _expanded(own.field("ids"), vocab)
                    start[w], many[w] = len(flat) + _ends(own_n)[:-1], own_n
                    flat = np.concatenate([flat, own_ids])
                words, part_n = _gather(flat, start, many, which)
                word_n = np.add.reduceat(part_n, _ends(n)[:-1]) if len(n) else part_n
                word_start = _ends(word_n)[:-1]
                stream = np.frombuffer(pa.decompress(at["codes"][0].as_py(), at["length"][0].as_py(), "zstd"), dtype=np.uint8)
                keys, hashes, ends = at["keys"].flatten(), at["hashes"].flatten().to_pylist(), _ends(sizes)
                a = 0
                while a < len(sizes):  # some documents of bounded length, or one
                    z = min(a + 500, max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 18), side="right")) - 1))
                    some = stream[ends[a] : ends[z]]
                    ids, token_n = _gather(words, word_start, word_n, _unpacked(some))
                    tokens = _ends(token_n)[_ends(some < 128)[ends[a : z + 1] - ends[a]]]
                    right = []
                    for c in range(a, z):
                        text = _gather(raw, raw_start, raw_n, ids[tokens[c - a] : tokens[c - a + 1]])[0][1:]
                        right.append(xxhash.xxh64_intdigest(text.tobytes()) - (1 << 63) == hashes[c])
                    if packed:
                        offsets = (tokens * np.dtype(form).itemsize).astype(np.int32)
                        column = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype(form).tobytes())])
                    else:
                        column = pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([keys.slice(a, z - a), column, pa.array(np.diff(tokens)), pa.array(right)], names=[key, "ids", "n_tokens", "roundtrip"])
                    a = z

    return joined.mapInArrow(tidied(assemble), f"{key} {name}, ids {'binary' if packed else 'array<int>'}, n_tokens bigint, roundtrip boolean")


def _form(vocab: Vocabulary) -> str:
    return "<u2" if vocab.size <= 1 << 16 else "<u4"


def decode(encoded: DataFrame, vocab: Vocabulary, key: str = "doc_id") -> DataFrame:
    """key and text of each row of encoded(key, ids), packed or not; no or null ids give an empty text, and bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, start, n = vocab.bytes_of()
        form = _form(vocab)

        def numbers(ids: list | bytes | None) -> np.ndarray:
            return np.frombuffer(ids, dtype=form) if isinstance(ids, bytes) else np.array(ids or [], dtype=np.int64)

        for batch in batches:
            texts = [_gather(raw, start, n, numbers(ids))[0][1:].tobytes().decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), load(), packed=True)


QUERIES = {"op2_sentence_pieces": encode_documents}
