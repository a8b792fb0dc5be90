"""Media columns: payloads as FLAC streams of 8-bit samples, written and read back in vectorised batches.

A stream holds STREAMINFO, a SEEKTABLE with a point for every frame, and mono frames of 1024 samples. Each frame is
one subframe: constant, verbatim, or the Rice-coded residual of a fixed or quantised linear predictor, whichever is
shortest. All frames of a batch are coded side by side, one sample of each at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quietsky.llm.common import cut, table

BLOCK = 1024
RATE = 8000
ORDER, PRECISION, SHIFT = 4, 12, 9
BATCH_BYTES = 1 << 20
#: Frames that are coded side by side, at most: so much of a long text is in work at a time.
FRAMES = BATCH_BYTES // BLOCK


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) else 0)
            c &= (1 << bits) - 1
        out.append(c)
    return np.array(out, dtype=np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def _crc16(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of the frames at start, of size bytes each, side by side."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right") if len(left) else []
    crc = np.zeros(len(at), dtype=np.uint32)
    for i, n in enumerate(active):
        c = crc[:n]
        crc[:n] = ((c << 8) & 0xFF00) ^ CRC16[(c >> 8) ^ buf[at[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number, coded as UTF-8 codes characters, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x40
    while n >= room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room = 0x20 if len(tail) == 1 else room >> 1
    return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *reversed(tail)])


def _frame_header(number: int, n: int) -> bytes:
    size, more = (0xA0, b"") if n == BLOCK else (0x70, (n - 1).to_bytes(2, "big"))
    head = bytes([0xFF, 0xF8, size | 0x4, 0x02]) + _number(number) + more  # 8 kHz, mono, 8 bits
    return head + bytes([_crc8(head)])


def _predictor(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of order 4 for each row, by Levinson and Durbin."""
    ac = [np.einsum("ij,ij->i", x[:, : BLOCK - lag], x[:, lag:]).astype(np.float64) for lag in range(ORDER + 1)]
    a = np.zeros((len(x), ORDER))
    err = ac[0] * (1 + 1e-9) + 1
    for i in range(ORDER):
        acc = ac[i + 1].copy()
        for j in range(i):
            acc -= a[:, j] * ac[i - j]
        k = acc / err
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a = new
        err = np.maximum(err * (1 - k * k), 1e-3)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -top - 1, top).astype(np.int32)


def _rice(res: np.ndarray, n: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, the best Rice parameter of each row, and the bits it takes. inside: which samples count."""
    u = np.where(inside, (res << 1) ^ (res >> 31), 0).astype(np.int32)
    mean = u.sum(axis=1) / np.maximum(n, 1)
    low = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))).astype(np.int32), 0, 12)
    costs = [(u >> k[:, None]).sum(axis=1) + n * (k + 1) for k in (low, low + 1)]
    better = costs[1] < costs[0]
    return u, low + better, np.where(better, costs[1], costs[0]) + 10


def _code(data: np.ndarray, number: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of the n bytes of data from begin on, joined, and their sizes; they are coded side by side."""
    t = np.arange(BLOCK)
    real = t[None, :] < n[:, None]
    x = np.zeros((len(n), BLOCK), dtype=np.int32)
    x[real] = data[(begin[:, None] + t[None, :])[real]].astype(np.int32) - 128

    coef = _predictor(x)
    lag = [np.pad(x, ((0, 0), (j, 0)))[:, :BLOCK] for j in range(1, ORDER + 1)]
    lpc = x - (sum(coef[:, j, None] * lag[j] for j in range(ORDER)) >> SHIFT)
    trials = [
        (0, *_rice(x, n, real)),
        (ORDER, *_rice(lpc, n - ORDER, real & (t >= ORDER)[None, :])),
    ]
    extra = [0, 8 * ORDER + 9 + ORDER * PRECISION]
    bits = np.stack([c[3] + e for c, e in zip(trials, extra, strict=True)] + [8 * n, np.where(((x == x[:, :1]) | ~real).all(axis=1), 8, 1 << 30)])
    kind = bits.argmin(axis=0)  # 0 fixed, 1 linear, 2 verbatim, 3 constant
    heads = [_frame_header(int(i), int(m)) for i, m in zip(number, n, strict=True)]
    head_size = np.array([len(h) for h in heads])
    frame_size = head_size + 1 + -(-bits[kind, np.arange(len(n))] // 8) + 2
    start = np.cumsum(frame_size) - frame_size
    body = (start + head_size) * 8 + 8  # the first bit after the subframe's own header

    put: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def write(at, width, value):
        put.append((np.asarray(at, dtype=np.int64).ravel(), np.broadcast_to(width, np.shape(at)).astype(np.int64).ravel(), np.asarray(value, dtype=np.int64).ravel()))

    write(body - 8, 8, np.array([8 << 1, (32 + ORDER - 1) << 1, 1 << 1, 0])[kind])
    rows = np.flatnonzero(kind == 2)
    inside = real[rows]
    write((body[rows, None] + 8 * t[None, :])[inside], 8, (x[rows] & 0xFF)[inside])
    rows = np.flatnonzero(kind == 3)
    write(body[rows], 8, x[rows, 0] & 0xFF)
    for which, (order, u, k, _) in enumerate(trials):
        rows = np.flatnonzero(kind == which)
        if not len(rows):
            continue
        at = body[rows]
        for j in range(order):
            write(at + 8 * j, 8, x[rows, j] & 0xFF)
        at = at + 8 * order
        if which == 1:
            write(at, 9, np.full(len(rows), (PRECISION - 1) << 5 | SHIFT))
            for j in range(ORDER):
                write(at + 9 + PRECISION * j, PRECISION, coef[rows, j] & ((1 << PRECISION) - 1))
            at = at + 9 + ORDER * PRECISION
        kk = k[rows]
        write(at, 10, kk)
        v = u[rows, order:]
        inside = real[rows, order:]
        length = np.where(inside, (v >> kk[:, None]) + 1 + kk[:, None], 0)
        end = at[:, None] + 10 + np.cumsum(length, axis=1)
        tail = (1 << kk[:, None]) | (v & ((1 << kk[:, None]) - 1))
        write((end - kk[:, None] - 1)[inside], np.broadcast_to(kk[:, None] + 1, v.shape)[inside], tail[inside])

    total = int(frame_size.sum())
    words = total // 4 + 3
    at, width, value = (np.concatenate(c) for c in zip(*put, strict=True))
    value = value.astype(np.uint64) << (64 - (at & 31) - width).astype(np.uint64)
    word = at >> 5
    # no two codes share a bit, so adding them is joining them; sums stay below 2**32 and are exact
    packed = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    buf = np.frombuffer(packed.astype(np.uint32).astype(">u4").tobytes(), dtype=np.uint8).copy()
    flat = np.frombuffer(b"".join(heads), dtype=np.uint8)
    buf[np.repeat(start - (np.cumsum(head_size) - head_size), head_size) + np.arange(len(flat))] = flat
    crc = _crc16(buf, start, frame_size - 2)
    buf[start + frame_size - 2], buf[start + frame_size - 1] = crc >> 8, crc & 0xFF
    return buf[:total].tobytes(), frame_size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; each is coded as if it stood alone. Payloads are not empty, and under 900 MB, as the seek table's length has 24 bits."""
    if not payloads:
        return []
    size = np.array([len(p) for p in payloads])
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    frames = -(-size // BLOCK)
    if 18 * int(frames.max()) >= 1 << 24:
        raise ValueError("a payload is too long for its seek table")
    doc = np.repeat(np.arange(len(size)), frames)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(frames) - frames, frames)
    begin = np.repeat(np.cumsum(size) - size, frames) + number * BLOCK
    n = np.minimum(BLOCK, size[doc] - number * BLOCK)
    coded = [_code(data, *(v[a : a + FRAMES] for v in (number, begin, n))) for a in range(0, len(n), FRAMES)]
    raw, frame_size = b"".join(c for c, _ in coded), np.concatenate([z for _, z in coded])
    start = np.cumsum(frame_size) - frame_size

    out, first = [], 0
    for p, m in zip(payloads, frames, strict=True):
        own = slice(first, first + int(m))
        base = int(start[first])
        points = np.zeros(int(m), dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        points["sample"], points["offset"], points["n"] = number[own] * BLOCK, start[own] - base, n[own]
        signed = (np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + int(frame_size[own].min()).to_bytes(3, "big") + int(frame_size[own].max()).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        table_ = points.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table_).to_bytes(3, "big") + table_ + raw[base : int(start[own][-1] + frame_size[own][-1])])
        first += int(m)
    return out


FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
LEADING = np.array([16] + [15 - int(i).bit_length() + 1 for i in range(1, 1 << 16)], dtype=np.uint8)


def _frames(buf: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The samples, as unsigned bytes, of the n samples each of the subframes that begin at start; eight bytes follow the last."""
    wide = buf.astype(np.uint32)
    window = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]

    def peek(pos: np.ndarray, width) -> np.ndarray:
        return (window[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(32 - width)

    form = (buf[start] >> 1).astype(np.int64)
    pos = start * 8 + 8
    x = np.zeros((BLOCK, len(n)), dtype=np.int32)
    t = np.arange(BLOCK)
    rows = np.flatnonzero(form == 0)
    x[:, rows] = buf[start[rows] + 1].astype(np.int32) - ((buf[start[rows] + 1] & 0x80).astype(np.int32) << 1)
    rows = np.flatnonzero(form == 1)
    if len(rows):
        raw = buf[np.minimum(start[rows][None, :] + 1 + t[:, None], len(buf) - 1)]
        x[:, rows] = raw.view(np.int8)
    if ((form > 1) & (form < 8) | (form > 12) & (form < 32)).any():
        raise ValueError("reserved subframe type")
    rows = np.flatnonzero(form >= 8)
    if len(rows):
        order = np.where(form[rows] < 32, form[rows] - 8, form[rows] - 31)
        rows = rows[np.argsort(-(n[rows] - order), kind="stable")]
        order = np.where(form[rows] < 32, form[rows] - 8, form[rows] - 31)
        width = int(order.max(initial=0))
        coef, shift, p = np.zeros((width, len(rows)), dtype=np.int32), np.zeros(len(rows), dtype=np.int32), pos[rows].copy()
        y = np.zeros((BLOCK, len(rows)), dtype=np.int32)
        for j in range(width):
            have = np.flatnonzero(order > j)
            y[j, have] = peek(p[have], 8).astype(np.uint8).view(np.int8)
            p[have] += 8
        for o, c in FIXED.items():
            same = np.flatnonzero((form[rows] < 32) & (order == o))
            for j, v in enumerate(c if len(same) else []):
                coef[j, same] = v
        linear = np.flatnonzero(form[rows] >= 32)
        if len(linear):
            q = p[linear]
            bits = peek(q, 4).astype(np.int64) + 1
            shift[linear] = peek(q + 4, 5)
            q = q + 9
            for j in range(width):
                have = order[linear] > j
                v = np.zeros(len(linear), dtype=np.int64)
                for b in np.unique(bits[have]):
                    w = have & (bits == b)
                    v[w] = peek(q[w], int(b)).astype(np.int64)
                    v[w] -= (v[w] >> (b - 1)) << b
                    q[w] += b
                coef[j, linear] = v
            p[linear] = q
        if (peek(p, 6) != 0).any():
            raise ValueError("only one partition with a 4-bit parameter is read")
        k = peek(p + 6, 4)
        p = p + 10
        count = n[rows] - order
        active = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1), side="right")
        res = np.zeros((BLOCK, len(rows)), dtype=np.uint32)
        p, low, step, most = p.astype(np.uint32), np.uint32(32) - k, k + np.uint32(1), np.minimum(15, 24 - k.astype(np.int32)).astype(np.uint32)
        for i, m in enumerate(active):
            at_ = p[:m]
            w = window.take(at_ >> 3)
            w <<= at_ & 7
            q = LEADING.take(w >> 16).astype(np.uint32)
            part = res[i, :m]
            np.left_shift(w, q + 1, out=part)
            part >>= low[:m]
            long = np.flatnonzero(q > most[:m])
            for lane in long:  # longer than the window
                z, bit = 0, int(at_[lane])
                while not buf[bit + z >> 3] >> (7 - (bit + z & 7)) & 1:
                    z += 1
                q[lane] = z
                part[lane] = int.from_bytes(buf[bit + z + 1 >> 3 :][:4].tobytes(), "big") << (bit + z + 1 & 7) >> (32 - int(k[lane])) & ((1 << int(k[lane])) - 1)
            part |= q << k[:m]
            q += step[:m]
            at_ += q
        res = (res >> 1).view(np.int32) ^ -(res & 1).view(np.int32)
        for o in np.unique(order):
            lanes = np.flatnonzero(order == o)
            if o == 0:
                y[:, lanes] = res[:, lanes]
                continue
            c, s, z, r = coef[:o, lanes], shift[lanes], y[:, lanes], res[:, lanes]
            for i in range(o, int(n[rows][lanes].max())):
                guess = c[0] * z[i - 1]
                for j in range(1, o):
                    guess += c[j] * z[i - 1 - j]
                z[i] = r[i - o] + (guess >> s)
            y[:, lanes] = z
        x[:, rows] = y
    return (x.T.astype(np.int16) + 128).astype(np.uint8)[t[None, :] < n[:, None]]


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """For each stream its samples as unsigned bytes, and the sample offset and the size of each block.

    Frame checksums, frame numbers and the MD5 of the samples are verified; a mismatch raises ValueError.
    """
    points, base, at = [], [], 0
    for s in streams:
        if s[:5] != b"fLaC\x00" or s[42] != 0x83:
            raise ValueError("not a stream with STREAMINFO and SEEKTABLE")
        m = int.from_bytes(s[43:46], "big")
        points.append(np.frombuffer(s, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")], count=m // 18, offset=46))
        base.append(at + 46 + m)
        at += len(s)
    if not streams:
        return []
    buf = np.frombuffer(b"".join(streams) + bytes(8), dtype=np.uint8)
    frames = np.array([len(p) for p in points])
    ends = np.cumsum([len(s) for s in streams])
    start = np.concatenate([b + p["offset"].astype(np.int64) for b, p in zip(base, points, strict=True)])
    n = np.concatenate([p["n"].astype(np.int64) for p in points])
    sample = np.concatenate([p["sample"].astype(np.int64) for p in points])
    last = np.cumsum(frames) - 1
    stop = np.append(start[1:], 0)
    stop[last] = ends
    for i, (b, e) in enumerate(zip(start, start + 16, strict=True)):
        head = _frame_header(int(sample[i]) // BLOCK, int(n[i]))
        if buf[b:e].tobytes()[: len(head)] != head:
            raise ValueError("frame header does not match the seek table")
        start[i] += len(head)
        sample[i] = b
    crc = _crc16(buf, sample, stop - sample - 2)
    if (crc != (buf[stop - 2].astype(np.uint32) << 8 | buf[stop - 1])).any():
        raise ValueError("frame checksum mismatch")

    whole = []
    for a in range(0, len(n), FRAMES):
        z = min(a + FRAMES, len(n))
        first, last_ = int(sample[a]), int(stop[z - 1])
        whole.append(_frames(buf[first : last_ + 8], start[a:z] - first, n[a:z]))
    flat = np.concatenate(whole)
    out, first, done = [], 0, 0
    for s, p, m in zip(streams, points, frames, strict=True):
        total = int(p["n"].sum())
        own = flat[done : done + total]
        if hashlib.md5((own ^ 0x80).tobytes()).digest() != s[26:42]:
            raise ValueError("sample checksum mismatch")
        out.append((own.tobytes(), p["sample"].astype(np.int64), p["n"].astype(np.int64)))
        first, done = first + m, done + total
    return out


def _chunks(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes; a larger row is a run of its own."""
    begin = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield begin, i
            begin, total = i, 0
        total += s
    if begin < len(sizes):
        yield begin, len(sizes)


def to_media(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes and media (a FLAC stream of the text's UTF-8 bytes and zeros up to a multiple of 64) of each row.

    A null text is empty; equal texts have equal streams, and repeated rows are returned each; an empty table gives none; other columns are not read,
    whatever their names. A long text is coded FRAMES frames at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = texts.cast(pa.binary()).to_pylist()
            for a, b in _chunks([len(s or b"") for s in sizes]):
                raw = [s or b"" for s in sizes[a:b]]
                media = encode([s + bytes(-len(s) % 64 or (0 if s else 64)) for s in raw])
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array([len(s) for s in raw], pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def to_pcm(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media_bytes, media_sha256 and blocks (sample_offset, pcm) of each stream: what is read back from it, block by block, all checksums verified."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, streams = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in _chunks([len(s) for s in streams]):
                own = streams[a:b]
                back = decode(own)
                each = [pcm[o : o + m] for pcm, at, size in back for o, m in zip(at.tolist(), size.tolist(), strict=True)]
                items = pa.StructArray.from_arrays([pa.array(np.concatenate([at for _, at, _ in back])), pa.array(each, pa.binary())], names=["sample_offset", "pcm"])
                blocks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(at) for _, at, _ in back])), pa.int32()), items)
                digest = pa.array([hashlib.sha256(s).hexdigest() for s in own])
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), sizes.slice(a, b - a), pa.array([len(s) for s in own], pa.int64()), digest, blocks], names=[key, "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return media.select(key, "n_bytes", "media").mapInArrow(run, f"{key} {kind}, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset:bigint,pcm:binary>>")


def to_blocks(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each block of each stream: key, block, sample_offset, pcm (unsigned 8-bit samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, streams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _chunks([len(s) for s in streams]):
                rows = [(k, i, int(o), pcm[o : o + m]) for k, (pcm, at, size) in zip(keys[a:b], decode(streams[a:b]), strict=True) for i, (o, m) in enumerate(zip(at, size, strict=True))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (batch.column(0).type, pa.int32(), pa.int64(), pa.binary()), strict=True)], names=[key, "block", "sample_offset", "pcm"])

    return media.select(key, "media").mapInArrow(run, f"{key} {media.schema[key].dataType.simpleString()}, block int, sample_offset long, pcm binary")


def feature(pcm: bytes) -> str:
    """Sums over the samples as signed numbers: exact, and equal for equal texts."""
    x = np.frombuffer(pcm, dtype=np.uint8).astype(np.int64) - 128
    return f"sum={x.sum()};energy={(x * x).sum()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};travel={np.abs(np.diff(x)).sum()};peak={np.abs(x).max()}"


def pcm_features(pcm: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and a feature of each row of to_pcm(), computed from its blocks in the order of their offsets."""
    schema = f"{key} {pcm.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(4)
            for a in range(batch.num_rows):
                own = blocks[a].values
                offsets, parts = own.field("sample_offset").to_numpy(), own.field("pcm").to_pylist()
                if (offsets != np.append(0, np.cumsum([len(p) for p in parts]))[:-1]).any():
                    raise ValueError("blocks do not follow each other")
                whole = b"".join(parts)
                cols = [pa.array([len(whole)]), pa.array([hashlib.sha256(whole).hexdigest()]), pa.array([zlib.crc32(whole[-64:])], pa.int64()), batch.column(2).slice(a, 1), batch.column(3).slice(a, 1), pa.array([feature(whole)]), pa.array([len(parts)], pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1), batch.column(1).slice(a, 1), *cols], names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks"])

    return pcm.select(key, "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(run, schema)


def flac_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pcm_features(cut(to_pcm(to_media(table(spark, sf_dir, "documents"))), "pcm", "zstd"))


QUERIES = {"op6_flac_media": flac_documents}
