"""Media columns: telephony audio.

Payload bytes are stored losslessly in WAV containers of one of three telephony formats. mu-law and A-law samples
are expanded by lookup tables, IMA ADPCM blocks are decoded with numpy, one time step across all blocks at once, and
the decoded samples are resampled to 16-bit PCM, a column of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import utf8

BLOCK = 64
RATE_IN, RATE_OUT = 8000, 16000
#: WAV format tags, fixed by the RIFF registry.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
NAMES = {tag: name for name, tag in TAGS.items()}

#: Fixed values of IMA ADPCM: quantiser steps, and the change of the step index by the low three bits of a code.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
     118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
     1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
     6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
     32767],
    dtype=np.int32,
)
IMA_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 0x84 << (u >> 4 & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    exponent, mantissa = a >> 4 & 7, (a & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


EXPAND = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}
#: What a code of four bits adds, in eighths of a step, before the division; row: code.
_NIBBLE_BITS = np.array([[c >> 2 & 1, c >> 1 & 1, c & 1, 1 - 2 * (c >> 3)] for c in range(16)], dtype=np.int32)
#: The signed change of the predictor for each step index and code, 89 x 16, and the step index that follows.
_DELTA = np.array(
    [[s * ((n >> 3) + (n if a else 0) + (n >> 1 if b else 0) + (n >> 2 if c else 0)) for a, b, c, s in _NIBBLE_BITS] for n in IMA_STEPS],
    dtype=np.int32,
)
_NEXT = np.clip(np.arange(len(IMA_STEPS))[:, None] + IMA_CHANGE[np.arange(16) & 7], 0, len(IMA_STEPS) - 1).astype(np.int32)


def decode_adpcm(blocks: np.ndarray, at_once: int = 16384) -> np.ndarray:
    """IMA ADPCM, mono: (n, size) bytes to (n, 1 + 2 * (size - 4)) samples; one step for all blocks at a time."""
    n, size = blocks.shape
    out = np.empty((n, 1 + 2 * (size - 4)), dtype=np.int16)
    delta, after = _DELTA.ravel(), _NEXT.ravel()
    for lo in range(0, n, at_once):
        part = np.ascontiguousarray(blocks[lo : lo + at_once].T)
        value = (part[0].astype(np.int32) | part[1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
        index = np.minimum(part[2], len(IMA_STEPS) - 1).astype(np.int32)
        cols = np.empty((out.shape[1], part.shape[1]), dtype=np.int16)
        cols[0] = value
        for k in range(4, size):
            for half in (0, 1):
                code = (part[k] >> 4 if half else part[k] & 15) + index * 16
                value = np.clip(value + delta[code], -32768, 32767)
                index = after[code]
                cols[1 + 2 * (k - 4) + half] = value
        out[lo : lo + at_once] = cols.T
    return out


def resampled(pieces: Iterable[np.ndarray], rate_in: int, rate_out: int, taps: int = 8) -> Iterator[np.ndarray]:
    """Band-limited resampling of a signal that comes in pieces, by a polyphase windowed sinc; how it is cut makes no
    difference. Edge samples are repeated outside the signal."""
    up, down = rate_out // gcd(rate_in, rate_out), rate_in // gcd(rate_in, rate_out)
    if up == down:
        yield from pieces
        return
    at = np.arange(taps) - taps // 2 + 1
    frac = np.arange(up)[:, None] / up
    cut = min(1.0, up / down)
    filters = cut * np.sinc(cut * (at - frac)) * np.cos(np.pi * (at - frac) / (taps + 1)) ** 2
    filters = (filters / filters.sum(axis=1, keepdims=True)).astype(np.float32)
    before, after = taps // 2 - 1, taps // 2
    held, base = np.zeros(0, np.float32), 0  # held begins before samples ahead of sample number base
    for piece in chain(pieces, [None]):
        if piece is None:
            held = np.append(held, np.repeat(held[-1:], after))
        elif len(piece):
            held = np.concatenate([held if len(held) else np.repeat(np.float32(piece[0]), before), piece.astype(np.float32)])
        n = len(held) - taps + 1
        if n <= 0:
            continue
        if down == 1:
            y = np.stack([np.correlate(held, filters[k], "valid") for k in range(up)], axis=1).ravel()
        else:
            t = np.arange(-(-base * up // down), -(-(base + n) * up // down), dtype=np.int64) * down
            y = sum(filters[t % up, k] * held[t // up - base + k] for k in range(taps))
        held, base = held[n:], base + n
        yield np.clip(np.rint(y), -32768, 32767).astype(np.int16)


def resample(pcm: np.ndarray, rate_in: int, rate_out: int, taps: int = 8) -> np.ndarray:
    """resampled() of a signal in one piece."""
    return np.concatenate([np.zeros(0, np.int16), *resampled([pcm], rate_in, rate_out, taps)])


def wav(codec: str, data: bytes, rate: int = RATE_IN) -> bytes:
    """data, unchanged, in a WAV container; ADPCM data must be whole blocks."""
    if codec == "ima_adpcm":
        per_block = 1 + 2 * (BLOCK - 4)
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
        samples = len(data) // BLOCK * per_block
    elif codec == "pcm16":
        form, samples = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16), len(data) // 2
    else:
        form, samples = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0), len(data)
    chunks = b"".join(
        name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
        for name, body in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", data))
    )
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and the data bytes of a WAV container."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = NAMES.get(tag, "pcm16")
        elif name == b"data":
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def payload_of(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % BLOCK or (0 if data else BLOCK))


def codec_of(payload: bytes) -> str:
    """The three formats take turns by the number of blocks, so that equal payloads are stored alike."""
    return ("mulaw", "alaw", "ima_adpcm")[len(payload) // BLOCK % 3]


def samples_of(codec: str, data: bytes, piece_bytes: int = 1 << 18) -> Iterator[np.ndarray]:
    """The samples of a container's data in pieces, each from about piece_bytes of whole blocks."""
    view, step = memoryview(data), max(BLOCK, piece_bytes // BLOCK * BLOCK)
    for lo in range(0, len(view), step):
        part = np.frombuffer(view[lo : lo + step], "<i2" if codec == "pcm16" else np.uint8)
        yield decode_adpcm(part.reshape(-1, BLOCK)).ravel() if codec == "ima_adpcm" else part if codec == "pcm16" else EXPAND[codec][part]


def decode(media: list[bytes], piece_bytes: int = 1 << 18) -> Iterator[tuple[str, int, bytes, Iterator[np.ndarray]]]:
    """Codec, rate, data and the samples, in pieces, of each container; ADPCM blocks of all small containers are decoded
    together, those of a large one piece by piece."""
    parts = [read_wav(m) for m in media]
    small = [c == "ima_adpcm" and len(d) <= piece_bytes for c, _, d in parts]
    blocks = [np.frombuffer(d, np.uint8).reshape(-1, BLOCK) for (_, _, d), own in zip(parts, small, strict=True) if own]
    decoded, at = decode_adpcm(np.concatenate(blocks)) if blocks else None, 0
    for (codec, rate, data), own in zip(parts, small, strict=True):
        if own:
            n = len(data) // BLOCK
            yield codec, rate, data, iter([decoded[at : at + n].ravel()])
            at += n
        else:
            yield codec, rate, data, samples_of(codec, data, piece_bytes)


def store_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a WAV file whose data chunk is the padded UTF-8 text.

    A null text is empty; an empty one is stored as 64 zero bytes. Rows are kept one to one, repeated rows and null
    ids included; other columns are not read.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("data").to_pylist()
            media = [wav(codec_of(p), p) for p in map(payload_of, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("data")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def _groups(media: list[bytes], most: int = 1 << 22) -> Iterator[list[bytes]]:
    group, size = [], 0
    for m in media:
        group.append(m)
        size += len(m)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


class Features:
    """Number of samples, peak, mean square and sign changes of a signal that comes as pieces of 16-bit PCM."""

    def __init__(self) -> None:
        self.n = self.peak = self.squares = self.changes = 0
        self.last = None

    def add(self, pcm: bytes) -> None:
        x = np.frombuffer(pcm, "<i2")
        if not len(x):
            return
        wide, below = x.astype(np.int64), x < 0
        self.n += len(x)
        self.peak = max(self.peak, int(wide.max()), -int(wide.min()))
        self.squares += int(np.dot(wide, wide))
        self.changes += int(np.count_nonzero(below[1:] != below[:-1])) + (self.last is not None and self.last != below[0])
        self.last = below[-1]

    def text(self, codec: str) -> str:
        return f"{codec} n={self.n} peak={self.peak} power={self.squares // max(1, self.n)} crossings={self.changes}"


AUDIO_FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, codec string, pcm array<binary>"
)


def audio_features(stored: DataFrame, rate: int = RATE_OUT, keep_pcm: bool = True) -> DataFrame:
    """Read the stored containers back: digests of payload and container, the signal as resampled 16-bit PCM (pcm:
    little-endian, in pieces of some hundred KB that follow one another), and features computed from those pieces.

    A piece is decoded and resampled at a time. The pieces of one row are held together, about 4 to 8 bytes for a byte
    of text; without keep_pcm (pcm is null) a row of any length takes the space of its container and one piece.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in AUDIO_FEATURES.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.binary())]
        for batch in batches:
            rows, at = batch.select(["doc_id", "n_bytes"]), 0
            for group in _groups(batch.column("media").to_pylist(), 1 << 19):
                cols: list[list] = [[] for _ in kinds]
                for m, (codec, rate_in, data, samples) in zip(group, decode(group), strict=True):
                    found, pcm = Features(), []
                    for x in resampled(samples, rate_in, rate):
                        piece = x.astype("<i2").tobytes()
                        found.add(piece)
                        if keep_pcm:
                            pcm.append(piece)
                    row = (
                        len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(m),
                        hashlib.sha256(m).hexdigest(), found.text(codec), codec, pcm if keep_pcm else None,
                    )
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
                own = rows.slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, cols, kinds)], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, AUDIO_FEATURES)
