import hashlib
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seqspark.llm import media, queries
from tests.conftest import rows
from tests.llm.edges import TEXTS, edge_docs, empty_docs


def decode_block(block: bytes) -> list[int]:
    """IMA ADPCM, a nibble at a time."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(88, block[2])
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.IMA_STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=64, max_size=64), min_size=1, max_size=5))
def test_adpcm_blocks_match_scalar_decoding(blocks):
    got = media.decode_adpcm(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 64), at_once=2)
    assert got.tolist() == [decode_block(b) for b in blocks]


def test_tables_of_the_standard():
    assert media.EXPAND["mulaw"][[0x00, 0x80, 0x7F, 0xFF]].tolist() == [-32124, 32124, 0, 0]
    assert media.EXPAND["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    for table in media.EXPAND.values():
        assert len(table) == 256 and sorted(np.abs(table))[-1] > 32000


@given(st.sampled_from(["mulaw", "alaw", "ima_adpcm"]), st.binary(max_size=300))
def test_containers_are_lossless(codec, data):
    payload = media.payload_of(data)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload.startswith(data)
    assert media.read_wav(media.wav(codec, payload)) == (codec, 8000, payload)


def test_resampling_keeps_a_tone():
    t = np.arange(800)
    tone = np.rint(10_000 * np.sin(2 * np.pi * 400 * t / 8000)).astype(np.int16)
    for rate in (16000, 24000, 11025, 4000):
        y = media.resample(tone, 8000, rate)
        want = 10_000 * np.sin(2 * np.pi * 400 * np.arange(len(y)) / rate)
        assert abs(len(y) - 800 * rate / 8000) <= 1
        assert np.abs(y - want)[20:-20].max() < 400


def slow_resample(x, rate_in, rate_out, taps=8):
    """Each output sample by itself: a windowed sinc around its place among the input samples."""
    out, scale = [], min(1.0, rate_out / rate_in)
    for t in range(-(-len(x) * rate_out // rate_in)):
        base, frac = t * rate_in // rate_out, t * rate_in % rate_out / rate_out
        weights = [scale * np.sinc(scale * (k - frac)) * np.cos(np.pi * (k - frac) / (taps + 1)) ** 2 for k in range(1 - taps // 2, taps // 2 + 1)]
        values = [float(x[min(max(base + k, 0), len(x) - 1)]) for k in range(1 - taps // 2, taps // 2 + 1)]
        out.append(max(-32768, min(32767, round(float(np.dot(weights, values)) / sum(weights)))))
    return out


def test_pieces_make_no_difference():
    x = np.random.default_rng(0).integers(-32768, 32768, 3000).astype(np.int16)
    for rate in (16000, 11025, 4000, 8000):
        whole = media.resample(x, 8000, rate)
        for size in (1, 5, 64, 999):
            cut = [x[k : k + size] for k in range(0, len(x), size)]
            assert np.array_equal(np.concatenate(list(media.resampled(cut, 8000, rate))), whole)
        if rate != 8000:
            assert np.abs(whole - np.array(slow_resample(x, 8000, rate))).max() <= 1


def test_a_text_of_64_mb_takes_bounded_memory():
    code = """
import resource, numpy as np
from seqspark.llm import media, queries
data = np.random.default_rng(0).integers(0, 256, 1 << 26, dtype=np.uint8).tobytes()
for codec in ("mulaw", "ima_adpcm"):
    found = media.Features()
    for x in media.resampled(media.samples_of(codec, data), 8000, 16000):
        found.add(x.tobytes())
print(found.n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split())
    assert n == 2 * (1 << 20) * 121 and mb < 500


def test_query_matches_brute_force(spark, tmp_path):
    edge_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_telephony(spark, str(tmp_path))
    want, pcm = [], {}
    for doc_id, text in TEXTS:
        data = (text or "").encode()
        payload = media.payload_of(data)
        codec = media.codec_of(payload)
        m = media.wav(codec, payload)
        if codec == "ima_adpcm":
            samples = np.array([x for k in range(0, len(payload), 64) for x in decode_block(payload[k : k + 64])], np.int16)
        else:
            samples = media.EXPAND[codec][list(payload)]
        pcm[hashlib.sha256(m).hexdigest()] = samples
        want.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), codec))
    assert rows(got.drop("feature", "pcm")) == sorted(want, key=repr)
    for r in got.select("media_sha256", "feature", "pcm").collect():
        x = np.frombuffer(b"".join(map(bytes, r["pcm"])), "<i2").tolist()
        source = pcm[r["media_sha256"]]
        assert len(x) == 2 * len(source)
        if len(source) < 20_000:
            assert np.abs(np.array(x) - slow_resample(source, 8000, 16000)).max() <= 1
        changes = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert r["feature"].split()[1:] == [f"n={len(x)}", f"peak={max(map(abs, x))}", f"power={sum(v * v for v in x) // len(x)}", f"crossings={changes}"]
    assert media.audio_features(media.store_audio(edge_docs(spark)), keep_pcm=False).where("pcm IS NOT NULL").count() == 0


def test_empty_table(spark):
    assert media.audio_features(media.store_audio(empty_docs(spark))).count() == 0
