import hashlib
import zlib

import numpy as np

from tidemark.llm import audio, queries

from . import awkward


def test_samples_come_back_and_tones_are_found():
    payload = audio.pad(bytes(range(256)) * 3 + b"x")
    assert len(payload) % 64 == 0 and audio.from_wav(audio.to_wav(payload)) == payload
    assert audio.pad(b"") == bytes(64) and audio.pad(b"a" * 64) == b"a" * 64
    seconds = np.arange(8192) / audio.RATE
    tone = lambda hz: np.sin(2 * np.pi * hz * seconds) * (np.sin(2 * np.pi * 3 * seconds) > 0)
    wave = (128 + 60 * (tone(1000) + tone(2500)) / 2).astype(np.uint8).tobytes()
    times, bins = audio.spectrum_peaks(wave)
    wanted = {round(hz * audio.WINDOW / audio.RATE) for hz in (1000, 2500)}
    assert wanted & set(bins.tolist())
    prints = audio.fingerprints(wave)
    assert len(prints) and (np.diff(prints >> 32) >= 0).all()


def test_long_clips_are_cut_alike(monkeypatch):
    payload = audio.pad(np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes())
    whole = audio.fingerprints(payload).tolist()
    monkeypatch.setattr(audio, "FRAMES", 50)
    assert audio.fingerprints(payload).tolist() == whole


def test_awkward_documents(spark, tmp_path):
    folder = awkward.write(spark, tmp_path, awkward.frame(spark))
    found = queries.QUERIES["op9_wav_fingerprints"](spark, folder).collect()
    wanted = []
    for doc_id, text, *_ in awkward.documents():
        raw = (text or "").encode()
        payload = audio.pad(raw)
        media = audio.to_wav(payload)
        wanted.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted((tuple(r)[:7] for r in found), key=str) == sorted(wanted, key=str)
    assert len({r.media_sha256 for r in found}) == len({(r.media_sha256, r.feature) for r in found})


def test_prints_against_a_plain_transform():
    """The Fourier sums written out, peaks and pairs by loops over frames and bins."""
    rng = np.random.default_rng(3)
    seconds = np.arange(1600) / audio.RATE
    for payload in (bytes(64), bytes(range(256)) * 6, (128 + 50 * np.sin(2 * np.pi * 900 * seconds) * (np.sin(2 * np.pi * 9 * seconds) > 0) + rng.integers(-9, 9, 1600)).astype(np.uint8).tobytes(), b"the quick brown fox " * 64):
        samples = [b - 128.0 for b in payload]
        count = 1
        while (count - 1) * audio.HOP + audio.WINDOW < len(samples):
            count += 1
        samples += [0.0] * ((count - 1) * audio.HOP + audio.WINDOW - len(samples))
        turns = np.exp(-2j * np.pi * np.outer(np.arange(audio.WINDOW // 2 + 1), np.arange(audio.WINDOW)) / audio.WINDOW)
        hann = [0.5 - 0.5 * np.cos(2 * np.pi * k / audio.WINDOW) for k in range(audio.WINDOW)]
        size = [np.abs(turns @ (np.array(samples[t * audio.HOP : t * audio.HOP + audio.WINDOW]) * hann)) for t in range(count)]
        peaks = []
        for t in range(count):
            for low, high in zip(audio.BANDS, audio.BANDS[1:]):
                best = max(range(low, high), key=lambda b: (size[t][b], -b))
                beside = [size[s][best] for s in (t - 1, t + 1) if 0 <= s < count]
                if size[t][best] > audio.PEAK * size[t].mean() and all(size[t][best] > x + 1e-9 for x in beside):
                    peaks.append((t, best))
        wanted = sorted((t << 32) | ((u - t) << 16) | (a << 8) | b for k, (t, a) in enumerate(peaks) for u, b in peaks[k + 1 : k + 1 + audio.FAN] if u - t <= audio.REACH)
        assert audio.fingerprints(payload).tolist() == wanted
