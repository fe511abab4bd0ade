"""Signals in blocks equal the same operators on rows of samples."""

import random
import struct
import wave

import pytest
from pyspark.sql import functions as F

from colloquy.operators import blocks as K
from colloquy.operators import signal as S
from colloquy.sources import wav


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(4)
    rows = [(name, 0, i, rnd.uniform(-1.5, 1.5)) for name, n in (("a", 1), ("b", 64), ("c", 65), ("d", 1000)) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, channel int, i long, value double")


def rows(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("rates", [(2, 3), (3, 2), (8000, 16000), (44100, 16000), (5, 5), (1, 50)])
@pytest.mark.parametrize("size", [1, 64, 1 << 16])
def test_resampling(series, rates, size):
    got = K.to_samples(K.resample_blocks(K.to_blocks(series, size).drop("channel"), *rates))
    assert rows(got, "series_id", "i", "value") == rows(S.resample_linear(series, *rates), "series_id", "i", "value")


def test_windows_and_mix(series):
    for size in (7, 64):
        got = K.hop_window_blocks(K.to_blocks(series, size), rate=20.0)
        assert rows(got, "series_id", "win_ix", "center", "rms", "n_samples") == rows(S.hop_windows(series, rate=20.0), "series_id", "win_ix", "center", "rms", "n_samples")
    two = series.unionAll(series.where("i % 3 = 1").select("series_id", F.lit(1), "i", -2 * F.col("value")))
    got = K.to_samples(K.downmix_blocks(K.to_blocks(two, 64)))
    assert rows(got, "series_id", "i", "value") == rows(S.downmix_normalize(two), "series_id", "i", "value")


def test_empty_series(spark):
    empty = K.to_blocks(spark.createDataFrame([], "series_id string, channel int, i long, value double"))
    assert K.downmix_blocks(empty).count() == K.resample_blocks(empty, 1, 2).count() == K.hop_window_blocks(empty, 20.0).count() == 0


def make_wav(path, channels, rate, n, before=b""):
    with wave.open(str(path), "wb") as f:
        f.setparams((channels, 2, rate, n, "NONE", ""))
        f.writeframes(b"".join(struct.pack("<h", (7 * i * (c + 1)) % 30_000 - 15_000) for i in range(n) for c in range(channels)))
    data = path.read_bytes()
    path.write_bytes(data[:12] + before + data[12:])


def test_headers_are_read_by_range(spark, tmp_path):
    """44 bytes of each file are read, however long it is; chunks before the format are walked on demand."""
    make_wav(tmp_path / "ok 100%+.wav", 1, 16000, 1600)
    make_wav(tmp_path / "stereo.WAV", 2, 16000, 10)
    make_wav(tmp_path / "slow.wav", 1, 8000, 10)
    listed = b"LIST" + struct.pack("<I", 5) + b"x" * 6
    make_wav(tmp_path / "listed.wav", 1, 16000, 50, listed)
    (tmp_path / "short.wav").write_bytes(b"RIFF")
    (tmp_path / "other.wav").write_bytes(b"x" * 60)
    (tmp_path / "sub").mkdir()
    with open(tmp_path / "sub" / "big.wav", "wb") as f:
        f.write((tmp_path / "ok 100%+.wav").read_bytes()[:44])
        f.truncate(10 << 20)
    got = {r.name: r for r in wav.read_wav_headers(spark, str(tmp_path)).collect()}
    assert {n: r.reason for n, r in got.items() if n not in ("listed.wav", "other.wav")} == {"ok 100%+.wav": None, "stereo.WAV": "not mono", "slow.wav": "not 16 kHz", "short.wav": "too short", "big.wav": None}
    assert got["listed.wav"].reason is not None and got["big.wav"].length == 10 << 20
    assert {n: r.bytes_read for n, r in got.items()} == {n: 4 if n == "short.wav" else 44 for n in got}
    walked = {r.name: r for r in wav.read_wav_headers(spark, str(tmp_path), walk=True).collect()}
    assert walked["listed.wav"].reason is None and walked["other.wav"].reason == "no RIFF file" and walked["stereo.WAV"].channels == 2
    assert all(r.bytes_read <= 100 for r in walked.values())


def test_samples_of_recordings(spark, tmp_path):
    make_wav(tmp_path / "a.wav", 2, 8000, 1000, b"LIST" + struct.pack("<I", 4) + b"abcd")
    b = wav.read_wav_blocks(spark, str(tmp_path), block=300)
    assert sorted((r.channel, r.start, r.n, len(r.samples)) for r in b.collect()) == sorted((c, s, 1000, min(300, 1000 - s)) for c in (0, 1) for s in (0, 300, 600, 900))
    mono = K.to_samples(K.downmix_blocks(b)).orderBy("i").collect()
    want = [sum((7 * i * (c + 1)) % 30_000 - 15_000 for c in (0, 1)) / 2 / 32768 for i in range(1000)]
    assert [r.i for r in mono] == list(range(1000)) and all(abs(r.value - w) < 1e-6 for r, w in zip(mono, want))
    assert K.to_samples(K.resample_blocks(K.downmix_blocks(b), 8000, 16000)).count() == 2000
