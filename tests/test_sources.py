"""Archive ingestion and cleaning on small made-up recordings."""

import hashlib
import hmac
import pytest
from pyspark.sql import functions as F
import io
import wave
import zipfile

import numpy as np

from echolark.functions.cleaning import clean_pcm, close_gaps, denoise, drop_short, high_pass, mono
from echolark.sources.archives import read_archives


def wav(x):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16_000)
        w.writeframes(x)
    return out.getvalue()


def voice(seconds=0.6, level=0.3):
    t = np.arange(int(16_000 * seconds)) / 16_000
    return (level * np.sin(2 * np.pi * 300 * t) * 32767).astype("<i2").tobytes()


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ann/Mela.wav", wav(voice()))
        z.writestr("__MACOSX/ann/._mela.wav", b"x")
        z.writestr("ann/notes.txt", b"x")
        z.writestr("bob/bad.wav", b"not audio")
        z.writestr("../bob/out.wav", wav(voice()))
        z.writestr("alone.wav", wav(voice()))
        z.writestr("bob/bomb.wav", bytes(1 << 20))
    (tmp_path / "b.zip").write_bytes(b"none")
    rows = read_archives(spark, str(tmp_path), "a salt of sixteen bytes").collect()
    good = [r for r in rows if r.problem is None]
    assert [(r.word, bytes(r.pcm)) for r in good] == [("mela", voice())]
    assert good[0].split in ("train", "validation", "test") and "ann" not in good[0].speaker_hash
    problems = {(r.member or "").split("/")[-1]: r.problem for r in rows if r.problem}
    assert set(problems) == {"bad.wav", "out.wav", "alone.wav", "bomb.wav", ""}
    assert problems["out.wav"] == "unsafe path" and problems["bomb.wav"] == "too large"


def test_high_pass_keeps_phase():
    t = np.arange(16_000) / 16_000
    high, low = np.sin(2 * np.pi * 1000 * t), np.sin(2 * np.pi * 20 * t)
    assert np.abs(high_pass(high) - high)[2000:-2000].max() < 1e-3
    assert np.abs(high_pass(low))[4000:-4000].max() < 0.01


def test_masks_and_channels():
    v = np.array([0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1], bool)
    assert close_gaps(v, 2).tolist() == [False, True, True, True, True] + [False] * 5 + [True]
    assert drop_short(close_gaps(v, 2), 3).sum() == 4
    x = np.sin(np.arange(100.0))
    assert np.allclose(mono(np.stack([x, -2 * x], axis=1)), -2 * x)
    assert np.allclose(mono(np.stack([x, x / 2], axis=1)), 0.75 * x)


def test_denoise_without_noise_gives_the_input():
    x = np.random.default_rng(1).normal(size=5000)
    assert np.allclose(denoise(x, np.zeros(4000)), x)
    assert np.std(denoise(x, np.random.default_rng(2).normal(size=8000))) < 0.8


def test_clean_pcm():
    rng = np.random.default_rng(3)
    quiet = (rng.normal(size=4800) * 30).astype("<i2").tobytes()
    status, snr, _, speech, duration, _, denoised, _, pcm = clean_pcm(quiet + voice() + quiet)
    assert status == "ACCEPT" and snr > 20 and not denoised and abs(speech - 0.6) < 0.05 and abs(duration - 0.84) < 0.05
    x = np.frombuffer(pcm, "<i2") / 32767
    assert abs(20 * np.log10(np.sqrt(np.mean(x[2000:-2000] ** 2))) + 23) < 0.5
    assert clean_pcm(None)[0] == clean_pcm(b"")[0] == clean_pcm(bytes(9600))[0] == "REJECT"
    loud = (rng.normal(size=4800) * 1500).astype("<i2").tobytes()
    assert clean_pcm(loud + voice(level=0.5) + loud)[6]


def test_speakers_are_keyed_digests(spark):
    from echolark.functions.hashing import hmac_sha256

    for key in (b"k" * 16, b"long" * 40):
        df = spark.createDataFrame([("ann",), ("ünal",)], "s string")
        assert [r[0] for r in df.select(hmac_sha256(key, F.col("s"))).collect()] == [hmac.new(key, s.encode(), hashlib.sha256).hexdigest() for s in ("ann", "ünal")]
    with pytest.raises(ValueError):
        read_archives(spark, "/nowhere", "short")


def test_loose_files_of_several_folders(spark, tmp_path):
    import io
    import wave

    from echolark.sources.archives import read_wavs

    def wav(rate, n):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes(b"\1\0" * n)
        return out.getvalue()

    for name, data in (("a/x.wav", wav(16_000, 5)), ("b/c/y.WAV", wav(16_000, 7)), ("b/z.wav", wav(8_000, 3)), ("b/n.txt", b"text"), ("a/broken.wav", b"no audio")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_wavs(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert set(rows) == {"x.wav", "y.WAV", "z.wav", "broken.wav"}
    assert (len(rows["x.wav"].pcm), len(rows["y.WAV"].pcm)) == (10, 14) and rows["z.wav"].pcm is None and rows["broken.wav"].problem
