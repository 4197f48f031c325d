"""Cleaning of one recording: zero-phase high pass, voice, noise, trimming and level. NumPy, one recording a call."""

from __future__ import annotations

import numpy as np

from echolark.functions.signal import RATE

BLOCK, SIZE, STEP = 320, 512, 128
WINDOW = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(SIZE) / SIZE)
REPORT = "status string, snr_db double, noise_floor_db double, speech_s double, duration_s double, clipped_ratio double, denoised boolean, gain_db double, pcm binary"
#: Levels in dBFS, times in seconds.
TARGET_DB, PEAK_DB, LEAST_GAIN_DB, MOST_GAIN_DB, PADDING_S = -23.0, -1.0, -12.0, 18.0, 0.12
DENOISE_BELOW_DB, RETRY_BELOW_DB = 20.0, 8.0


def _db(x):
    return 20 * np.log10(np.maximum(x, 1e-8))


def _rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(x * x))) if len(x) else 0.0


def mono(channels: np.ndarray) -> np.ndarray:
    """The mean of two channels, or the louder one where they would cancel out."""
    if channels.shape[1] == 1:
        return channels[:, 0]
    flat = (channels.std(axis=0) == 0).any()
    if not flat and np.corrcoef(channels[:, 0], channels[:, 1])[0, 1] < -0.5:
        return channels[:, int(_rms(channels[:, 1]) > _rms(channels[:, 0]))]
    return channels.mean(axis=1)


def high_pass(x: np.ndarray, cut: float = 70.0, order: int = 4) -> np.ndarray:
    """A Butterworth response forwards and backwards: its squared magnitude, without phase, on the spectrum."""
    edge = min(len(x) - 1, RATE // 10)
    padded = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]])
    f = np.tan(np.pi * np.fft.rfftfreq(len(padded), 1 / RATE) / RATE)
    with np.errstate(divide="ignore"):
        response = 1 / (1 + (np.tan(np.pi * cut / RATE) / f) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(padded) * response, len(padded))[edge : edge + len(x)]


def close_gaps(voice: np.ndarray, most: int) -> np.ndarray:
    """Silent runs of up to `most` blocks between voiced ones become voiced."""
    at = np.flatnonzero(voice)
    out = voice.copy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a - 1 <= most:
            out[a:b] = True
    return out


def drop_short(voice: np.ndarray, least: int) -> np.ndarray:
    """Voiced runs of fewer than `least` blocks become silent."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], voice.astype(np.int8), [0]])))
    out = voice.copy()
    for a, b in edges.reshape(-1, 2):
        if b - a < least:
            out[a:b] = False
    return out


def _spectra(x: np.ndarray) -> np.ndarray:
    extra = -len(x) % STEP
    padded = np.pad(x, (SIZE // 2, SIZE // 2 + extra))
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, SIZE)[::STEP] * WINDOW, axis=1)


def denoise(x: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """x less four fifths of the median noise power at each frequency, at least 0.12 of its own power."""
    if len(noise) < 0.08 * RATE:
        return x
    usual = np.median(np.abs(_spectra(noise)) ** 2, axis=0)
    spectra = _spectra(x)
    power = np.abs(spectra) ** 2
    pieces = np.fft.irfft(spectra * np.sqrt(np.maximum(power - 0.8 * usual, 0.12 * power) / np.maximum(power, 1e-12)), SIZE, axis=1) * WINDOW
    out, weight = np.zeros(len(pieces) * STEP + SIZE), np.zeros(len(pieces) * STEP + SIZE)
    for k, piece in enumerate(pieces):
        out[k * STEP : k * STEP + SIZE] += piece
        weight[k * STEP : k * STEP + SIZE] += WINDOW**2
    return (out / np.maximum(weight, 1e-12))[SIZE // 2 : SIZE // 2 + len(x)]


def clean_pcm(pcm: bytes | None, channels: int = 1) -> tuple:
    """REPORT of 16 kHz 16-bit PCM. Without whole samples or any voice: status REJECT and no audio."""
    frame = 2 * channels
    if not pcm or len(pcm) % frame:
        return ("REJECT", None, None, 0.0, 0.0, None, False, None, None)
    raw = np.frombuffer(pcm, "<i2").astype(float).reshape(-1, channels) / 32768
    clipped = float(np.mean(np.abs(raw) >= 0.999))
    x = mono(raw)
    x = x - x.mean()
    x = high_pass(x) if len(x) > 2 else x
    blocks = np.pad(x, (0, -len(x) % BLOCK)).reshape(-1, BLOCK)
    levels = np.sqrt(np.mean(blocks**2, axis=1))
    floor = float(np.percentile(_db(levels), 20))
    voice = drop_short(close_gaps(_db(levels) >= max(floor + 9, -42.0), 4), 3)
    if not voice.any():
        return ("REJECT", None, floor, 0.0, len(x) / RATE, clipped, False, None, None)
    at = np.flatnonzero(voice)
    start, stop = int(at[0]) * BLOCK, min(len(x), (int(at[-1]) + 1) * BLOCK)
    snr = float(_db(_rms(x[start:stop])) - _db(np.median(levels[~voice]) if (~voice).any() else 1e-8))
    if noisy := snr < DENOISE_BELOW_DB:
        x = denoise(x, np.concatenate([x[:start], x[stop:]]))
    pad = round(PADDING_S * RATE)
    gain = float(np.clip(TARGET_DB - _db(_rms(x[start:stop])), LEAST_GAIN_DB, MOST_GAIN_DB))
    x = x[max(0, start - pad) : stop + pad] * 10 ** (gain / 20)
    x *= min(1.0, 10 ** (PEAK_DB / 20) / max(float(np.abs(x).max()), 1e-8))
    speech, duration = float(voice.sum() * BLOCK / RATE), len(x) / RATE
    retry = snr < RETRY_BELOW_DB or speech < 0.25 or not 0.35 <= duration <= 15 or clipped > 0.01
    status = "RETRY" if retry else "WARNING" if clipped > 0.001 else "ACCEPT"
    return (status, snr, floor, speech, duration, clipped, noisy, gain, np.rint(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
