"""Small NumPy helpers used inside Arrow batches: PCM, WAV headers, resampling, spectra."""

from __future__ import annotations

import io
import struct
import wave
from math import gcd

import numpy as np

from sonarium.schemas import SAMPLE_RATE

# ---- fixed values: spectral conventions -----------------------------------------------------
N_MELS = 128
POWER_FLOOR = 1e-10
TOP_DB = 80.0
MEL_LINEAR_HZ = 200.0 / 3.0  # Hz per mel below the break
MEL_BREAK_HZ = 1000.0
MEL_LOG_STEP = np.log(6.4) / 27.0
DELTA_WIDTH = 9
ROLLOFF_SHARE = 0.85
KAISER_BETA = 5.0
FILTER_LOBES = 10
# ---------------------------------------------------------------------------------------------


# Filters and bases built once per Python task.
_TABLES: dict = {}


def decode(buffer: bytes) -> np.ndarray:
    return np.frombuffer(buffer, dtype="<i2")


def encode(samples: np.ndarray) -> bytes:
    """Clip to the int16 range and truncate toward zero."""
    return np.clip(np.asarray(samples, dtype=np.float64), -32768, 32767).astype("<i2").tobytes()


def read_wav(content: bytes, whole_numbers: bool = True) -> tuple[int, np.ndarray]:
    """Rate and mono samples on the int16 scale; ``whole_numbers`` floors the channel mean."""
    with wave.open(io.BytesIO(content)) as reader:
        width, channels, rate = reader.getsampwidth(), reader.getnchannels(), reader.getframerate()
        raw = reader.readframes(reader.getnframes())
    if width == 2:
        values = np.frombuffer(raw, dtype="<i2").astype(np.float64)
    elif width == 1:
        values = (np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128.0) * 256.0
    elif width == 3:
        padded = np.zeros((len(raw) // 3, 4), dtype=np.uint8)
        padded[:, 1:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
        values = padded.view("<i4").ravel().astype(np.float64) / 65536.0
    else:
        values = np.frombuffer(raw, dtype="<i4").astype(np.float64) / 65536.0
    if channels > 1:
        values = values.reshape(-1, channels).mean(axis=1)
        values = np.floor(values) if whole_numbers else values
    return rate, values


def write_wav(pcm: bytes, rate: int = SAMPLE_RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as writer:
        writer.setnchannels(1)
        writer.setsampwidth(2)
        writer.setframerate(rate)
        writer.writeframes(pcm)
    return out.getvalue()


def wav_header(content: bytes) -> tuple[int, int, int]:
    """``rate, channels, frames`` from the RIFF chunks, without touching the samples."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    position, rate, channels, block = 12, 0, 0, 0
    while position + 8 <= len(content):
        name, size = content[position : position + 4], struct.unpack_from("<I", content, position + 4)[0]
        if name == b"fmt ":
            channels, rate, _, block = struct.unpack_from("<HIIH", content, position + 10)
        elif name == b"data":
            return rate, channels, min(size, len(content) - position - 8) // block
        position += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def _low_pass(up: int, down: int) -> np.ndarray:
    if ("low_pass", up, down) not in _TABLES:
        widest = max(up, down)
        half = FILTER_LOBES * widest
        taps = np.sinc(np.arange(-half, half + 1) / widest) / widest * np.kaiser(2 * half + 1, KAISER_BETA)
        _TABLES["low_pass", up, down] = taps / taps.sum() * up
    return _TABLES["low_pass", up, down]


def resample(samples: np.ndarray, rate: int, target: int = SAMPLE_RATE) -> np.ndarray:
    """Rational resampling with a polyphase FIR; the result has ``ceil(n * target / rate)`` samples."""
    if rate == target:
        return np.asarray(samples, dtype=np.float64)
    shared = gcd(rate, target)
    up, down = target // shared, rate // shared
    taps = _low_pass(up, down)
    half = len(taps) // 2
    reach = half // up + 1
    n_out = -(-len(samples) * up // down)
    padded = np.concatenate([np.zeros(reach), np.asarray(samples, dtype=np.float64), np.zeros(reach + 1)])
    wide_taps = np.concatenate([np.zeros(up * 2), taps, np.zeros(up * 2)])
    out = np.empty(n_out)
    neighbours = np.arange(-reach, reach + 1)
    for begin in range(0, n_out, 65536):
        centre = np.arange(begin, min(begin + 65536, n_out), dtype=np.int64) * down
        nearest = centre // up
        tap = centre[:, None] - (nearest[:, None] + neighbours) * up + half + 2 * up
        tap = np.clip(tap, 0, len(wide_taps) - 1)
        out[begin : begin + 65536] = (padded[nearest[:, None] + neighbours + reach] * wide_taps[tap]).sum(axis=1)
    return out


def _mel_to_hz(mel: np.ndarray) -> np.ndarray:
    knee = MEL_BREAK_HZ / MEL_LINEAR_HZ
    return np.where(mel < knee, mel * MEL_LINEAR_HZ, MEL_BREAK_HZ * np.exp(MEL_LOG_STEP * (mel - knee)))


def _hz_to_mel(hz: float) -> float:
    knee = MEL_BREAK_HZ / MEL_LINEAR_HZ
    return hz / MEL_LINEAR_HZ if hz < MEL_BREAK_HZ else knee + np.log(hz / MEL_BREAK_HZ) / MEL_LOG_STEP


def mel_weights(rate: int, n_fft: int, n_mels: int = N_MELS) -> np.ndarray:
    """Area-normalised triangles on the Slaney scale: ``n_mels x (n_fft // 2 + 1)``."""
    known = ("mel", rate, n_fft, n_mels)
    if known in _TABLES:
        return _TABLES[known]
    edges = _mel_to_hz(np.linspace(0.0, _hz_to_mel(rate / 2.0), n_mels + 2))
    bins = np.linspace(0.0, rate / 2.0, n_fft // 2 + 1)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rising, falling = (bins - low) / (mid - low), (high - bins) / (high - mid)
    _TABLES[known] = np.clip(np.minimum(rising, falling), 0.0, None) * (2.0 / (high - low))
    return _TABLES[known]


def cosine_basis(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal DCT-II rows."""
    if ("dct", n_out, n_in) in _TABLES:
        return _TABLES["dct", n_out, n_in]
    basis = np.cos(np.pi * np.outer(np.arange(n_out), 2 * np.arange(n_in) + 1) / (2 * n_in))
    basis *= np.sqrt(2.0 / n_in)
    basis[0] /= np.sqrt(2.0)
    _TABLES["dct", n_out, n_in] = basis
    return basis


def power_frames(samples: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """``|STFT|^2`` of centred, zero-padded Hann frames: ``(n_fft // 2 + 1) x frames``."""
    return frame_power(np.pad(np.asarray(samples, dtype=np.float64), n_fft // 2), n_fft, hop, 1 + len(samples) // hop)


def frame_power(padded: np.ndarray, n_fft: int, hop: int, count: int) -> np.ndarray:
    """``|STFT|^2`` of the first ``count`` Hann frames."""
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop][:count]
    hann = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n_fft) / n_fft)
    return np.abs(np.fft.rfft(frames * hann, axis=1).T) ** 2


def mfcc(samples: np.ndarray, rate: int, n_mfcc: int, n_fft: int, hop: int, n_mels: int = N_MELS) -> np.ndarray:
    """``n_mfcc x frames``; decibels are floored ``TOP_DB`` below the loudest cell of the whole file."""
    mel = mel_weights(rate, n_fft, n_mels) @ power_frames(samples, n_fft, hop)
    db = 10.0 * np.log10(np.maximum(mel, POWER_FLOOR))
    return cosine_basis(n_mfcc, n_mels) @ np.maximum(db, db.max() - TOP_DB)


def delta(features: np.ndarray, order: int = 1, width: int = DELTA_WIDTH) -> np.ndarray:
    """``order``-th derivative of a local polynomial fit over ``width`` frames; edges use the end fits."""
    n = features.shape[1]
    if n < width:
        raise ValueError(f"need at least {width} frames for a delta")
    half = width // 2
    offsets = np.arange(-half, half + 1, dtype=np.float64)
    fit = np.linalg.pinv(np.vander(offsets, order + 1, increasing=True))[order] * (1.0 if order == 1 else 2.0)
    windows = np.lib.stride_tricks.sliding_window_view(features, width, axis=1)
    inner = windows @ fit
    # the top derivative of the fitted polynomial is constant, so the edges repeat the end fits
    return np.concatenate(
        [np.repeat(inner[:, :1], half, axis=1), inner, np.repeat(inner[:, -1:], n - half - inner.shape[1], axis=1)], axis=1
    )


def spectral_shape(samples: np.ndarray, rate: int, n_fft: int, hop: int) -> np.ndarray:
    """Centroid, bandwidth and rolloff (Hz) of every frame: ``3 x frames``."""
    magnitude = np.sqrt(power_frames(samples, n_fft, hop))
    hz = np.linspace(0.0, rate / 2.0, n_fft // 2 + 1)[:, None]
    total = magnitude.sum(axis=0)
    share = np.divide(magnitude, total, out=np.zeros_like(magnitude), where=total > 0)
    centroid = (hz * share).sum(axis=0)
    bandwidth = np.sqrt((share * (hz - centroid) ** 2).sum(axis=0))
    reached = np.cumsum(magnitude, axis=0) >= ROLLOFF_SHARE * total
    rolloff = hz[reached.argmax(axis=0), 0]
    return np.vstack([centroid, bandwidth, rolloff])


def correlation_peaks(windows: list[np.ndarray], template: np.ndarray, block: int = 64) -> np.ndarray:
    """Largest absolute normalised correlation of every window over full-overlap lags; 0.0 for silence.

    Windows of one length are transformed together, ``block`` rows at a time.
    """
    template = np.asarray(template, dtype=np.float64)
    m, own = len(template), float(np.square(template).sum())
    scores = np.zeros(len(windows))
    lengths = np.array([len(w) for w in windows])
    if own == 0.0:
        return scores
    for length in np.unique(lengths[lengths >= m]):
        size = 1 << int(length + m - 1).bit_length()
        reference = np.conj(np.fft.rfft(template, size))
        members = np.flatnonzero(lengths == length)
        for begin in range(0, len(members), block):
            rows = members[begin : begin + block]
            audio = np.stack([windows[r] for r in rows]).astype(np.float64)
            lags = np.fft.irfft(np.fft.rfft(audio, size, axis=1) * reference, size, axis=1)[:, : length - m + 1]
            power = np.square(audio).cumsum(axis=1)
            energy = power[:, m - 1 :].copy()
            energy[:, 1:] -= power[:, :-m]
            # squared scores, with the 1e-12 silence limit squared as well
            ratio = np.divide(np.square(lags), energy * own, out=np.zeros_like(lags), where=energy * own > 1e-24)
            scores[rows] = np.sqrt(ratio.max(axis=1))
    return scores


def correlation_peak(audio: np.ndarray, template: np.ndarray) -> float:
    return float(correlation_peaks([np.asarray(audio)], template)[0])


def mix(signal: np.ndarray, noise: np.ndarray, snr_db: float, gain_db: float) -> np.ndarray:
    """Mix at the target SNR, apply the gain, and scale back whatever leaves the int16 range."""
    noise_power = np.mean(noise**2)
    mixed = signal
    if noise_power > 0:
        mixed = fit_int16(signal + np.sqrt(np.mean(signal**2) / (noise_power * 10 ** (snr_db / 10))) * noise)
    return fit_int16(mixed * 10 ** (gain_db / 20))


def fit_int16(samples: np.ndarray) -> np.ndarray:
    top = np.abs(samples).max(initial=0.0)
    return samples * (32767 / top) if top > 32767 else samples


def stretch(samples: np.ndarray, speed: float, n_fft: int = 2048, hop: int = 512) -> np.ndarray:
    """Change duration by ``1 / speed`` at constant pitch (phase vocoder)."""
    hann = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n_fft) / n_fft)
    padded = np.pad(np.asarray(samples, dtype=np.float64), n_fft // 2)
    padded = np.pad(padded, (0, max(0, n_fft - len(padded))))
    spectra = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop] * hann, axis=1)
    spectra = np.vstack([spectra, np.zeros((2, spectra.shape[1]))])
    steps = np.arange(0, len(spectra) - 2, speed)
    expected = 2.0 * np.pi * hop * np.arange(spectra.shape[1]) / n_fft
    phase = np.angle(spectra[0])
    n_out = int(round(len(samples) / speed))
    out = np.zeros(len(steps) * hop + n_fft)
    weight = np.zeros_like(out)
    for i, step in enumerate(steps):
        left, right = spectra[int(step)], spectra[int(step) + 1]
        part = step % 1.0
        frame = np.fft.irfft(((1 - part) * np.abs(left) + part * np.abs(right)) * np.exp(1j * phase), n_fft)
        out[i * hop : i * hop + n_fft] += frame * hann
        weight[i * hop : i * hop + n_fft] += hann**2
        turn = np.angle(right) - np.angle(left) - expected
        phase = phase + expected + turn - 2.0 * np.pi * np.round(turn / (2.0 * np.pi))
    result = (out / np.where(weight > 1e-8, weight, 1.0))[n_fft // 2 : n_fft // 2 + n_out]
    return np.pad(result, (0, n_out - len(result)))


def convolve(samples: np.ndarray, response: np.ndarray) -> np.ndarray:
    """Room response applied to a signal; same length, same peak rule as mixing."""
    size = 1 << int(len(samples) + len(response)).bit_length()
    wet = np.fft.irfft(np.fft.rfft(samples, size) * np.fft.rfft(response, size), size)[: len(samples)]
    return fit_int16(wet)
