"""Signal functions over arrays of samples, in Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

RATE = 16000
N_FFT, WIN, HOP, MELS, LOW, HIGH = 512, 400, 160, 40, 80.0, 8000.0


def mel_matrix(rate: int = RATE, bins: int = N_FFT // 2 + 1) -> np.ndarray:
    """Triangles evenly spaced in mels from LOW to HIGH."""
    mel = lambda f: 1127.0 * np.log1p(np.asarray(f) / 700.0)
    edges = np.linspace(mel(LOW), mel(HIGH), MELS + 2)
    at = mel(np.linspace(0, rate / 2, bins))[:, None]
    up, down = (at - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - at) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


def mel_frames(samples: np.ndarray, log: bool = False) -> np.ndarray:
    """(frames, MELS) power mel spectrogram."""
    if len(samples) < WIN:
        return np.zeros((0, MELS))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, float), WIN)[::HOP]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WIN) / WIN)
    power = np.abs(np.fft.rfft(frames * window, N_FFT)) ** 2 @ mel_matrix()
    return np.log10(power + 1e-7) if log else power


def correlation_peak(chunk: np.ndarray, word: np.ndarray, clamp: float | None = 100.0) -> tuple[int, float | None]:
    """Place of the 'same' cross-correlation's peak, and its share of the energies in percent. The
    energy is of the slice that starts at the place, so it may be over 100; null on silence."""
    if not len(chunk) or not len(word):
        return 0, None
    full = np.correlate(chunk, word, "same")
    at = int(np.argmax(full))
    cut = chunk[at : at + len(word)]
    energy = float(np.sqrt((cut**2).sum() * (word**2).sum()))
    if energy == 0 or not np.isfinite(energy):
        return at, None
    percent = float(full[at]) / energy * 100
    return at, min(percent, clamp) if clamp is not None else percent


def impulse_response(seed: int, rt60: float = 0.3, rate: int = RATE) -> np.ndarray:
    """Noise that decays by 60 dB over rt60, with a direct first sample, at unit peak."""
    n = max(1, int(rt60 * rate))
    r = np.random.default_rng(seed).standard_normal(n) * np.exp(-6.908 * np.arange(n) / n)
    r[0] = 1.0
    return r / np.abs(r).max()


def stretched(samples: np.ndarray, rate: float, n_fft: int = 1024) -> np.ndarray:
    """Sound at ``rate`` times the speed and the same pitch, by a phase vocoder."""
    x = np.asarray(samples, float)
    hop = n_fft // 4
    if len(x) < n_fft:
        return x if rate == 1 else np.interp(np.linspace(0, max(len(x) - 1, 0), max(1, int(len(x) / rate))), np.arange(len(x)), x)
    window = np.hanning(n_fft + 1)[:-1]
    spectra = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, n_fft)), n_fft)[::hop] * window)
    steps = np.arange(0, len(spectra) - 1, rate)
    advance = 2 * np.pi * hop * np.arange(spectra.shape[1]) / n_fft
    phase = np.angle(spectra[0])
    out, weight = np.zeros(len(steps) * hop + n_fft), np.full(len(steps) * hop + n_fft, 1e-8)
    for k, step in enumerate(steps):
        a, b = spectra[int(step)], spectra[int(step) + 1]
        size = (1 - step % 1) * np.abs(a) + (step % 1) * np.abs(b)
        out[k * hop : k * hop + n_fft] += window * np.fft.irfft(size * np.exp(1j * phase), n_fft)
        weight[k * hop : k * hop + n_fft] += window**2
        turn = np.angle(b) - np.angle(a) - advance
        phase = phase + advance + turn - 2 * np.pi * np.round(turn / (2 * np.pi))
    return (out / weight)[: max(1, int(len(x) / rate))]


def pitched(samples: np.ndarray, semitones: float) -> np.ndarray:
    """Sound of the same length, higher by so many semitones."""
    x, factor = np.asarray(samples, float), 2.0 ** (semitones / 12)
    longer = stretched(x, 1 / factor)
    return np.interp(np.linspace(0, len(longer) - 1, len(x)), np.arange(len(longer)), longer) if len(x) else x


def augmented(samples: np.ndarray, seed: int, rate: int = RATE) -> np.ndarray:
    """Pitch, tempo, reverberation and low pass by chance, then noise at 5 to 25 dB, peak 0.95; by seed."""
    rng = np.random.default_rng(seed)
    x = np.asarray(samples, float)
    if not len(x):
        return x
    if rng.random() < 0.5:
        x = pitched(x, rng.uniform(-1.5, 1.5))
    if rng.random() < 0.5:
        x = stretched(x, rng.uniform(0.88, 1.12))
    if rng.random() < 0.5:
        wet, mix = np.convolve(x, impulse_response(int(rng.integers(1 << 30))))[: len(x)], rng.uniform(0.2, 0.5)
        x = (1 - mix) * x + mix * wet
    if rng.random() < 0.3:
        spectrum = np.fft.rfft(x)
        spectrum[np.fft.rfftfreq(len(x), 1 / rate) > rng.uniform(2500, 6000)] = 0
        x = np.fft.irfft(spectrum, len(x))
    x = x + rng.standard_normal(len(x)) * np.sqrt((x**2).mean() / 10 ** (rng.uniform(5, 25) / 10))
    return 0.95 * x / max(np.abs(x).max(), 1e-9)


def trimmed(samples: np.ndarray, top_db: float = 30.0, frame: int = 2048, hop: int = 512) -> np.ndarray:
    """Without leading and trailing frames that are ``top_db`` under the loudest."""
    x = np.asarray(samples, float)
    if not len(x):
        return x
    starts = np.arange(0, len(x), hop)
    level = np.array([np.sqrt((x[max(0, s - frame // 2) : s + frame // 2] ** 2).mean()) for s in starts])
    loud = np.flatnonzero(level > level.max() * 10 ** (-top_db / 20)) if level.max() > 0 else []
    return x[loud[0] * hop : min(len(x), (loud[-1] + 1) * hop)] if len(loud) else x[:0]


def mel_spectrogram(samples, log: bool = False):
    """struct<frames, voiced>: the mel spectrogram, of logarithms where ``log``, and which frames are not
    all silence; null for null."""

    @F.pandas_udf("frames array<array<double>>, voiced array<boolean>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sounds in parts:
            power = [None if s is None else mel_frames(s) for s in sounds]
            frames = [None if p is None else (np.log10(p + 1e-7) if log else p).tolist() for p in power]
            yield pd.DataFrame({"frames": frames, "voiced": [None if p is None else (p != 0).any(axis=1).tolist() for p in power]})

    return run(samples)


class Correlator:
    """Cross-correlations of long sounds with many short ones, by overlap and save: the spectra of all words
    are made once for a block size, a sound is cut into overlapping blocks, and each block's spectrum serves
    all words. Places within rounding of a peak are multiplied out, so the first of equal peaks is found as
    ``correlation_peak`` finds it."""

    def __init__(self, words: list[np.ndarray]) -> None:
        self.words = [np.asarray(w, float) for w in words]
        self.longest = max([len(w) for w in self.words], default=0)
        self.block = max(1024, 1 << (4 * self.longest - 1).bit_length()) if self.longest else 0
        self.spectra = np.array([np.fft.rfft(w[::-1], self.block) for w in self.words if len(w)])
        self.energies = [float((w**2).sum()) for w in self.words]

    def _full(self, sound: np.ndarray) -> np.ndarray:
        """A row for each word that has samples: sums of products from the first overlap on."""
        hop, n = self.block - self.longest + 1, len(sound) + self.longest - 1
        blocks = -(-n // hop)
        padded = np.zeros(self.longest - 1 + blocks * hop)
        padded[self.longest - 1 : self.longest - 1 + len(sound)] = sound
        cut = np.lib.stride_tricks.sliding_window_view(padded, self.block)[::hop] if len(padded) >= self.block else padded[None, :]
        out = np.empty((len(self.spectra), blocks * hop))
        for b, part in enumerate(cut):
            out[:, b * hop : (b + 1) * hop] = np.fft.irfft(np.fft.rfft(part, self.block) * self.spectra, self.block)[:, self.longest - 1 : self.longest - 1 + hop]
        return out[:, :n]

    def peaks(self, sound: np.ndarray, clamp: float | None = 100.0) -> list[tuple[int, float | None]]:
        """(place, percent) for each word."""
        sound, found = np.asarray(sound, float), []
        full = iter(self._full(sound) if len(sound) and len(self.spectra) else [])
        for word, energy in zip(self.words, self.energies, strict=True):
            if not len(word) or not len(sound):
                found.append((0, None))
                continue
            first = (len(word) - 1) // 2 if len(word) <= len(sound) else len(sound) // 2
            same = next(full)[first : first + max(len(word), len(sound))]
            near = np.flatnonzero(same >= same.max() - 1e-9 * max(np.sqrt(energy * float((sound**2).sum())), 1e-300))
            exact = [self._product(sound, word, int(k) + first - len(word) + 1) for k in near]
            best = int(np.argmax(exact))
            at = int(near[best])
            norm = float(np.sqrt(float((sound[at : at + len(word)] ** 2).sum()) * energy))
            percent = exact[best] / norm * 100 if norm and np.isfinite(norm) else None
            found.append((at, percent if percent is None or clamp is None else min(percent, clamp)))
        return found

    @staticmethod
    def _product(sound: np.ndarray, word: np.ndarray, lag: int) -> float:
        a, b = max(lag, 0), min(lag + len(word), len(sound))
        return float(sound[a:b] @ word[a - lag : b - lag]) if a < b else 0.0


#: Samples of all keywords together at most: what each worker holds with its spectra.
MOST_SAMPLES = 4_000_000


def keyword_in_chunks(chunks: DataFrame, keywords: DataFrame, threshold: float = 70.0) -> DataFrame:
    """(chunk columns, keyword, at, percent) where a keyword's sound correlates by more than ``threshold``
    percent. ``keywords`` (keyword, word) is a stated set, of ``MOST_SAMPLES`` samples at most, that every worker
    gets once; chunks (samples) stay where they are, and no row is a pair."""
    total = keywords.agg(F.sum(F.size("word"))).first()[0] or 0
    if total > MOST_SAMPLES:
        raise ValueError(f"{total} samples of keywords; {MOST_SAMPLES} may be held at once")
    named = sorted((r["keyword"], r["word"] or []) for r in keywords.select("keyword", "word").collect())
    held = chunks.sparkSession.sparkContext.broadcast([(k, np.asarray(w, np.float32)) for k, w in named])
    others = [c for c in chunks.columns if c != "samples"]
    kinds = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in others)

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        correlator = Correlator([w for _, w in held.value])
        names = [k for k, _ in held.value]
        for batch in batches:
            sounds = batch.column(batch.schema.get_field_index("samples"))
            hits = [(row, k, at, percent) for row, s in enumerate(sounds) if s.is_valid for k, (at, percent) in enumerate(correlator.peaks(s.values.to_numpy(zero_copy_only=False))) if percent is not None and percent > threshold]
            rows = pa.array([h[0] for h in hits], pa.int64())
            columns = [batch.column(batch.schema.get_field_index(c)).take(rows) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([names[h[1]] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.int32()), pa.array([h[3] for h in hits], pa.float64())], names=[*others, "keyword", "at", "percent"])

    return chunks.select(*others, "samples").mapInArrow(correlate, f"{kinds}{', ' if kinds else ''}keyword string, at int, percent double")


@F.pandas_udf(ArrayType(FloatType()))
def augment(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of (samples, seed); take the seed from a hash of the row's key."""
    for sounds, seeds in parts:
        yield pd.Series([augmented(s, int(k) & 0xFFFFFFFF).astype(np.float32) for s, k in zip(sounds, seeds, strict=True)])


@F.pandas_udf(ArrayType(FloatType()))
def trim_silence(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for sounds in parts:
        yield sounds.map(lambda s: trimmed(s).astype(np.float32))
