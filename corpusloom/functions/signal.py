"""Arrays and audio: norms, windows, levels, alignment, wave files.

Whatever is a fold or a map over an array is a Column expression; the rest are
plain numpy functions to be used in Pandas UDFs.
"""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, added in order."""
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, null where one has no length."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, dot(a, b) / n)


def running_sum(a: Column) -> Column:
    start = F.array().cast("array<double>")
    step = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x.cast("double")))
    return F.aggregate(a, start, step)


def segment_average(values: Column, durations: Column) -> Column:
    """Mean of the values that are not zero in each of consecutive segments; 0 for a segment without any."""
    ends = F.transform(
        F.sequence(F.lit(1), F.size(durations)),
        lambda i: F.aggregate(F.slice(durations, F.lit(1), i), F.lit(0), lambda acc, d: acc + d.cast("int")),
    )

    def mean(end: Column, i: Column) -> Column:
        part = F.filter(F.slice(values, end - F.get(durations, i).cast("int") + 1, F.get(durations, i).cast("int")), lambda v: v != 0)
        total = F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
        return F.when(F.size(part) > 0, total / F.size(part)).otherwise(F.lit(0.0))

    return F.transform(ends, mean)


def length_regulate(values: Column, durations: Column, pace: float = 1.0) -> Column:
    """Every value repeated by its rounded duration over pace."""
    times = F.transform(durations, lambda d: F.floor(d / pace + 0.5).cast("int"))
    return F.flatten(F.zip_with(values, times, lambda v, n: F.array_repeat(v, n)))


def pad(a: Column, size: Column | int, value: float = 0.0) -> Column:
    """Array of a fixed size, filled up or cut."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.slice(F.concat(a, F.array_repeat(F.lit(value).cast("float"), F.greatest(size - F.size(a), F.lit(0)))), F.lit(1), size)


def frame_levels(a: Column, size: int, hop: int) -> Column:
    """Root mean square of frames of `size` values every `hop`; a rest shorter than a frame is left out."""
    last = F.size(a) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(hop)))
    level = lambda s: l2_norm(F.slice(a, s + 1, size)) / np.sqrt(size)
    return F.coalesce(F.transform(starts, level), F.array().cast("array<double>"))


def smooth(a: Column, keep: float) -> Column:
    """Exponential smoothing: the first value, then keep * last + (1 - keep) * value."""
    empty = F.array().cast("array<double>")
    step = lambda acc, x: F.concat(
        acc,
        F.array(
            F.when(F.size(acc) == 0, x.cast("double")).otherwise(
                F.try_element_at(acc, F.lit(-1)) * keep + x.cast("double") * (1 - keep)
            )
        ),
    )
    return F.aggregate(a, empty, step)


def cosine_rate(step: Column, warmup: int, total: int, high: float, low: float) -> Column:
    """Learning rate: linear warm-up, then half a cosine from high to low."""
    done = F.least(F.greatest((step - warmup) / (total - warmup), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, high * (step + 1) / warmup).otherwise(low + 0.5 * (high - low) * (1 + F.cos(np.pi * done)))


def to_pcm16(samples: np.ndarray) -> np.ndarray:
    """Samples in -1 to 1 as 16-bit integers; what lies outside is clipped."""
    return np.round(np.clip(np.asarray(samples, float), -1, 1) * 32767).astype("<i2")


def wav_bytes(samples: np.ndarray, rate: int = 22050) -> bytes:
    """Mono 16-bit wave file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(to_pcm16(samples).tobytes())
    return out.getvalue()


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1 to 1 and the rate of a 16-bit wave file; channels are averaged."""
    with wave.open(io.BytesIO(data)) as f:
        raw = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
        return raw.mean(1) / 32768, f.getframerate()


def wav_header(data: bytes) -> tuple[int, int, int, int]:
    """Frames, rate, channels and bytes of a sample."""
    with wave.open(io.BytesIO(data)) as f:
        return f.getnframes(), f.getframerate(), f.getnchannels(), f.getsampwidth()


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear resampling."""
    n = int(round(len(samples) * target / source))
    return np.interp(np.arange(n) * source / target, np.arange(len(samples)), samples) if len(samples) else samples


def limit_peak(samples: np.ndarray, peak: float = 0.95) -> np.ndarray:
    top = np.abs(samples).max(initial=0)
    return samples * (peak / top) if top > peak else samples


def trim_edges(samples: np.ndarray, relative: float = 0.02, fade: int = 64) -> np.ndarray:
    """Without the ends below a share of the peak, edges faded."""
    loud = np.flatnonzero(np.abs(samples) > relative * np.abs(samples).max(initial=0))
    if not len(loud):
        return samples[:0]
    out = samples[loud[0] : loud[-1] + 1].copy()
    k = min(fade, len(out) // 2)
    ramp = np.linspace(0, 1, k, endpoint=False)
    out[:k] *= ramp
    out[len(out) - k :] *= ramp[::-1]
    return out


def equalise(parts: list[np.ndarray], low: float = 0.5, high: float = 2.0) -> list[np.ndarray]:
    """Bring the level of each part to the median level by a bounded gain."""
    level = [float(np.sqrt(np.mean(p**2))) if len(p) else 0.0 for p in parts]
    loud = [x for x in level if x > 0]
    middle = float(np.median(loud)) if loud else 0.0
    return [p * float(np.clip(middle / x, low, high)) if x > 0 else p for p, x in zip(parts, level, strict=True)]


def pitch(samples: np.ndarray, rate: int, low: float = 60, high: float = 400) -> float:
    """Fundamental frequency by autocorrelation, 0 if there is none."""
    x = np.asarray(samples, float) - np.mean(samples) if len(samples) else np.zeros(1)
    full = np.correlate(x, x, "full")[len(x) - 1 :]
    a, b = int(rate / high), min(int(rate / low), len(full) - 1)
    if b <= a or full[0] <= 0:
        return 0.0
    lag = a + int(np.argmax(full[a:b]))
    return rate / lag if full[lag] > 0.3 * full[0] else 0.0


def spectrum(samples: np.ndarray, size: int = 512, hop: int = 128) -> np.ndarray:
    """Magnitudes of windowed frames."""
    starts = range(0, max(len(samples) - size, 0) + 1, hop)
    frames = np.stack([np.pad(samples[s : s + size], (0, max(0, size - len(samples[s : s + size])))) for s in starts])
    return np.abs(np.fft.rfft(frames * np.hanning(size), axis=1))


def log_spectral_distance(a: np.ndarray, b: np.ndarray) -> float:
    x, y = spectrum(a), spectrum(b)
    n = min(len(x), len(y))
    return float(np.sqrt(np.mean((np.log(x[:n] + 1e-5) - np.log(y[:n] + 1e-5)) ** 2)))


def monotonic_alignment(scores: np.ndarray) -> np.ndarray:
    """Durations of the best monotonic path through scores[frame, token]; every token gets a frame."""
    frames, tokens = scores.shape
    best = np.full((frames, tokens), -np.inf)
    best[0, 0] = scores[0, 0]
    for t in range(1, frames):
        stay = best[t - 1]
        move = np.concatenate([[-np.inf], best[t - 1, :-1]])
        best[t] = np.maximum(stay, move) + scores[t]
    out, k = np.zeros(tokens, int), tokens - 1
    for t in range(frames - 1, -1, -1):
        out[k] += 1
        if t and k and best[t - 1, k - 1] >= best[t - 1, k]:
            k -= 1
    return out


def find_pause(samples: np.ndarray, rate: int, near: float, reach: float = 1.2, least: float = 0.04) -> int | None:
    """Centre of the longest quiet stretch around a time; the threshold rises until one is long enough.

    Levels are those of 10 ms frames against the level that 90 % of them stay below.
    """
    hop = max(1, rate // 100)
    n = len(samples) // hop
    if not n:
        return None
    level = np.sqrt((np.asarray(samples[: n * hop], float).reshape(n, hop) ** 2).mean(1))
    loud = max(float(np.quantile(level, 0.9)), 1e-6)
    a = max(0, int((near - reach) * rate) // hop)
    b = min(n, int(np.ceil((near + reach) * rate)) // hop + 1)
    for share in (0.12, 0.20, 0.30):
        edge = np.diff((level[a:b] < share * loud).astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts):
            k = int(np.argmax(ends - starts))
            if (ends[k] - starts[k]) * hop >= int(least * rate):
                return int((2 * a + starts[k] + ends[k]) / 2 * hop)
    return None


class Continuity:
    """Keeps the level of successive parts together: a bounded gain towards a slowly moving anchor, and gaps."""

    def __init__(self, keep: float = 0.85, low: float = 0.7, high: float = 1.4, gap: int = 0):
        self.keep, self.low, self.high, self.gap, self.anchor = keep, low, high, gap, None

    def push(self, part: np.ndarray) -> np.ndarray:
        level = float(np.sqrt(np.mean(np.asarray(part, float) ** 2))) if len(part) else 0.0
        if self.anchor is None:
            self.anchor = level or None
            return limit_peak(part)
        gain = float(np.clip(self.anchor / level, self.low, self.high)) if level else 1.0
        self.anchor = self.keep * self.anchor + (1 - self.keep) * level * gain
        return np.concatenate([np.zeros(self.gap), limit_peak(part * gain)])


def band_energies(samples: np.ndarray, rate: int, bands: list[tuple[float, float]], size: int = 512) -> np.ndarray:
    """Share of the energy that lies in each frequency band; zeros for silence."""
    power = (spectrum(np.asarray(samples, float), size, size // 4) ** 2).sum(0)
    freq = np.fft.rfftfreq(size, 1 / rate)
    total = power.sum()
    return np.array([power[(freq >= a) & (freq < b)].sum() / total if total > 0 else 0.0 for a, b in bands])


def burst_onset(samples: np.ndarray, rate: int, rise_db: float = 12.0) -> float | None:
    """Time of the first sharp rise of level between neighbouring 5 ms frames, None without one."""
    hop = max(1, rate // 200)
    n = len(samples) // hop
    if n < 2:
        return None
    level = 10 * np.log10((np.asarray(samples[: n * hop], float).reshape(n, hop) ** 2).mean(1) + 1e-10)
    rises = np.flatnonzero(np.diff(level) >= rise_db)
    return float((rises[0] + 1) * hop / rate) if len(rises) else None
