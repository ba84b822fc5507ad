"""Spectral kernels over one mono signal, in numpy: frames in, named features out.

Everything works from one short-time spectrum that is computed once; mel filters,
chroma and tempograms are written out here, as no audio library is assumed.
"""

from __future__ import annotations

import numpy as np

TINY = 1e-10
#: Decibels below a frame's peak that count, and width of the medians that part a spectrum.
DECIBELS, MEDIAN = 80.0, 31
#: Bands of the production features and of beat loudness, in Hz.
BANDS = {"low": (20.0, 250.0), "mid": (250.0, 4000.0), "high": (4000.0, 20000.0)}
BEAT_BANDS = (20.0, 150.0, 400.0, 1000.0, 2500.0, 6300.0, 22050.0)


def frames(y: np.ndarray, width: int, hop: int) -> np.ndarray:
    if len(y) < width:
        y = np.pad(y, (0, width - len(y)))
    n = 1 + (len(y) - width) // hop
    return y[np.arange(width)[None, :] + hop * np.arange(n)[:, None]]


def resampled(y: np.ndarray, sr: float, to: float, seconds: float | None = None) -> np.ndarray:
    """The first `seconds` of a signal at another rate, by straight lines between samples; frequencies beyond to / 2 are cut before."""
    y = np.asarray(y, float)[: int(seconds * sr) if seconds else None]
    if not len(y) or sr == to:
        return y
    if to < sr:
        wave = np.fft.rfft(y)
        wave[np.fft.rfftfreq(len(y), 1 / sr) > to / 2] = 0
        y = np.fft.irfft(wave, len(y))
    n = max(1, int(round(len(y) * to / sr)))
    return np.interp(np.arange(n) * sr / to, np.arange(len(y)), y)


def spectrum(y: np.ndarray, width: int, hop: int) -> np.ndarray:
    return np.abs(np.fft.rfft(frames(y, width, hop) * np.hamming(width), axis=1)) / width


def entropy(share: np.ndarray, parts: int = 10) -> np.ndarray:
    """Bits over the sums of `parts` equal pieces of each row of shares; what is left of the row beyond them has no piece."""
    w = share.shape[1] // parts
    if not w:
        return np.zeros(len(share))
    p = share[:, : w * parts].reshape(len(share), parts, w).sum(2)
    return -(np.where(p > 0, p * np.log2(p + TINY), 0)).sum(1)


def mel_filters(sr: float, bins: int, n: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(sr / 2), n + 2) / 2595) - 1)
    f = np.linspace(0, sr / 2, bins)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0, None)


def cosine_transform(x: np.ndarray, n: int) -> np.ndarray:
    size = x.shape[1]
    k = np.arange(n)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(size) + 1) / (2 * size)) * np.sqrt(2 / size)
    basis[0] /= np.sqrt(2)
    return x @ basis.T


def short_term(y: np.ndarray, sr: float, width: int, hop: int) -> dict[str, np.ndarray]:
    """34 series, one number a frame each."""
    raw = frames(y, width, hop)
    mag = np.abs(np.fft.rfft(raw * np.hamming(width), axis=1))
    mag = mag / (mag.shape[1] + TINY)
    f = np.fft.rfftfreq(width, 1 / sr)
    total = mag.sum(1)
    safe = np.where(total > 0, total, 1)
    mean = np.where(total > 0, (mag * f).sum(1) / safe, 0)
    spread = np.where(total > 0, np.sqrt(np.maximum((mag * (f - mean[:, None]) ** 2).sum(1) / safe, 0)), 0)
    p = mag / (total[:, None] + TINY)
    before = np.vstack([np.zeros_like(p[:1]), p[:-1]])
    energy, run = raw**2, mag.cumsum(1)
    out = {
        "ZCR": np.abs(np.diff(np.sign(raw), axis=1)).sum(1) / (2 * width),
        "Energy": energy.sum(1) / width,
        "EnergyEntropy": entropy(energy / (energy.sum(1, keepdims=True) + TINY)),
        "SpectralCentroid": mean / (sr / 2),
        "SpectralSpread": spread / (sr / 2),
        "SpectralEntropy": entropy(mag / safe[:, None]),
        "SpectralFlux": ((p - before) ** 2).sum(1),
        "SpectralRolloff": (run >= 0.9 * run[:, -1:]).argmax(1) / mag.shape[1],
    }
    power = mag**2
    mel = power @ mel_filters(sr, mag.shape[1], 26).T
    db = 10 * np.log10(np.maximum(mel, TINY) / np.maximum(mel.max(1, keepdims=True), TINY))
    coefficients = cosine_transform(np.maximum(db, db.max(1, keepdims=True) - DECIBELS), 13)
    out |= {f"MFCCs{i + 1}": coefficients[:, i] for i in range(13)}
    with np.errstate(divide="ignore"):
        pitch = np.where(f > 20, np.round(12 * np.log2(np.maximum(f, 1e-9) / 440)) % 12, -1).astype(int)
    chroma = np.stack([power[:, pitch == c].sum(1) for c in range(12)], 1)
    most = chroma.max(1, keepdims=True)
    chroma = np.where(most > 0, chroma / np.where(most > 0, most, 1), 0)
    out |= {f"ChromaVector{i + 1}": chroma[:, i] for i in range(12)}
    out["ChromaDeviation"] = chroma.std(1)
    return out


def autocorrelation(x: np.ndarray, centred: bool = True) -> np.ndarray:
    """Over lags from 0, by a transform of twice the length; 1 at lag 0."""
    x = x - x.mean() if len(x) and centred else x
    n = 1 << int(2 * max(len(x), 1) - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2)[: len(x)]
    return r / (r[0] + TINY) if len(r) else r


def onset_envelope(mag: np.ndarray) -> np.ndarray:
    db = 20 * np.log10(np.maximum(mag, TINY))
    rise = np.maximum(np.diff(db, axis=0, prepend=db[:1]), 0)
    return rise.mean(1)


def peaks(x: np.ndarray, least: float = -np.inf) -> np.ndarray:
    """Places that are higher than what is on both sides, the middle of flat tops, at `least` or above."""
    if len(x) < 3:
        return np.zeros(0, int)
    begin = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    end = np.append(begin[1:], len(x)) - 1
    level = x[begin]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    at = (begin[top] + end[top]) // 2
    return at[x[at] >= least]


def _lags(n: int, rate: float, low: float, high: float) -> tuple[int, int]:
    """First and last lag of the tempi from low to high."""
    return max(1, int(round(60 / high * rate))), min(int(round(60 / low * rate)), n - 1)


def tempo(env: np.ndarray, rate: float, low: float = 40.0, high: float = 250.0) -> dict[str, float]:
    """Tempo, its confidence, danceability, and the two tallest peaks of the tempo histogram (the onset envelope's autocorrelation).

    The tempo is that of the tallest peak, a stand-in for a library's estimate.
    """
    names = ("69-BPM", "70-BPMconf", "71-bpm", "72-bpm_histogram_first_peak_bpm", "73-bpm_histogram_first_peak_weight", "74-bpm_histogram_second_peak_bpm", "75-bpm_histogram_second_peak_spread", "76-bpm_histogram_second_peak_weight", "77-danceability")
    out = dict.fromkeys(names, 0.0)
    r = autocorrelation(env, centred=False)
    if not len(r) or r[0] <= 0:
        return out
    first, last = _lags(len(r), rate, 60, 200)
    last = min(last, len(r) // 2 - 1)
    if last > first:
        part = r[first : last + 1]
        at = peaks(part, 0)
        out["77-danceability"] = float(part[at].mean() if len(at) else part.max())
    first, last = _lags(len(r), rate, low, high)
    if last <= first:
        return out
    h, bpm = r[first : last + 1], 60 * rate / np.arange(first, last + 1)
    at = peaks(h, 0)
    order = at[np.argsort(-h[at], kind="stable")] if len(at) else np.array([int(h.argmax())])
    top = order[0]
    beat = int(round(60 / bpm[top] * rate))
    out |= {"69-BPM": float(bpm[top]), "70-BPMconf": float(r[beat]) if 0 < beat < len(r) else 0.0, "71-bpm": float(bpm[top]), names[3]: float(bpm[top]), names[4]: float(h[top])}
    if len(at) > 1:
        second = order[1]
        low_side = np.flatnonzero(h[: second + 1] <= h[second] / 2)
        high_side = np.flatnonzero(h[second:] <= h[second] / 2)
        left, right = (low_side[-1] if len(low_side) else 0), (second + high_side[0] if len(high_side) else len(h) - 1)
        out |= {names[5]: float(bpm[second]), names[6]: float(bpm[left] - bpm[right]) if right > left else 0.0, names[7]: float(h[second])}
    return out


def beat_features(mag: np.ndarray, env: np.ndarray, sr: float, rate: float, seconds: float) -> dict[str, float]:
    """Loudness at the beats and its shares in six bands; beats are the envelope's peaks above its mean, a stand-in for a library's tracker."""
    at = peaks(env)
    at = at[env[at] > env.mean()] if len(at) else at
    f = np.linspace(0, sr / 2, mag.shape[1])
    edges = [*BEAT_BANDS[:-1], min(BEAT_BANDS[-1], int(sr) // 2)]
    power = mag[at] ** 2 if len(at) else np.zeros((1, mag.shape[1]))
    total = power.sum(1, keepdims=True) + TINY * bool(len(at))
    share = np.stack([power[:, (f >= lo) & (f < hi)].sum(1) for lo, hi in zip(edges, edges[1:])], 1) / np.where(total > 0, total, 1)
    loud = np.sqrt(total[:, 0])
    out = {"78-beats_loudness.mean": loud.mean(), "79-beats_loudness.stdev": loud.std(), "80-onset_rate": len(at) / (seconds + TINY)}
    out |= {f"{81 + i}-beats_loudness_band_ratio.mean{i + 1}": share[:, i].mean() for i in range(6)}
    out |= {f"{87 + i}-beats_loudness_band_ratio.stdev{i + 1}": share[:, i].std() for i in range(6)}
    return {k: float(v) for k, v in out.items()}


def cyclic(profile: np.ndarray, bpm: np.ndarray, bins: int = 120) -> np.ndarray:
    ok = np.isfinite(bpm) & (bpm > 0)
    octave = np.log2(bpm[ok] / 60)
    out = np.zeros((bins, *profile.shape[1:]))
    np.add.at(out, np.minimum((octave - np.floor(octave)) * bins, bins - 1).astype(int), profile[ok])
    return out


def tempogram(env: np.ndarray, rate: float, width: int = 384, hop: int = 16) -> dict[str, float]:
    """64 features: five strongest tempi of the Fourier and the autocorrelation tempogram, and of both folded by octaves."""
    w = min(width, max(len(env), 4))
    part = frames(env, w, hop) * np.hanning(w)
    fourier = np.abs(np.fft.rfft(part, axis=1)).T
    auto = np.maximum(np.stack([autocorrelation(p) for p in part], 1), 0)
    lags = np.arange(len(auto))
    axes = {"fourier": (fourier, np.fft.rfftfreq(w, 1 / rate) * 60), "auto": (auto, np.where(lags > 0, 60 * rate / np.maximum(lags, 1), np.inf))}
    out: dict[str, float] = {}
    for name, (g, bpm) in axes.items():
        ok = np.flatnonzero(np.isfinite(bpm) & (bpm > 0))
        for i in range(5):
            top = ok[np.argsort(-g[ok].mean(1), kind="stable")]
            j = top[i] if i < len(top) else None
            out |= {f"{name}_peak{i + 1}_bpm": float(bpm[j]) if j is not None else 0.0, f"{name}_peak{i + 1}_mean": float(g[j].mean()) if j is not None else 0.0, f"{name}_peak{i + 1}_std": float(g[j].std()) if j is not None else 0.0}
        c = cyclic(g, bpm)
        p = c.mean(1) / (c.mean(1).sum() + TINY)
        top = np.argsort(-p, kind="stable")[:5]
        for i, j in enumerate(top):
            out |= {f"cyclic_{name}_peak{i + 1}_s": 1 + j / 120, f"cyclic_{name}_peak{i + 1}_mean": float(c[j].mean()), f"cyclic_{name}_peak{i + 1}_std": float(c[j].std())}
        out |= {f"cyclic_{name}_entropy": float(-(p[p > 0] * np.log(p[p > 0])).sum()), f"cyclic_{name}_peak_ratio": float(p.max() / (p.mean() + TINY))}
    return out


def texture(mag: np.ndarray, sr: float) -> dict[str, float]:
    """Contrast of seven octave bands from 50 Hz, flatness and bandwidth: mean and deviation."""
    f = np.linspace(0, sr / 2, mag.shape[1])
    edges = [0.0, *[50.0 * 2**i for i in range(6)], sr / 2]
    out: dict[str, float] = {}
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = np.sort(mag[:, (f >= lo) & (f < hi)], 1)
        k = max(1, round(0.02 * part.shape[1])) if part.shape[1] else 0
        c = 10 * np.log10((part[:, -k:].mean(1) + TINY) / (part[:, :k].mean(1) + TINY)) if k else np.zeros(len(mag))
        out |= {f"spectral_contrast_band{i + 1}_mean": float(c.mean()), f"spectral_contrast_band{i + 1}_std": float(c.std())}
    power = np.maximum(mag**2, TINY)
    flat = np.exp(np.log(power).mean(1)) / power.mean(1)
    share = mag / (mag.sum(1, keepdims=True) + TINY)
    centre = (share * f).sum(1, keepdims=True)
    width = np.sqrt((share * (f - centre) ** 2).sum(1))
    return out | {"spectral_flatness_mean": float(flat.mean()), "spectral_flatness_std": float(flat.std()), "spectral_bandwidth_mean": float(width.mean()), "spectral_bandwidth_std": float(width.std())}


def level(y: np.ndarray, width: int, hop: int) -> np.ndarray:
    """Root mean square of the samples of each frame; frames are centred, with zeros beyond the ends."""
    return np.sqrt((frames(np.pad(y, width // 2), width, hop) ** 2).mean(1))


def parted(mag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Harmonic and percussive parts of a spectrum: soft masks of medians of 31 along time and along frequency, mirrored at the edges."""
    def median(a: np.ndarray, axis: int) -> np.ndarray:
        half = MEDIAN // 2
        view = np.lib.stride_tricks.sliding_window_view(np.pad(a, [(half, half) if i == axis else (0, 0) for i in (0, 1)], mode="symmetric"), MEDIAN, axis)
        step = max(1, 2_000_000 // (MEDIAN * a.shape[1]))
        return np.concatenate([np.median(view[lo : lo + step], -1) for lo in range(0, len(view), step)])

    h, p = median(mag, 0) ** 2, median(mag, 1) ** 2
    soft = h / (h + p + TINY)
    return mag * soft, mag * (1 - soft)


def production(y: np.ndarray, mag: np.ndarray, percussive: np.ndarray, rms: np.ndarray, env: np.ndarray, sr: float, rate: float, bpm: float) -> dict[str, float]:
    """15 features of bass, bands, modulation, regularity and level. percussive: that part of mag; rms: see level."""
    f = np.linspace(0, sr / 2, mag.shape[1])

    def share(m: np.ndarray, lo: float, hi: float, closed: bool) -> float:
        return float((m[:, (f >= lo) & ((f <= hi) if closed else (f < hi))] ** 2).sum() / ((m**2).sum() + TINY))

    beat = int(round(60 / bpm * rate)) if bpm > 0 else 0
    at_beat = lambda r: float(r[beat]) if 0 < beat < len(r) else 0.0
    w = max(1, int(round(60 / bpm * 32 * rate))) if bpm > 0 else 0
    means = rms[: len(rms) // w * w].reshape(-1, w).mean(1) if w and len(rms) >= w else np.zeros(0)
    centre = (mag * f).sum(1) / (mag.sum(1) + TINY)
    wave = np.abs(np.fft.rfft(centre - centre.mean())) if len(centre) else np.zeros(1)
    speed = np.fft.rfftfreq(max(len(centre), 1), 1 / rate)
    lfo = np.flatnonzero((speed >= 0.5) & (speed <= 20))
    top = lfo[wave[lfo].argmax()] if len(lfo) else None
    hits = peaks(onset_envelope(percussive))
    sd, pumped = rms.std(), bpm > 0 and len(rms) > 1
    return {
        "sub_bass_ratio": share(mag, 20, 60, True), "beat_regularity": at_beat(autocorrelation(env, centred=False)), "energy_variance_8bar": float(means.var()) if len(means) > 1 else 0.0,
        "spectral_mod_rate": float(speed[top]) if top is not None else 0.0, "spectral_mod_strength": float(wave[top] / (wave.sum() + TINY)) if top is not None else 0.0,
        "energy_ratio_low": share(mag, *BANDS["low"], False), "energy_ratio_mid": share(mag, *BANDS["mid"], False), "energy_ratio_high": share(mag, *BANDS["high"], True),
        "percussive_onset_density": len(hits) / (len(y) / sr + TINY), "kick_prominence": share(percussive, 40, 100, True),
        "sidechain_mod_depth": at_beat(autocorrelation(rms)) if pumped else 0.0, "sidechain_mod_rate": float(sd / (rms.mean() + TINY)) if pumped else 0.0,
        "rms_mean": float(rms.mean()), "rms_std": float(sd), "rms_skew": float(((rms - rms.mean()) ** 3).mean() / sd**3) if sd > 0 else 0.0,
    }


def harmonic_dynamic(y: np.ndarray, harmonic: np.ndarray, percussive: np.ndarray, rms: np.ndarray) -> dict[str, float]:
    """Harmonic against percussive level of each frame, and the level's shape."""
    rh, rp = np.sqrt((harmonic**2).mean(1)), np.sqrt((percussive**2).mean(1))
    ratio = rh / (rp + TINY)
    sd = rms.std()
    peak, whole = np.abs(y).max() if len(y) else 0.0, np.sqrt((y**2).mean()) if len(y) else 0.0
    return {"hp_ratio_mean": float(ratio.mean()), "hp_ratio_std": float(ratio.std()), "dynamic_range_db": float(20 * np.log10((peak + TINY) / (whole + TINY))), "rms_kurtosis": float(((rms - rms.mean()) ** 4).mean() / sd**4 - 3) if sd > 0 else 0.0, "crest_factor": float(peak / (whole + TINY))}


def extract(y: np.ndarray, sr: float = 44100.0, hop: int = 512) -> dict[str, float]:
    """All 194 features of one signal."""
    y = np.nan_to_num(np.asarray(y, float), posinf=0.0, neginf=0.0)
    if not len(y):
        y = np.zeros(1)
    width = max(int(round(0.05 * sr)), 16)
    out: dict[str, float] = {}
    series = short_term(y, sr, width, width)
    for part, (offset, suffix) in {"mean": (1, "m"), "std": (35, "std")}.items():
        out |= {f"{offset + i}-{n}{suffix}": float(getattr(v, part)()) for i, (n, v) in enumerate(series.items())}
    big = 2048 if len(y) >= 2048 else max(16, len(y))
    step = min(hop, max(big // 4, 1))
    mag, rate, rms = spectrum(y, big, step), sr / step, level(y, big, step)
    env, (harmonic, percussive) = onset_envelope(mag), parted(mag)
    beats = tempo(env, rate)
    out |= beats | beat_features(mag, env, sr, rate, len(y) / sr) | tempogram(env, rate) | texture(mag, sr)
    return out | production(y, mag, percussive, rms, env, sr, rate, beats["69-BPM"]) | harmonic_dynamic(y, harmonic, percussive, rms)
