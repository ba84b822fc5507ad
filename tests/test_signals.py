"""Rhythm, tempogram, level and production features against plain loops over the definitions."""

import math

import numpy as np
import pandas as pd
import pytest

from taxolens.functions import signal
from taxolens.operators import audio, frames

RATE = 86.0


def envelope(n=600, seed=1):
    rng = np.random.default_rng(seed)
    return np.maximum(0, np.cos(2 * np.pi * np.arange(n) / 40)) ** 8 + 0.4 * np.maximum(0, np.cos(2 * np.pi * np.arange(n) / 27)) ** 6 + 0.05 * rng.random(n)


def lagged(x, lag):
    return sum(x[i] * x[i + lag] for i in range(len(x) - lag))


def plain_peaks(x):
    """Places higher than both sides; for a flat top its middle."""
    out, i = [], 1
    while i < len(x) - 1:
        if x[i] > x[i - 1]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


def test_peaks_with_flat_tops():
    for x in ([0, 1, 0], [0, 1, 1, 0], [0, 1, 1, 2, 0], [1, 1, 0, 2], [0, 3, 3, 3, 1, 2, 1], [5], [], [1, 2], [2, 2, 2]):
        assert signal.peaks(np.array(x, float)).tolist() == plain_peaks(x), x


def test_tempo_histogram_and_danceability():
    env = envelope()
    r = [lagged(env, k) / (lagged(env, 0) + 1e-10) for k in range(len(env))]
    first, last = round(60 / 250 * RATE), round(60 / 40 * RATE)
    part, bpm = r[first : last + 1], [60 * RATE / k for k in range(first, last + 1)]
    top = sorted(plain_peaks(part), key=lambda i: -part[i])
    left = right = top[1]
    while left > 0 and part[left] > part[top[1]] / 2:
        left -= 1
    while right < len(part) - 1 and part[right] > part[top[1]] / 2:
        right += 1
    lo, hi = round(60 / 200 * RATE), round(60 / 60 * RATE)
    dance = [r[lo + i] for i in plain_peaks(r[lo : hi + 1])]
    want = [bpm[top[0]], r[round(60 / bpm[top[0]] * RATE)], bpm[top[0]], bpm[top[0]], part[top[0]], bpm[top[1]], bpm[left] - bpm[right], part[top[1]], sum(dance) / len(dance)]
    assert list(signal.tempo(env, RATE).values()) == pytest.approx(want)
    assert set(signal.tempo(np.zeros(300), RATE).values()) == {0.0} and set(signal.tempo(np.zeros(0), RATE).values()) == {0.0}


def test_beats_loudness_and_bands():
    rng = np.random.default_rng(2)
    env, mag, sr = envelope(200), rng.random((200, 129)), 16_000.0
    mean = env.mean()
    beats = [i for i in plain_peaks(env) if env[i] > mean]
    edges = [20, 150, 400, 1000, 2500, 6300, 8000]
    loud = [math.sqrt(sum(mag[b] ** 2) + 1e-10) for b in beats]
    shares = [[sum(mag[b][k] ** 2 for k in range(129) if lo <= k * sr / 2 / 128 < hi) / (sum(mag[b] ** 2) + 1e-10) for b in beats] for lo, hi in zip(edges, edges[1:])]
    want = [np.mean(loud), np.std(loud), len(beats) / (5 + 1e-10), *[np.mean(s) for s in shares], *[np.std(s) for s in shares]]
    assert list(signal.beat_features(mag, env, sr, RATE, 5.0).values()) == pytest.approx(want)
    assert set(signal.beat_features(mag, np.zeros(200), sr, RATE, 5.0).values()) == {0.0}


def test_tempogram_peaks_and_folds():
    env = envelope(420)
    got = signal.tempogram(env, RATE)
    width, hop = 384, 16
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (width - 1)) for i in range(width)]
    parts = [[env[s + i] * window[i] for i in range(width)] for s in range(0, len(env) - width + 1, hop)]
    fourier = np.array([[abs(sum(p[i] * complex(math.cos(2 * math.pi * i * k / width), -math.sin(2 * math.pi * i * k / width)) for i in range(width))) for p in parts] for k in range(width // 2 + 1)])
    auto = []
    for p in parts:
        c = [v - sum(p) / width for v in p]
        zero = lagged(c, 0)
        auto.append([max(lagged(c, k) / (zero + 1e-10), 0) for k in range(width)])
    auto = np.array(auto).T
    for name, g, bpm in (("fourier", fourier, [k * RATE / width * 60 for k in range(len(fourier))]), ("auto", auto, [math.inf, *[60 * RATE / k for k in range(1, width)]])):
        ok = [k for k in range(len(g)) if 0 < bpm[k] < math.inf]
        top = sorted(ok, key=lambda k: -g[k].mean())[:5]
        assert [got[f"{name}_peak{i + 1}_bpm"] for i in range(5)] == pytest.approx([bpm[k] for k in top])
        assert [got[f"{name}_peak{i + 1}_mean"] for i in range(5)] == pytest.approx([g[k].mean() for k in top])
        assert [got[f"{name}_peak{i + 1}_std"] for i in range(5)] == pytest.approx([g[k].std() for k in top], abs=1e-9)
        folded = np.zeros((120, len(parts)))
        for k in ok:
            octave = math.log2(bpm[k] / 60)
            folded[min(119, int((octave - math.floor(octave)) * 120))] += g[k]
        p = folded.mean(1) / (folded.mean() * 120 + 1e-10)
        best = sorted(range(120), key=lambda b: -p[b])[:5]
        assert [got[f"cyclic_{name}_peak{i + 1}_s"] for i in range(5)] == pytest.approx([1 + b / 120 for b in best])
        assert got[f"cyclic_{name}_entropy"] == pytest.approx(-sum(v * math.log(v) for v in p if v > 0)) and got[f"cyclic_{name}_peak_ratio"] == pytest.approx(p.max() / (p.mean() + 1e-10))


def test_level_and_parts():
    rng = np.random.default_rng(3)
    y = rng.normal(size=500)
    want = []
    for start in range(-32, len(y) + 32 - 64 + 1, 16):
        want.append(math.sqrt(sum(y[i] ** 2 for i in range(start, start + 64) if 0 <= i < len(y)) / 64))
    assert signal.level(y, 64, 16).tolist() == pytest.approx(want)
    mag = rng.random((40, 33))
    harmonic, percussive = signal.parted(mag)

    def mirrored(i, n):
        i %= 2 * n
        return 2 * n - 1 - i if i >= n else i

    for t, k in ((0, 0), (7, 30), (39, 32), (20, 15)):
        h = np.median([mag[mirrored(t + o, 40), k] for o in range(-15, 16)]) ** 2
        p = np.median([mag[t, mirrored(k + o, 33)] for o in range(-15, 16)]) ** 2
        assert harmonic[t, k] == pytest.approx(mag[t, k] * h / (h + p + 1e-10)) and percussive[t, k] == pytest.approx(mag[t, k] * (1 - h / (h + p + 1e-10)))


def test_production_by_the_beat():
    rng = np.random.default_rng(4)
    env, rms, mag, y = envelope(300), 1 + rng.random(300), rng.random((300, 65)), rng.normal(size=4800)
    _, percussive = signal.parted(mag)
    got = signal.production(y, mag, percussive, rms, env, 8000.0, RATE, 129.0)
    beat, w = round(60 / 129 * RATE), round(60 / 129 * 32 * RATE)
    centred = rms - rms.mean()
    assert got["beat_regularity"] == pytest.approx(lagged(env, beat) / lagged(env, 0)) and got["sidechain_mod_depth"] == pytest.approx(lagged(centred, beat) / lagged(centred, 0))
    assert got["energy_variance_8bar"] == 0.0 and w > 300 and got["rms_mean"] == pytest.approx(rms.mean())
    f = np.linspace(0, 4000, 65)
    assert got["kick_prominence"] == pytest.approx((percussive[:, (f >= 40) & (f <= 100)] ** 2).sum() / (percussive**2).sum())
    still = signal.production(y, mag, percussive, rms, env, 8000.0, RATE, 0.0)
    assert still["sidechain_mod_depth"] == still["sidechain_mod_rate"] == still["beat_regularity"] == 0.0


def test_rolloff_where_the_running_sum_equals_the_share(spark):
    """Ten repeats of a series: nine of them hold exactly 0.9, whatever the rounding of the sums."""
    rng = np.random.default_rng(5)
    rows = []
    for key in range(40):
        own = np.round(rng.uniform(0.01, 90, 7 + key), 2)
        rows += [(key, i, float(x)) for i, x in enumerate(np.tile(own, 10))]
    got = dict(frames.rolloff(spark.createDataFrame(rows, "key int, i int, m double"), "key").collect())
    assert got == {key: 9 * (7 + key) - 1 for key in range(40)}


def test_a_task_holds_the_features_of_few_tracks(spark, monkeypatch):
    """1,000 tracks in one task leave in batches of TRACKS at most; none is lost, and the session's bytes a batch are bounded."""
    monkeypatch.setattr(audio, "TRACKS", 7)
    monkeypatch.setattr(signal, "extract", lambda y, sr: {"n": float(len(y))})
    sent = []

    class Tracks:
        schema = {"id": type("field", (), {"dataType": type("kind", (), {"simpleString": lambda self: "bigint"})()})()}
        sparkSession = spark
        select = lambda self, *c: self

        def mapInPandas(self, run, shape):
            every = pd.DataFrame({"id": range(1000), "y": [np.ones(i % 9) for i in range(1000)]})
            sent.extend(run(iter([every[:600], every[600:]])))

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    audio.extract(Tracks(), "id", "y")
    assert max(map(len, sent)) <= 7 and pd.concat(sent)["id"].tolist() == list(range(1000))
    assert all(f == {"n": i % 9} for i, f in zip(range(1000), pd.concat(sent)["features"], strict=True))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
