"""Seeded series for the tests, and brute-force answers."""

from __future__ import annotations

import numpy as np
import pandas as pd


def shapes() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    return {
        "noise": rng.normal(size=400) * 50,
        "steps": rng.integers(0, 4, size=500).astype(float),
        "ramp": np.arange(300) + np.tile([0.0, 3.0], 150),
        "down": -np.arange(300) + np.tile([0.0, 3.0], 150),
        "flat": np.r_[0, np.ones(150), 0, 2, 2, 2, 1, np.ones(120), 0.5],
        "saw": np.tile([0, 1, 0.5, 1, 0], 60).astype(float),
        "sine": np.sin(np.arange(500) * 2 * np.pi / 100),
        "const": np.ones(100),
        "short": np.array([1.0, 3.0, 2.0]),
        "one": np.array([1.0]),
        "exact": rng.normal(size=192),
    }


def frame(spark, values: dict[str, np.ndarray] | None = None):
    values = values or shapes()
    parts = [
        pd.DataFrame({"series_id": k, "seq": np.arange(len(v)), "n": len(v), "x": np.asarray(v, float)})
        for k, v in values.items()
    ]
    return spark.createDataFrame(pd.concat(parts))


def by_series(df, *columns: str) -> dict[str, np.ndarray]:
    pdf = df.select("series_id", "seq", *columns).toPandas().sort_values(["series_id", "seq"])
    return {k: g[list(columns)].to_numpy(dtype=float) for k, g in pdf.groupby("series_id")}


def maxima(x):
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                out.append(((i + j) // 2, i, j))
            i = j + 1
        else:
            i += 1
    return out


def spaced(peaks, x, distance):
    keep = dict.fromkeys(peaks, True)
    for a in sorted(peaks, key=lambda q: (x[q], q), reverse=True):
        if keep[a]:
            for b in peaks:
                if b != a and abs(a - b) < distance:
                    keep[b] = False
    return [q for q in peaks if keep[q]]


def prominence(x, p):
    lows = []
    for side in (-1, 1):
        i, low = p, x[p]
        while 0 <= i < len(x) and x[i] <= x[p]:
            low = min(low, x[i])
            i += side
        lows.append(low)
    return x[p] - max(lows)


def savgol(x, w):
    n, half, mid = len(x), w // 2, (w - 1) / 2
    out = np.empty(n)
    for i in range(n):
        if i < half:
            start, at = 0, i - mid
        elif i >= n - half:
            start, at = n - w, i - (n - w) - mid
        else:
            start, at = i - (w - 1) // 2, 0.0
        out[i] = np.polyval(np.polyfit(np.arange(w) - mid, x[start : start + w], 2), at)
    return out


def spline(y, m):
    n = len(y)
    a, r = np.zeros((n, n)), np.zeros(n)
    a[0, :3] = a[-1, -3:] = [1, -2, 1]
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = [1, 4, 1]
        r[i] = 6 * (y[i + 1] - 2 * y[i] + y[i - 1])
    s = np.linalg.solve(a, r)
    p = np.arange(m) * (n - 1) / (m - 1)
    c = np.minimum(p.astype(int), n - 2)
    t = p - c
    return (1 - t) * y[c] + t * y[c + 1] + (((1 - t) ** 3 - (1 - t)) * s[c] + (t**3 - t) * s[c + 1]) / 6
