"""Numeric kernels that no built-in expresses; each works on one bounded group in numpy."""

from __future__ import annotations

import math

import numpy as np

#: Bytes of the distances that are worked out at once.
PIECE_BYTES = 1 << 20


def digamma(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def knn_mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 42) -> float:
    """Ross's estimator for a number and a class, with a tiny seeded jitter; classes of one row are left out."""
    rng = np.random.default_rng(seed)
    scale = max(1.0, float(np.mean(np.abs(x))) if len(x) else 1.0)
    x = x / (x.std() or 1.0) + 1e-10 * scale * rng.standard_normal(len(x))
    kept = np.zeros(len(x), bool)
    radius, ks, sizes = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for label in np.unique(y):
        at = np.flatnonzero(y == label)
        if len(at) < 2:
            continue
        kk = min(k, len(at) - 1)
        s = np.sort(x[at])
        place = np.searchsorted(s, x[at])
        # the k-th neighbour lies among the k values on either side
        lo = np.clip(place[:, None] + np.arange(-kk, kk + 1)[None, :], 0, len(s) - 1)
        d = np.abs(s[lo] - x[at][:, None])
        d[(place[:, None] + np.arange(-kk, kk + 1)[None, :] < 0) | (place[:, None] + np.arange(-kk, kk + 1)[None, :] >= len(s))] = np.inf
        # a little inside the k-th neighbour, so that rounding of x +- radius can't take it in
        radius[at] = np.maximum(np.sort(d, 1)[:, kk] - 1e-14 * (1 + np.abs(x[at])), 0)
        ks[at], sizes[at], kept[at] = kk, len(at), True
    if not kept.any():
        return 0.0
    x, radius, ks, sizes = x[kept], radius[kept], ks[kept], sizes[kept]
    s = np.sort(x)
    near = np.searchsorted(s, x + radius, "right") - np.searchsorted(s, x - radius, "left")
    return max(0.0, float(digamma(len(x)) + digamma(ks).mean() - digamma(sizes).mean() - digamma(np.maximum(near, 1)).mean()))


def yeo_johnson_values(x: np.ndarray, lam: float) -> np.ndarray:
    out = np.empty_like(x, dtype=float)
    up = x >= 0
    out[up] = np.log1p(x[up]) if abs(lam) < 1e-12 else (np.power(x[up] + 1, lam) - 1) / lam
    two = 2 - lam
    out[~up] = -np.log1p(-x[~up]) if abs(two) < 1e-12 else -(np.power(1 - x[~up], two) - 1) / two
    return out


def yeo_johnson_exponent(x: np.ndarray, low: float = -4.0, high: float = 4.0) -> float:
    """The exponent of largest likelihood, by golden section after a coarse scan."""
    x = x[np.isfinite(x)]
    if len(x) < 2 or x.std() == 0:
        return 1.0
    weight = float(np.sum(np.sign(x) * np.log1p(np.abs(x))))

    def loss(lam: float) -> float:
        with np.errstate(all="ignore"):
            v = yeo_johnson_values(x, lam).var()
        return math.inf if not np.isfinite(v) or v <= 0 else len(x) / 2 * math.log(v) - (lam - 1) * weight

    grid = np.linspace(low, high, 33)
    best = int(np.argmin([loss(g) for g in grid]))
    a, b = grid[max(best - 1, 0)], grid[min(best + 1, 32)]
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(c), loss(d)
    while b - a > 1e-7:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = loss(d)
    return float((a + b) / 2)


def linkage(d: np.ndarray, method: str) -> np.ndarray:
    """Agglomeration of a square distance matrix by nearest-neighbour chains: rows (left, right, distance, size).

    method: average or ward (Lance-Williams updates). Ids of merged nodes follow those of the leaves, by
    height.
    """
    n = len(d)
    work = (d.astype(float) ** 2 if method == "ward" else d.astype(float)).copy()
    np.fill_diagonal(work, np.inf)
    size = np.ones(n)
    live = np.ones(n, bool)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            a = chain[-1]
            row = np.where(live, work[a], np.inf)
            row[a] = np.inf
            b = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        b, a = chain.pop(), chain.pop()
        dist = work[a, b]
        merges.append((a, b, math.sqrt(max(dist, 0.0)) if method == "ward" else dist))
        sa, sb = size[a], size[b]
        if method == "average":
            new = (sa * work[a] + sb * work[b]) / (sa + sb)
        else:
            new = ((sa + size) * work[a] + (sb + size) * work[b] - size * dist) / (sa + sb + size)
        live[b] = False
        work[a], work[:, a] = new, new
        work[a, a] = np.inf
        size[a] = sa + sb
    merges.sort(key=lambda m: m[2])
    parent = list(range(n))
    label = list(range(n))
    count = [1] * n

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for k, (a, b, h) in enumerate(merges):
        ra, rb = root(a), root(b)
        la, lb = sorted((label[ra], label[rb]))
        parent[rb] = ra
        count[ra] += count[rb]
        label[ra] = n + k
        out.append((la, lb, h, count[ra]))
    return np.array(out, float).reshape(-1, 4)


def cophenetic(z: np.ndarray, d: np.ndarray) -> float:
    """Correlation of the heights at which leaves meet with their distances."""
    n = len(d)
    members = {i: [i] for i in range(n)}
    meet = np.zeros_like(d, dtype=float)
    for k, (a, b, h, _) in enumerate(z):
        one, two = members.pop(int(a)), members.pop(int(b))
        meet[np.ix_(one, two)] = meet[np.ix_(two, one)] = h
        members[n + k] = one + two
    at = np.triu_indices(n, 1)
    return float(np.corrcoef(meet[at], d[at])[0, 1]) if len(at[0]) > 1 else 1.0


def first_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows at most, drawn one by one with odds in proportion to the squared distance from those drawn before."""
    at, own = [int(rng.integers(len(x)))], (x * x).sum(1)
    away = lambda i: np.where((gap := own + own[i] - 2 * (x @ x[i])) > 1e-14 * (own + own[i]), gap, 0.0)  # noqa: E731  what rounding may leave of equal rows is 0
    near = away(at[0])
    while len(at) < min(k, len(x)):
        odds = near.cumsum()
        at.append(int(odds.searchsorted(rng.random() * odds[-1], "right")) if odds[-1] > 0 else int(rng.choice(len(x))))
        at[-1] = min(at[-1], len(x) - 1)
        near = np.minimum(near, away(at[-1]))
    return x[at]


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 4, rounds: int = 100) -> tuple[np.ndarray, float]:
    """(labels, inertia) of the best of several seeded k-means++ starts, on one bounded matrix."""
    best: tuple[np.ndarray, float] | None = None
    x = x - x.mean(0)
    x2 = (x * x).sum(1)
    for s in range(starts):
        c = first_centres(x, k, np.random.default_rng(seed * 7919 + s))
        label = None
        for _ in range(rounds):
            d = x2[:, None] - 2 * x @ c.T + (c * c).sum(1)
            new = d.argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            member = np.zeros((len(c), len(x)))
            member[label, np.arange(len(x))] = 1
            n = member.sum(1)
            c[n > 0] = (member @ x)[n > 0] / n[n > 0, None]
        inertia = float(np.maximum(d[np.arange(len(x)), label], 0).sum())
        if best is None or inertia < best[1] - 1e-12:
            best = (label, inertia)
    return best


def distance_sums(a: np.ndarray, b: np.ndarray, member: np.ndarray, same: bool = False) -> np.ndarray:
    """For each row of a its summed Euclidean distances to b's rows by cluster; member: a row a row of b. same: a row's distance to itself is 0.

    Distances are worked out in place, in pieces that stay in a core's cache.
    """
    a2, b2, out = (a * a).sum(1), (b * b).sum(1), np.empty((len(a), member.shape[1]))
    step = max(16, PIECE_BYTES // (8 * max(len(b), 1)))
    for lo in range(0, len(a), step):
        part = a[lo : lo + step]
        d = a2[lo : lo + step, None] + b2
        d -= 2 * part @ b.T
        np.maximum(d, 0, out=d)
        if same:
            d[np.arange(len(part)), lo + np.arange(len(part))] = 0
        out[lo : lo + step] = np.sqrt(d, out=d) @ member
    return out


def added_distance_sums(a: np.ndarray, b: np.ndarray, more_a: np.ndarray, more_b: np.ndarray, member: np.ndarray, sizes: list[int], same: bool = False) -> np.ndarray:
    """distance_sums for several labellings, each by the columns of a and b and one more of its own: squares of distances add over columns.

    member: the labellings' clusters side by side, sizes their numbers. Pieces stay in a core's cache.
    """
    a2, b2, out = (a * a).sum(1), (b * b).sum(1), np.empty((len(a), member.shape[1]))
    step = min(len(a), max(16, PIECE_BYTES // (16 * max(len(b), 1))))
    room, columns = np.empty((step, len(b))), np.ascontiguousarray(more_b.T)
    for lo in range(0, len(a), step):
        part = a[lo : lo + step]
        d = a2[lo : lo + step, None] + b2
        d -= 2 * part @ b.T
        np.maximum(d, 0, out=d)
        if same:
            d[np.arange(len(part)), lo + np.arange(len(part))] = 0
        far, at = room[: len(part)], 0
        for i, k in enumerate(sizes):
            np.subtract(more_a[lo : lo + step, i, None], columns[i], out=far)
            np.multiply(far, far, out=far)
            far += d
            out[lo : lo + step, at : at + k] = np.sqrt(far, out=far) @ member[:, at : at + k]
            at += k
    return out


def silhouette_mean(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette of one bounded matrix; -1 for fewer than two clusters."""
    kinds, code = np.unique(labels, return_inverse=True)
    if len(kinds) < 2:
        return -1.0
    x = x - x.mean(0)
    sums = distance_sums(x, x, np.eye(len(kinds))[code])
    n = np.bincount(code)
    own = n[code]
    a = sums[np.arange(len(x)), code] / np.maximum(own - 1, 1)
    other = sums / n
    other[np.arange(len(x)), code] = np.inf
    b = other.min(1)
    top = np.maximum(a, b)
    return float(np.where((own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0).mean())


def partition_measures(x: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Davies-Bouldin and Calinski-Harabasz of one bounded matrix; infinity and 0 for fewer than two clusters."""
    kinds, code = np.unique(labels, return_inverse=True)
    if len(kinds) < 2:
        return math.inf, 0.0
    n = np.bincount(code)
    centre = np.array([x[code == j].mean(0) for j in range(len(kinds))])
    off = ((x - centre[code]) ** 2).sum(1)
    spread = np.bincount(code, np.sqrt(off)) / n
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    between = (n * ((centre - x.mean(0)) ** 2).sum(1)).sum()
    return float(((spread[:, None] + spread[None]) / gap).max(1).mean()), float(between / (len(kinds) - 1) / max(off.sum() / max(len(x) - len(kinds), 1), 1e-12))


def agreement(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Normalised mutual information (arithmetic) and adjusted Rand index of two labellings."""
    one, two = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    return table_agreement(np.bincount(one * (two.max() + 1) + two, minlength=(one.max() + 1) * (two.max() + 1)).reshape(one.max() + 1, -1))


def table_agreement(t: np.ndarray) -> tuple[float, float]:
    """The same from the counts of each pair of labels."""
    t = t.astype(float)
    n, rows, columns = t.sum(), t.sum(1), t.sum(0)
    some = t > 0
    mi = (t[some] / n * np.log(n * t[some] / np.outer(rows, columns)[some])).sum()
    entropy = lambda c: -(c[c > 0] / n * np.log(c[c > 0] / n)).sum()
    pairs = lambda c: (c * (c - 1) / 2).sum()
    both = entropy(rows) + entropy(columns)
    expected, most = pairs(rows) * pairs(columns) / max(n * (n - 1) / 2, 1), (pairs(rows) + pairs(columns)) / 2
    return float(2 * mi / both) if both > 1e-12 else 1.0, float((pairs(t) - expected) / (most - expected)) if abs(most - expected) > 1e-12 else 1.0
