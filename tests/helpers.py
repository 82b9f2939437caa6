"""Plain, sequential versions of the operators for comparison."""

import math

import numpy as np


def series(rng, symbols=("a", "b"), rows=400, zero_share=0.05):
    """Bars with gaps in time and some without quantity."""
    out = []
    for s in symbols:
        t = 1_700_000_000
        for _ in range(rows):
            t += int(rng.choice([1, 1, 2, 400]))
            q = 0.0 if rng.random() < zero_share else float(rng.integers(1, 50))
            buy = float(rng.integers(0, int(q) + 1))
            out.append((s, t, float(rng.uniform(90, 110)) * q, q, q, buy, q - buy, int(rng.integers(1, 5))))
    return out


def plain_features(bars, lam=0.94):
    """{(symbol, sec): (vwap, r, sigma, baseline)} by one loop over each symbol."""
    out = {}
    for s in {b[0] for b in bars}:
        vwap, var, volumes, first = 0.0, 0.0, [], True
        for b in sorted(x for x in bars if x[0] == s):
            price = b[2] / b[3] if b[3] > 0 else vwap
            r = math.log(price / (vwap + 1e-9)) if not first and vwap > 0 and price > 0 else 0.0
            var = r * r if first else lam * var + (1 - lam) * r * r
            volumes = [*volumes, b[4]][-60:]
            out[s, b[1]] = (price, r, math.sqrt(var + 1e-9), sum(volumes) / len(volumes))
            vwap, first = price, False
    return out


def plain_threshold(y, p, policy="f1", beta=1.0, min_precision=None, min_recall=None, pairing="reference"):
    """(thr, precision, recall) by looking at every distinct score."""
    y, p = np.array(y), np.array(p)
    points = []
    for t in sorted(set(p)):
        tp, fp = int(((p >= t) & (y == 1)).sum()), int(((p >= t) & (y == 0)).sum())
        points.append((t, tp / (tp + fp), tp / y.sum() if y.sum() else 1.0))
    if pairing == "reference":
        points = [(points[i][0], *(points[i + 1][1:] if i + 1 < len(points) else (1.0, 0.0))) for i in range(len(points))]
    fb = lambda a, b, k: (1 + k * k) * a * b / (k * k * a + b + 1e-12)
    value = {"f1": lambda a, b: fb(a, b, 1), "fbeta": lambda a, b: fb(a, b, beta), "recall_at_precision": lambda a, b: b, "precision_at_recall": lambda a, b: a}[policy]
    ok = [x for x in points if x[1] >= (min_precision or -1) and x[2] >= (min_recall or -1)] or points
    best = max(value(a, b) for _, a, b in ok)
    ties = [x for x in ok if abs(value(x[1], x[2]) - best) <= 1e-12 + 1e-5 * abs(best)]
    return max(ties, key=lambda x: (x[1], x[2], x[0]))
