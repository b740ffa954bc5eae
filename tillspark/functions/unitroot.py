"""Augmented Dickey-Fuller test of one series, and partial autocorrelations from autocorrelations."""

from __future__ import annotations

from math import ceil, erf, sqrt

import numpy as np

# Response surfaces for a regression with constant (MacKinnon 1994, 2010).
CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
P_SPLIT, P_LOWEST, P_HIGHEST = -1.61, -18.83, 2.74


def p_value(statistic: float) -> float:
    if statistic > P_HIGHEST:
        return 1.0
    if statistic < P_LOWEST:
        return 0.0
    terms = P_SMALL if statistic <= P_SPLIT else P_LARGE
    z = sum(c * statistic**k for k, c in enumerate(terms))
    return 0.5 * (1 + erf(z / sqrt(2)))


def _regression(change: np.ndarray, level: np.ndarray, lags: int, skip: int):
    """Change on level, its own lags and a constant; rows before ``skip`` are left out."""
    rows = np.arange(skip, len(change))
    x = np.column_stack([level[rows], *(change[rows - k] for k in range(1, lags + 1)), np.ones(len(rows))])
    y = change[rows]
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    rss = float(np.sum((y - x @ beta) ** 2))
    return beta, inverse, rss, len(y), x.shape[1]


def dickey_fuller(y: np.ndarray) -> dict | None:
    """Statistic, p-value, lags by AIC, observations and critical values; None when the series is too short or constant."""
    y = np.asarray(y, dtype=float)
    if len(y) < 8 or np.ptp(y) == 0:
        return None
    y = (y - y.mean()) / y.std()
    change, level = np.diff(y), y[:-1]
    most = min(ceil(12 * (len(y) / 100) ** 0.25), len(y) // 2 - 2)
    if most < 0:
        return None

    def aic(lags: int) -> float:
        _, _, rss, n, k = _regression(change, level, lags, most)
        return n * np.log(max(rss, 1e-300) / n) + 2 * k

    lags = min(range(most + 1), key=aic)
    beta, inverse, rss, n, k = _regression(change, level, lags, lags)
    if n <= k:
        return None
    statistic = float(beta[0] / sqrt(rss / (n - k) * inverse[0, 0]))
    critical = {name: sum(c / n**i for i, c in enumerate(row)) for name, row in CRITICAL.items()}
    return {"statistic": statistic, "p_value": p_value(statistic), "lags": lags, "observations": n, "critical": critical}


def partial_autocorrelations(acf: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion over autocorrelations that start at lag 0."""
    out = np.zeros(len(acf))
    out[0] = 1.0
    phi = np.zeros(0)
    for k in range(1, len(acf)):
        top = acf[k] - phi @ acf[k - 1 : 0 : -1][: k - 1] if k > 1 else acf[1]
        bottom = 1 - phi @ acf[1:k] if k > 1 else 1.0
        last = top / bottom if bottom else np.nan
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out
