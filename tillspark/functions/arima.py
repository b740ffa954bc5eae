"""Seasonal ARIMA by conditional least squares, for one short series (called inside Spark tasks)."""

from __future__ import annotations

import numpy as np


def _seasonal_product(short: np.ndarray, long: np.ndarray, season: int) -> np.ndarray:
    """Polynomial ``(1, short...) x (1, 0..., long at the season)`` in the backshift operator."""
    first = np.concatenate([[1.0], short])
    second = np.zeros(season * len(long) + 1)
    second[0] = 1.0
    second[season::season] = long
    return np.convolve(first, second)


def _unpack(theta: np.ndarray, order: tuple) -> tuple[np.ndarray, np.ndarray]:
    p, _, q, sp, _, sq, season = order
    a, b, c, _ = np.split(theta, np.cumsum([p, sp, q]))
    return _seasonal_product(-a, -b, season), _seasonal_product(c, theta[p + sp + q :], season)


def _differencing(order: tuple) -> np.ndarray:
    _, d, _, _, sd, _, season = order
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    step = np.zeros(season + 1)
    step[0], step[-1] = 1.0, -1.0
    for _ in range(sd):
        poly = np.convolve(poly, step)
    return poly


def _inverse(poly: np.ndarray, n: int) -> np.ndarray:
    """First ``n`` coefficients of 1 / poly (whose first is 1), doubling the known ones by Newton's step."""
    out = np.ones(1)
    while len(out) < n:
        size = min(2 * len(out), n)
        step = -np.convolve(poly[:size], out)[:size]
        step[0] += 2
        out = np.convolve(out, step)[:size]
    return out


def _residuals(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """One-step errors given the first observations, earlier errors taken as zero: the series through ar / ma."""
    target = np.convolve(w, ar)[len(ar) - 1 : len(w)]
    if not ma[1:].any() or not len(target):
        return target
    return np.convolve(target, _inverse(ma, len(target)))[: len(target)]


def fit(y: np.ndarray, order: tuple, iterations: int = 500):
    """Parameters and error variance minimising the conditional sum of squares (Levenberg-Marquardt), or None."""
    differencing = _differencing(order)
    w = np.convolve(y, differencing)[len(differencing) - 1 : len(y)]
    size = order[0] + order[2] + order[3] + order[5]
    scale = np.std(w) or 1.0
    w = w / scale

    def errors(theta):
        return _residuals(w, *_unpack(theta, order))

    theta = np.zeros(size)
    with np.errstate(all="ignore"):
        current = errors(theta)
        if len(current) < size + 3:
            return None
        best, damping = current @ current, 1e-2
        for _ in range(iterations if size else 0):
            jacobian = np.column_stack([(errors(theta + 1e-5 * e) - current) / 1e-5 for e in np.eye(size)])
            normal = jacobian.T @ jacobian
            if not np.isfinite(normal).all():
                break
            gained = 0.0
            while damping < 1e6:
                try:
                    move = np.linalg.solve(normal + damping * (np.diag(np.diag(normal)) + 1e-8 * np.eye(size)), -jacobian.T @ current)
                except np.linalg.LinAlgError:  # more damping makes it solvable
                    damping *= 4
                    continue
                trial = errors(theta + move)
                cost = trial @ trial
                if np.isfinite(cost) and cost < best:
                    gained, damping = best - cost, damping / 5
                    theta, current, best = theta + move, trial, cost
                    break
                damping *= 4
            if gained <= 1e-8 * best:
                break
    return theta, best / max(len(current) - size, 1) * scale * scale


def state(y: np.ndarray, order: tuple) -> dict | None:
    """What a fitted series needs to be forecast later: parameters, error variance, its last values and last errors; None when
    the fit fails."""
    y = np.asarray(y, dtype=float)
    found = fit(y, order)
    if found is None:
        return None
    theta, variance = found
    ar, ma = _unpack(theta, order)
    full = np.convolve(ar, _differencing(order))
    if len(y) < len(full):
        return None
    with np.errstate(all="ignore"):
        errors = _residuals(y, full, ma)
    kept = len(ma) - 1
    errors = np.concatenate([np.zeros(kept), errors])[len(errors) :] if kept else np.zeros(0)
    out = {"theta": theta, "variance": float(variance), "values": y[len(y) - len(full) + 1 :], "errors": errors}
    return out if all(np.isfinite(v).all() for v in out.values()) else None


def ahead(state: dict, order: tuple, steps: int):
    """Point forecasts and standard errors for ``steps`` periods from a ``state``, or None when they aren't finite."""
    theta = np.asarray(state["theta"], dtype=float)
    ar, ma = _unpack(theta, order)
    full = np.convolve(ar, _differencing(order))
    past, known = len(full) - 1, len(ma) - 1
    with np.errstate(all="ignore"):
        values = np.concatenate([np.asarray(state["values"], dtype=float), np.zeros(steps)])
        errors = np.concatenate([np.asarray(state["errors"], dtype=float), np.zeros(steps)])
        psi = np.zeros(steps)
        for h in range(steps):
            values[past + h] = -full[1:] @ values[h : past + h][::-1] + ma[1:] @ errors[h : known + h][::-1]
            own = 1.0 if h == 0 else (ma[h] if h < len(ma) else 0.0)
            psi[h] = own - sum(full[k] * psi[h - k] for k in range(1, min(h, past) + 1))
        spread = np.sqrt(state["variance"] * np.cumsum(psi**2))
    means = values[past:]
    return (means, spread) if np.isfinite(means).all() and np.isfinite(spread).all() else None


def forecast(y: np.ndarray, order: tuple, steps: int):
    """Point forecasts and standard errors for ``steps`` periods, or None when the fit fails."""
    found = state(y, order)
    return None if found is None else ahead(found, order, steps)
