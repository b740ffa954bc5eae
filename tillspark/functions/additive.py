"""Trend with changepoints times Fourier seasonality (after Taylor and Letham, 2018), for one series inside a Spark task."""

from __future__ import annotations

import numpy as np

CHANGEPOINTS, RANGE = 25, 0.8  # fixed values: number of possible trend changes, share of the history they lie in
SEASONS = {"yearly": (365.25, 10), "monthly": (30.5, 5)}  # fixed values: period in days, Fourier order
SEASON_SCALE = 10.0
LEAST_CHANGE = 1e-5  # trend changes below this weigh as this much


def _fourier(days: np.ndarray) -> np.ndarray:
    columns = []
    for period, order in SEASONS.values():
        for k in range(1, order + 1):
            angle = 2 * np.pi * k * days / period
            columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack(columns)


def _ridge(x: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ y)


class AdditiveModel:
    """Posterior mode: a Laplace prior of width ``change_scale`` on trend changes, which keeps most of them near zero, and a Gaussian
    one of width 10 on seasonal terms. The Laplace prior is met by reweighting: near the last solution it is a Gaussian one."""

    def __init__(self, days: np.ndarray, y: np.ndarray, change_scale: float = 0.05, rounds: int = 500):
        self.start, self.span = days[0], max(days[-1] - days[0], 1)
        self.scale = np.abs(y).max() or 1.0
        t, target = (days - self.start) / self.span, y / self.scale
        count = min(CHANGEPOINTS, max(int(RANGE * len(t)) - 1, 0))
        self.changes = t[np.linspace(0, int(RANGE * len(t)) - 1, count + 1).round().astype(int)][1:]
        trend_x, season_x = self._trend_columns(t), _fourier(days)
        beta, noise, sizes = np.zeros(season_x.shape[1]), 0.05, np.full(count, change_scale)
        for _ in range(rounds):
            factor = 1 + season_x @ beta
            pull = np.array([1e-6, 1e-6, *(noise**2 / (change_scale * sizes))])
            self.theta = _ridge(factor[:, None] * trend_x, target, pull)
            trend, sizes = trend_x @ self.theta, np.maximum(np.abs(self.theta[2:]), LEAST_CHANGE)
            beta = _ridge(trend[:, None] * season_x, target - trend, np.full(len(beta), (noise / SEASON_SCALE) ** 2 + 1e-8))
            before, noise = noise, max(np.std(target - trend * (1 + season_x @ beta)), 1e-4)
            if abs(noise - before) <= 1e-6 * before:
                break
        self.beta, self.noise = beta, noise

    def state(self) -> dict:
        """Plain numbers from which ``restored`` makes the same model."""
        return {"start": float(self.start), "span": float(self.span), "scale": float(self.scale), "noise": float(self.noise),
                "changes": self.changes.tolist(), "theta": self.theta.tolist(), "beta": self.beta.tolist()}

    @classmethod
    def restored(cls, state: dict) -> "AdditiveModel":
        model = cls.__new__(cls)
        for name, value in state.items():
            setattr(model, name, value if np.isscalar(value) else np.asarray(value, dtype=float))
        return model

    def _trend_columns(self, t: np.ndarray) -> np.ndarray:
        hinges = np.maximum(t[:, None] - self.changes[None, :], 0)
        return np.column_stack([np.ones(len(t)), t, hinges])

    def predict(self, days: np.ndarray, level: float = 0.95, draws: int = 1000, seed: int = 42) -> dict[str, np.ndarray]:
        """Forecast, interval and components. Future trend changes are drawn with the average size of the past ones."""
        t = (days - self.start) / self.span
        trend = self._trend_columns(t) @ self.theta
        season = _fourier(days)
        cut = 2 * SEASONS["yearly"][1]
        yearly, monthly = season[:, :cut] @ self.beta[:cut], season[:, cut:] @ self.beta[cut:]
        factor = 1 + yearly + monthly
        random = np.random.default_rng(seed)
        size = np.abs(self.theta[2:]).mean() if len(self.theta) > 2 else 0.0
        ahead = np.maximum(t - 1, 0)
        expected = int(np.ceil(max(ahead.max(), 0) * len(self.changes)))
        drift = np.zeros((draws, len(t)))
        for _ in range(expected):
            place = 1 + random.uniform(0, ahead.max(), draws)
            drift += random.laplace(0, size or 1e-12, draws)[:, None] * np.maximum(t[None, :] - place[:, None], 0)
        paths = (trend + drift) * factor + random.normal(0, self.noise, drift.shape)
        low, high = np.quantile(paths, [(1 - level) / 2, (1 + level) / 2], axis=0)
        return {
            "forecast": trend * factor * self.scale,
            "lower_bound": low * self.scale,
            "upper_bound": high * self.scale,
            "trend": trend * self.scale,
            "yearly": yearly,
            "monthly": monthly,
        }
