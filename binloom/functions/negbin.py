"""Negative-binomial kernels over many features at once: rows are features, columns samples."""

from __future__ import annotations

import numpy as np

#: Smallest dispersion looked at.
MIN_DISPERSION = 1e-8
#: Ridge on the natural-log coefficients: a group without counts keeps a finite one.
RIDGE = 1e-6
_GOLDEN = (5**0.5 - 1) / 2


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    """What Stirling's formula leaves of log gamma, for z of 8 and more."""
    w = 1.0 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers; small ones are moved up by the recurrence."""
    x = np.asarray(x, float)
    shift = np.where(x < 8.0, 8.0, 0.0)
    z = x + shift
    product = np.ones_like(x)
    for k in range(8):
        product = product * np.where(shift > 0, x + k, 1.0)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + _stirling_rest(z) - np.log(product)


def trigamma(x: float) -> float:
    """Second derivative of log gamma."""
    total = 0.0
    while x < 12.0:
        total, x = total + 1.0 / (x * x), x + 1.0
    w = 1.0 / (x * x)
    return total + 1.0 / x + w / 2.0 + w / x * (1 / 6 - w * (1 / 30 - w * (1 / 42 - w / 30)))


def log_rising(r: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log gamma(r + y) - log gamma(r), without cancellation where r is large."""
    big = np.maximum(r, 8.0)
    far = (big + y - 0.5) * np.log1p(y / big) + y * np.log(big) - y + _stirling_rest(big + y) - _stirling_rest(big)
    return np.where(r >= 8.0, far, log_gamma(r + y) - log_gamma(r))


def log_likelihood(y: np.ndarray, mu: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Per feature, without the terms in y alone; ``alpha`` is a dispersion per feature."""
    r = np.broadcast_to((1.0 / alpha)[:, None], y.shape)
    return (log_rising(r, y) + y * (np.log(mu) - np.log(mu + r)) - r * np.log1p(mu / r)).sum(axis=1)


def _information(x: np.ndarray, mu: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """X'WX of every feature."""
    return np.einsum("ij,gi,ik->gjk", x, mu / (1.0 + alpha[:, None] * mu), x)


def fit_means(
    y: np.ndarray, factors: np.ndarray, x: np.ndarray, alpha: np.ndarray, beta: np.ndarray | None = None, steps: int = 100
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and means that maximise the ridged likelihood at the given dispersions.

    Iteratively reweighted least squares, all features at once; a step that lowers the
    likelihood is halved. Ends when no coefficient moves by more than 1e-9.
    """
    if beta is None:
        start = np.log(y / factors + 0.1)
        beta = start @ x @ np.linalg.inv(x.T @ x)
    ridge = RIDGE * np.eye(x.shape[1])

    def at(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mu = np.maximum(factors * np.exp(np.clip(b @ x.T, -40.0, 40.0)), 1e-12)
        return mu, log_likelihood(y, mu, alpha) - RIDGE / 2 * (b * b).sum(axis=1)

    mu, value = at(beta)
    for _ in range(steps):
        score = ((y - mu) / (1.0 + alpha[:, None] * mu)) @ x - RIDGE * beta
        step = np.linalg.solve(_information(x, mu, alpha) + ridge, score[:, :, None])[:, :, 0]
        step = np.clip(step, -3.0, 3.0)
        for _ in range(20):
            mu_new, value_new = at(beta + step)
            worse = value_new < value - 1e-10 * np.abs(value)
            if not worse.any():
                break
            step[worse] /= 2.0
        beta, mu, value = beta + step, mu_new, value_new
        if np.abs(step).max(initial=0.0) < 1e-9:
            break
    return beta, mu


def profile(y, factors, x, log_alpha, beta=None, centre=None, variance=None):
    """Cox-Reid adjusted profile likelihood at a dispersion per feature, and its coefficients.

    With ``centre`` and ``variance``, plus the log density of a normal prior on log alpha.
    """
    alpha = np.exp(log_alpha)
    beta, mu = fit_means(y, factors, x, alpha, beta)
    value = log_likelihood(y, mu, alpha) - 0.5 * np.linalg.slogdet(_information(x, mu, alpha))[1]
    if centre is not None:
        value = value - (log_alpha - centre) ** 2 / (2.0 * variance)
    return value, beta


def fit_dispersions(y, factors, x, centre=None, variance=None, grid: int = 16, sections: int = 36) -> np.ndarray:
    """Dispersion per feature at the maximum of ``profile``: a grid, then golden sections."""
    low, high = np.log(MIN_DISPERSION), np.log(max(10.0, y.shape[1]))
    places = np.linspace(low, high, grid)
    best, at, beta = np.full(len(y), -np.inf), np.zeros(len(y), int), None
    for k, place in enumerate(places):
        value, beta = profile(y, factors, x, np.full(len(y), place), beta, centre, variance)
        better = value > best
        best, at = np.where(better, value, best), np.where(better, k, at)
    a, b = places[np.maximum(at - 1, 0)], places[np.minimum(at + 1, grid - 1)]
    c, d = b - _GOLDEN * (b - a), a + _GOLDEN * (b - a)
    at_c, beta = profile(y, factors, x, c, beta, centre, variance)
    at_d, beta = profile(y, factors, x, d, beta, centre, variance)
    for _ in range(sections):
        left = at_c >= at_d
        a, b = np.where(left, a, c), np.where(left, d, b)
        fresh = np.where(left, b - _GOLDEN * (b - a), a + _GOLDEN * (b - a))
        value, beta = profile(y, factors, x, fresh, beta, centre, variance)
        c, at_c, d, at_d = (
            np.where(left, fresh, d),
            np.where(left, value, at_d),
            np.where(left, c, fresh),
            np.where(left, at_c, value),
        )
    middle = (a + b) / 2.0
    ends = profile(y, factors, x, np.full(len(y), low), None, centre, variance)[0]
    inside = profile(y, factors, x, middle, None, centre, variance)[0]
    return np.exp(np.where(ends >= inside, low, middle))


def covariances(mu: np.ndarray, x: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Covariance of the ridged coefficients of every feature."""
    information = _information(x, mu, alpha)
    inverse = np.linalg.inv(information + RIDGE * np.eye(x.shape[1]))
    return inverse @ information @ inverse
