"""Tail probabilities and exact tests as Arrow-batched UDFs over already aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz steps)."""
    floor = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), floor)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > floor else floor)
            c = 1.0 + term / c
            c = c if abs(c) > floor else floor
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def student_quantile(prob: float, df: float) -> float:
    """Upper quantile by bisection on the two-sided tail."""
    target, low, high = 2.0 * (1.0 - prob), 0.0, 1e3
    while student_two_sided(high, df) > target:
        high *= 10.0
    for _ in range(200):
        middle = (low + high) / 2.0
        low, high = (middle, high) if student_two_sided(middle, df) > target else (low, middle)
    return (low + high) / 2.0


def chi2_upper(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution by series or continued fraction."""
    if x <= 0.0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= z / k
            total += term
        return 1.0 - front * total
    b = z + 1.0 - a
    c, d = 1e300, 1.0 / b
    value = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def kolmogorov_upper(d: float, n: float, m: float) -> float:
    """Asymptotic two-sided p-value of the two-sample distance."""
    lam = d * math.sqrt(n * m / (n + m))
    if lam < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


def hypergeometric_log_pmf(white: int, black: int, drawn: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Support and log probabilities, from ``keep`` and the mode outward to where they are 0 in double."""
    low, high = max(0, drawn - black), min(drawn, white)
    mode = min(high, max(low, (drawn + 1) * (white + 1) // (white + black + 2)))

    def steps(k: np.ndarray) -> np.ndarray:
        """Log ratio of the probabilities at k + 1 and k."""
        return np.log(white - k) + np.log(drawn - k) - np.log(k + 1.0) - np.log(black - drawn + k + 1.0)

    def outward(end: int, wanted: int, side: int) -> list[np.ndarray]:
        """Logs from the mode to ``end``, in blocks, until they vanish beyond ``wanted``."""
        blocks, at, log = [], mode, 0.0
        while at != end and (log > -760.0 or side * (wanted - at) > 0):
            size = min(abs(end - at), 65536)
            k = at + np.arange(size) if side > 0 else at - 1 - np.arange(size)
            logs = log + np.cumsum(side * steps(k.astype(float)))
            blocks.append(logs)
            at, log = at + side * size, float(logs[-1])
        return blocks

    up, down = outward(high, keep, 1), outward(low, keep, -1)
    above, below = (np.concatenate(b) if b else np.zeros(0) for b in (up, down))
    x = mode + np.arange(-len(below), len(above) + 1, dtype=float)
    logs = np.concatenate((below[::-1], [0.0], above))
    logs -= math.log(np.exp(logs).sum())
    return x, logs


class Table2x2:
    """Noncentral hypergeometric view of a 2x2 table with fixed margins."""

    def __init__(self, a: int, b: int, c: int, d: int):
        self.a = float(a)
        self.x, self.logs = hypergeometric_log_pmf(a + b, c + d, a + c, a)

    def weights(self, log_odds: float) -> np.ndarray:
        w = self.logs + log_odds * self.x
        w = np.exp(w - w.max())
        return w / w.sum()

    def solve(self, measure, target: float) -> float:
        """Odds at which the increasing ``measure`` of the weights reaches ``target``."""
        left, right = -50.0, 50.0
        for _ in range(70):
            middle = (left + right) / 2.0
            left, right = (middle, right) if measure(self.weights(middle)) < target else (left, middle)
        return math.exp((left + right) / 2.0)

    def p_value(self) -> float:
        observed = self.logs[int(self.a - self.x[0])]
        return float(min(1.0, np.exp(self.logs[self.logs <= observed + 1e-7]).sum()))

    def odds(self) -> float:
        if self.a == self.x[0]:
            return 0.0
        if self.a == self.x[-1]:
            return math.inf
        return self.solve(lambda w: float(w @ self.x), self.a)

    def limits(self, level: float = 0.95) -> tuple[float, float]:
        tail = (1.0 - level) / 2.0
        above, below = self.x >= self.a, self.x <= self.a
        low = 0.0 if self.a == self.x[0] else self.solve(lambda w: float(w[above].sum()), tail)
        high = math.inf if self.a == self.x[-1] else self.solve(lambda w: -float(w[below].sum()), -tail)
        return low, high


def fisher_2x2(a: int, b: int, c: int, d: int, level: float = 0.95) -> tuple[float, ...]:
    """Two-sided p, conditional maximum-likelihood odds ratio and its confidence limits."""
    table = Table2x2(a, b, c, d)
    return (table.p_value(), table.odds(), *table.limits(level))


_FISHER = T.StructType([T.StructField(n, T.DoubleType()) for n in ("p", "odds_ratio", "ci_low", "ci_high")])


@F.pandas_udf(_FISHER)
def fisher_test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    rows = [fisher_2x2(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)]
    return pd.DataFrame(rows, columns=["p", "odds_ratio", "ci_low", "ci_high"])


@F.pandas_udf(T.DoubleType())
def hypergeometric_upper(hit: pd.Series, white: pd.Series, total: pd.Series, drawn: pd.Series) -> pd.Series:
    """P(X >= hit) for ``drawn`` draws from ``total`` with ``white`` successes."""

    def one(k, w, t, n):
        x, logs = hypergeometric_log_pmf(int(w), int(t) - int(w), int(n), int(k))
        return float(min(1.0, np.exp(logs[x >= k]).sum()))

    return pd.Series([one(*row) for row in zip(hit, white, total, drawn)])


@F.pandas_udf(T.DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(v) or pd.isna(k) else student_two_sided(v, k) for v, k in zip(t, df)], dtype=float
    )


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else chi2_upper(v, k) for v, k in zip(x, df)], dtype=float)


@F.pandas_udf(T.DoubleType())
def ks_tail(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else kolmogorov_upper(v, a, b) for v, a, b in zip(d, n, m)], dtype=float)


@F.pandas_udf(T.DoubleType())
def conditional_odds(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([Table2x2(int(w), int(x), int(y), int(z)).odds() for w, x, y, z in zip(a, b, c, d)])
