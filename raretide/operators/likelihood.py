"""Row terms of the count-model likelihoods: value, first and second derivatives.

With x'b = eta, mu = exp(eta), z'g = zeta, pi = logistic(zeta) or Phi(zeta), a = ln(alpha). Formulas: Lambert
(1992), Cameron and Trivedi. These functions work on one block of rows inside a task.
"""

from __future__ import annotations

import math

import numpy as np

EXACT_SUM = 10_000
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


# Rational approximations of Cody (1969) to erf below 0.46875 and to erfc up to 4 and beyond it.
ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
MID_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
           8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
MID_DEN = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3,
           4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
FAR_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2,
           6.58749161529837803e-4)
FAR_DEN = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of a block of numbers, to double accuracy."""
    x = np.asarray(x, float)
    a = np.abs(x)
    small, s = a < 0.46875, np.minimum(a, 0.46875) ** 2
    near = 1.0 - x * np.polyval(ERF_NUM, s) / np.polyval(ERF_DEN, s)
    b = np.maximum(a, 0.46875)
    whole = np.floor(b * 16) / 16  # exp(-b²) in two factors keeps its last digits
    with np.errstate(under="ignore", over="ignore", invalid="ignore"):
        bell = np.exp(-whole * whole) * np.exp(-(b - whole) * (b + whole))
        c = np.minimum(b, 4.0)
        middle = np.polyval(MID_NUM, c) / np.polyval(MID_DEN, c)
        r = 1.0 / np.maximum(b, 4.0) ** 2
        far = (1 / math.sqrt(math.pi) - r * np.polyval(FAR_NUM, r) / np.polyval(FAR_DEN, r)) / np.maximum(b, 4.0)
        tail = np.where(np.isinf(b), 0.0, bell * np.where(b <= 4.0, middle, far))
    return np.where(small, near, np.where(x < 0, 2.0 - tail, tail))


def ln_factorial(y: np.ndarray) -> np.ndarray:
    values, back = np.unique(y, return_inverse=True)
    return _lgamma(values + 1.0).astype(float)[back]


def _alpha_sums(y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over j < y of ln(1 + alpha j), j / (1 + alpha j) and its square.

    A running table up to ``EXACT_SUM``; the rest of a larger count by the Euler-Maclaurin formula.
    """
    top = int(min(y.max(initial=0), EXACT_SUM))
    j = np.arange(top)
    g = j / (1 + alpha * j)
    tables = [np.concatenate([[0.0], np.cumsum(t)]) for t in (np.log1p(alpha * j), g, g * g)]
    at = np.minimum(y, top).astype(int)
    sums = [t[at] for t in tables]
    big = y > EXACT_SUM
    if big.any():
        ends = (float(EXACT_SUM), y[big])
        whole, edge, slope = ([], [], [])
        for x in ends:
            u = 1 + alpha * x
            lu, gx = np.log1p(alpha * x), x / u
            whole.append(((u * lu - alpha * x) / alpha, x / alpha - lu / alpha**2, (u - 2 * lu - 1 / u) / alpha**3))
            edge.append((lu, gx, gx * gx))
            slope.append((alpha / u, 1 / u**2, 2 * gx / u**2))
        for i in range(3):
            rest = whole[1][i] - whole[0][i] - (edge[1][i] - edge[0][i]) / 2 + (slope[1][i] - slope[0][i]) / 12
            sums[i][big] += rest
    return sums[0], sums[1], sums[2]


def count_terms(y: np.ndarray, eta: np.ndarray, alpha: float | None) -> dict[str, np.ndarray]:
    """ln f and its derivatives in eta (e) and, for the negative binomial, in ln alpha (a)."""
    with np.errstate(over="ignore"):  # a trial that overflows has no finite likelihood and is shortened
        mu = np.exp(eta)
    base = y * eta - ln_factorial(y)
    if alpha is None:
        return {"l": base - mu, "e": y - mu, "ee": -mu}
    u, r = 1 + alpha * mu, 1 / alpha
    lu = np.log1p(alpha * mu)
    s0, s1, s2 = _alpha_sums(y, alpha)
    d1 = s1 + r * r * lu - (y + r) * mu / u
    d2 = -s2 - 2 * r**3 * lu + 2 * r * r * mu / u + (y + r) * (mu / u) ** 2
    return {
        "l": base + s0 - (y + r) * lu,
        "e": (y - mu) / u,
        "ee": -mu * (1 + alpha * y) / u**2,
        "a": alpha * d1,
        "aa": alpha * alpha * d2 + alpha * d1,
        "ea": -alpha * (y - mu) * mu / u**2,
    }


def inflated_terms(y: np.ndarray, c: dict[str, np.ndarray], zeta: np.ndarray, link: str) -> dict[str, np.ndarray]:
    """Mix a point mass at zero of weight pi(zeta) into the count terms ``c``."""
    zero = y == 0
    if link == "logit":
        pi = np.exp(-np.logaddexp(0.0, -zeta))
        no = np.maximum(np.exp(-np.logaddexp(0.0, zeta)), 1e-300)
        slope, curve = pi * no, pi * no * (no - pi)
    else:
        pi = 0.5 * erfc(-zeta / math.sqrt(2))
        no = np.maximum(0.5 * erfc(zeta / math.sqrt(2)), 1e-300)
        slope = np.exp(-zeta * zeta / 2) / math.sqrt(2 * math.pi)
        curve = -zeta * slope
    f0 = np.where(zero, np.exp(np.minimum(c["l"], 0.0)), 0.0)
    mass = np.where(zero, pi + no * f0, 1.0)
    w = np.where(zero, pi / mass, 0.0)
    v = 1 - w
    ratio = np.where(zero, (1 - f0) / mass, -1 / no)
    z = slope * ratio
    cross = np.where(zero, -slope * f0 / mass**2, 0.0)
    out = {
        "l": np.where(zero, np.log(mass), np.log(no) + c["l"]),
        "e": v * c["e"],
        "ee": v * c["ee"] + w * v * c["e"] ** 2,
        "z": z,
        "zz": curve * ratio - z * z,
        "ez": cross * c["e"],
    }
    if "a" in c:
        out |= {
            "a": v * c["a"],
            "aa": v * c["aa"] + w * v * c["a"] ** 2,
            "ea": v * c["ea"] + w * v * c["e"] * c["a"],
            "za": cross * c["a"],
        }
    return out
