"""The normal distribution function and its inverse for whole arrays, by rational approximations."""

from __future__ import annotations

import numpy as np

# Cody (1969), rational Chebyshev approximations of the error function; highest power first.
ERF_P = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_Q = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_P = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
          8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
ERFC_Q = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
          3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
TAIL_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
          1.60837851487422766e-2, 6.58749161529837803e-4)
TAIL_Q = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2,
          2.33520497626869185e-3)
# Acklam's approximation of the normal quantile, refined below; highest power first.
MID_P = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1,
         2.506628277459239e0)
MID_Q = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
END_P = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732537343734e0, 4.374664141464968e0,
         2.938163982698783e0)
END_Q = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0, 1.0)


def erfc(x: np.ndarray) -> np.ndarray:
    """1 - erf(x), to about 1e-15 relative to its size; NaN stays NaN."""
    x = np.asarray(x, float)
    a = np.minimum(np.abs(x), 30.0)  # beyond, the value is 0 or 2
    out = np.empty_like(x)
    near, far = a <= 0.46875, a > 4.0
    z = a[near] ** 2
    out[near] = 1.0 - x[near] * np.polyval(ERF_P, z) / np.polyval(ERF_Q, z)
    mid = ~near & ~far
    y = a[mid]
    out[mid] = np.exp(-y * y) * np.polyval(ERFC_P, y) / np.polyval(ERFC_Q, y)
    y = a[far]
    z = 1.0 / (y * y)
    rest = z * np.polyval(TAIL_P, z) / np.polyval(TAIL_Q, z)
    out[far] = np.exp(-y * y) * (1.0 / np.sqrt(np.pi) - rest) / y
    return np.where(~near & (x < 0), 2.0 - out, out)


def norm_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(x, float) / np.sqrt(2.0))


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """The quantile of p, held within 1e-300 and 1 - 1e-16; NaN stays NaN."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    low = np.minimum(p, 1.0 - p)
    out = np.empty_like(p)
    end = low < 0.02425
    t = np.sqrt(-2.0 * np.log(low[end]))
    out[end] = np.polyval(END_P, t) / np.polyval(END_Q, t)
    q = low[~end] - 0.5
    r = q * q
    out[~end] = q * np.polyval(MID_P, r) / np.polyval(MID_Q, r)
    # One step of Halley's method on the lower half, where the distribution function keeps its relative precision.
    err = (norm_cdf(out) - low) * np.sqrt(2.0 * np.pi) * np.exp(out * out / 2.0)
    out = out - err / (1.0 + out * err / 2.0)
    return np.where(p > 0.5, -out, out)
