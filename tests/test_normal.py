import math
from statistics import NormalDist

import numpy as np

from cardinal.functions.normal import erfc, norm_cdf, norm_ppf


def test_distribution_function_to_double_precision():
    x = np.concatenate([np.linspace(-9, 9, 20_001), [-40.0, -26.5, 26.5, 40.0, 0.0, 0.46875, -0.46875, 4.0, -4.0]])
    want = np.array([math.erfc(v) for v in x])
    assert np.allclose(erfc(x), want, rtol=1e-13, atol=1e-300)
    assert np.allclose(norm_cdf(x), [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], rtol=1e-13, atol=1e-300)
    assert np.isnan(norm_cdf(np.array([np.nan]))).all() and len(norm_cdf(np.zeros(0))) == 0
    assert list(norm_cdf(np.array([-np.inf, np.inf]))) == [0.0, 1.0]


def test_quantile_against_the_standard_library():
    p = np.concatenate([np.linspace(1e-6, 1 - 1e-6, 5001), [1e-12, 1e-30, 1e-100, 0.02425, 0.97575, 0.5]])
    want = np.array([NormalDist().inv_cdf(v) for v in p])
    assert np.allclose(norm_ppf(p), want, rtol=1e-9, atol=1e-12)
    assert np.allclose(norm_cdf(norm_ppf(p)), p, rtol=1e-12)
    ends = norm_ppf(np.array([0.0, 1.0, np.nan]))
    assert ends[0] < -37 and ends[1] > 8 and np.isnan(ends[2])
