import math

import numpy as np
import pytest

from ammolite.functions import special as s


def test_tabulated_tails():
    assert s.normal_sf_values([1.959963985, 0.0, -1.0]) == pytest.approx([0.025, 0.5, 0.841344746], abs=1e-9)
    assert s.chi2_sf_values([3.841458821, 18.30703805, 101.879474, 0.0], [1, 10, 80, 3]) == pytest.approx([0.05, 0.05, 0.05, 1.0], abs=1e-6)
    assert s.gamma_q(40, 50) == pytest.approx(sum(math.exp(k * math.log(50) - 50 - math.lgamma(k + 1)) for k in range(40)), rel=1e-12)
    assert s.t_sf_values([2.228138852, -2.228138852, 12.7062047], [10, 10, 1]) == pytest.approx([0.025, 0.975, 0.025], abs=1e-8)
    assert s.f_sf_values([4.964602744, 2.8661, 1.0], [1, 4, 5], [10, 20, 5]) == pytest.approx([0.05, 0.05, 0.5], abs=1e-5)


def test_bounds_and_symmetry():
    x = np.linspace(0, 1, 11)
    assert s.beta_i(2.0, 3.0, x) == pytest.approx(1 - s.beta_i(3.0, 2.0, 1 - x), abs=1e-12)
    assert s.beta_i(2.0, 3.0, x) == pytest.approx(6 * x**2 - 8 * x**3 + 3 * x**4, abs=1e-12)
    assert np.isnan(s.gamma_q(-1.0, 2.0)) and np.isnan(s.beta_i(1.0, 1.0, 2.0))


def test_columns(spark):
    df = spark.createDataFrame([(3.841458821, 1), (None, 2)], "x double, df int")
    got = [r.p for r in df.select(s.chi2_sf("x", "df").alias("p")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-8) and got[1] is None
