import math

import pytest

from tidewash.functions import pvalues
from tidewash.functions.pvalues import (
    beta_share,
    chi2_tail,
    correlation_p,
    mann_whitney_p,
    normal_tail,
)


@pytest.mark.parametrize(
    ("x", "dof", "p"),
    # Published 5 % points.
    [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (124.342113, 100, 0.05)],
)
def test_chi2_points(x, dof, p):
    assert chi2_tail(x, dof) == pytest.approx(p, abs=1e-7)


def test_chi2_closed_form_for_even_dof():
    for x in (0.1, 3.0, 40.0):
        assert chi2_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)
    assert chi2_tail(5.0, 0) == 1.0


def test_normal_and_t_points():
    assert 2 * normal_tail(1.959963984540054) == pytest.approx(0.05, rel=1e-9)
    # With ten degrees of freedom t = 2.228139 is the two-sided 5 % point.
    t = 2.2281388519649385
    r = t / math.sqrt(10 + t * t)
    assert correlation_p(r, 12) == pytest.approx(0.05, rel=1e-7)
    assert correlation_p(1.0, 5) == 0.0
    assert beta_share(2, 2, 0.5) == pytest.approx(0.5)


def test_mann_whitney_published_example():
    # 19 22 16 29 24 against 20 11 17 12: U = 17, exact two-sided p = 1/9.
    assert mann_whitney_p(17, 5, 4, 0) == pytest.approx(1 / 9)
    assert mann_whitney_p(3, 5, 4, 0) == pytest.approx(1 / 9)
    # The normal law with continuity for the same numbers gives 0.1113.
    z = (17 - 10 - 0.5) / math.sqrt(5 * 4 / 12 * 10)
    assert 2 * normal_tail(z) == pytest.approx(0.11134688653314041)


def test_mann_whitney_all_equal():
    assert mann_whitney_p(8.0, 4, 4, 8**3 - 8) == 1.0


def counted_tail(u, small, large):
    """P(U >= u) by counting with the recurrence over the largest value."""
    table = {}

    def count(m, n, total):
        if total < 0:
            return 0
        if m == 0 or n == 0:
            return int(total == 0)
        if (m, n, total) not in table:
            table[m, n, total] = count(m - 1, n, total - n) + count(m, n - 1, total)
        return table[m, n, total]

    every = [count(small, large, t) for t in range(small * large + 1)]
    return sum(every[u:]) / sum(every)


@pytest.mark.parametrize("small", range(1, 9))
def test_exact_tail_counts_all_orders(small):
    for large in (small, small + 3, 14):
        for u in range(0, small * large + 1, 5):
            assert pvalues._exact_tail(u, small, large) == pytest.approx(
                counted_tail(u, small, large), rel=1e-12
            )


def test_exact_law_does_not_depend_on_the_size():
    # The smallest value of U has the probability 1 / C(n, small).
    for large in (33_333, 33_334, 10**6, 10**9):
        assert mann_whitney_p(0, 3, large, 0) == pytest.approx(2 / math.comb(large + 3, 3))
    near = [mann_whitney_p(1e9, 8, n, 0) for n in (10**9, 10**9 + 1)]
    assert near[0] == pytest.approx(near[1], rel=1e-6)


def test_not_a_number_has_no_probability():
    nan = float("nan")
    assert mann_whitney_p(nan, 3, 9, 0) is None and mann_whitney_p(2, 3, 9, nan) is None
    assert correlation_p(nan, 9) is None and pvalues.chi2_tail(nan, 2) is None
    assert pvalues.beta_share(1.0, nan, 0.5) is None
