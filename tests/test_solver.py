"""Closed forms, constraints and degenerate problems of the optimiser, corners of the frontier, and certificates."""

import numpy as np
import pytest

from quantloom.functions.errors import InfeasibleConstraints
from quantloom.operators import critical_line, solver


@pytest.mark.parametrize("rho", [-0.9, -0.2, 0.0, 0.5])
def test_two_asset_min_variance_closed_form(rho):
    a, b = 0.2, 0.3
    cov = np.array([[a * a, rho * a * b], [rho * a * b, b * b]])
    w = solver.min_variance(cov, np.zeros(2), np.ones(2))
    want = (b * b - rho * a * b) / (a * a + b * b - 2 * rho * a * b)
    assert w == pytest.approx([want, 1 - want], abs=1e-9)


def test_constraints_hold_and_frontier_rises():
    rng = np.random.default_rng(3)
    mu, cov = solver.annualised(rng.normal(0.0005, 0.01, (1500, 4)))
    low, high = solver.limits(4)
    last = 0.0
    for t in solver.frontier_targets(mu, cov, low, high, 12):
        w = solver.for_return(mu, cov, low, high, t)
        assert w.sum() == pytest.approx(1, abs=1e-9) and (w >= low - 1e-12).all() and (w <= high + 1e-12).all()
        assert mu @ w >= t - 1e-8
        vol = float(np.sqrt(w @ cov @ w))
        assert vol >= last - 1e-8
        last = vol


def test_max_sharpe_beats_the_frontier_and_random_portfolios():
    rng = np.random.default_rng(42)
    mu, cov = solver.annualised(rng.normal([0.001, 0.0003, 0.0004], 0.01, (1000, 3)))
    low, high = solver.limits(3, 0.6)
    best = solver.sharpe(solver.max_sharpe(mu, cov, low, high), mu, cov)
    for w in rng.dirichlet(np.ones(3), 500):
        w = solver.project(w, low, high)
        assert solver.sharpe(w, mu, cov) <= best + 1e-7


def test_singular_covariance_does_not_crash():
    x = np.random.default_rng(1).normal(0, 0.01, (300, 1))
    returns = np.hstack([x, x, x * 1e-8])
    mu, cov = solver.annualised(returns)
    low, high = solver.limits(3, 0.5)
    for w in (solver.min_variance(cov, low, high), solver.max_sharpe(mu, cov, low, high)):
        assert np.isfinite(w).all() and w.sum() == pytest.approx(1)


def test_infeasible_cap():
    with pytest.raises(InfeasibleConstraints):
        solver.limits(2, 0.35)


def test_max_return_is_the_linear_optimum():
    w = solver.max_return_weights(np.array([0.1, 0.3, 0.2]), np.zeros(3), np.full(3, 0.5))
    assert w.tolist() == [0.0, 0.5, 0.5]


def test_loading_gives_the_covariance_back():
    from quantloom.operators.risk import loading

    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 3))
    cov = x @ x.T  # of rank 3: singular
    a = loading(cov)
    assert np.allclose(a @ a.T, cov)
    assert np.isfinite(loading(np.array([[1.0, 1.1], [1.1, 1.0]]))).all()


def problem(seed, n, short=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(rng.normal(0.0006, 0.0005, n), 0.01 * rng.uniform(0.5, 2, n), (400, n)) @ (np.eye(n) + 0.3 * rng.random((n, n)))
    mu, cov = solver.annualised(x)
    return mu, cov, *solver.limits(n, max(0.35, 1.05 / n), short)


@pytest.mark.parametrize(("seed", "n", "short"), [(1, 2, False), (2, 3, False), (3, 6, False), (4, 6, True), (5, 12, False), (6, 30, False), (7, 50, False)])
def test_critical_line_equals_the_iterative_solver(seed, n, short):
    mu, cov, low, high = problem(seed, n, short)
    line = critical_line.corners(mu, cov, low, high)
    steps = [c.multiplier for c in line]
    assert steps == sorted(steps, reverse=True) and steps[-1] == 0
    assert line[-1].weights == pytest.approx(solver.min_variance(cov, low, high), abs=1e-7)
    assert mu @ line[0].weights == pytest.approx(mu @ solver.max_return_weights(mu, low, high), abs=1e-9)
    for wanted in np.linspace(mu @ line[-1].weights, mu @ line[0].weights, 9):
        mine = critical_line.at_return(line, mu, wanted)
        other = solver.for_return(mu, cov, low, high, wanted)
        assert mu @ mine.weights == pytest.approx(wanted, abs=1e-9) and mine.weights.sum() == pytest.approx(1, abs=1e-9)
        assert mine.weights @ cov @ mine.weights == pytest.approx(other @ cov @ other, abs=1e-8)
    best = critical_line.best_ratio(line, mu, cov)
    assert solver.sharpe(best.weights, mu, cov) >= solver.sharpe(solver.max_sharpe(mu, cov, low, high), mu, cov) - 1e-9


@pytest.mark.parametrize(("seed", "n"), [(1, 3), (2, 6), (3, 12)])
def test_max_sharpe_stays_efficient_where_no_return_exceeds_the_risk_free_rate(seed, n):
    """Less return and more risk would raise a negative ratio; the efficient portfolios' best one has the best return."""
    mu, cov, low, high = problem(seed, n)
    mu = mu - mu.max()
    found = critical_line.portfolio("max_sharpe", mu, cov, low, high)
    assert found.weights == pytest.approx(solver.max_return_weights(mu, low, high), abs=1e-9)
    assert found.multiplier == pytest.approx(found.weights @ cov @ found.weights / (mu @ found.weights - 0.065)) and found.multiplier < 0
    tied = critical_line.portfolio("max_sharpe", np.full(n, -0.1), cov, low, high)  # of equal returns the least variance
    assert tied.weights == pytest.approx(solver.min_variance(cov, low, high), abs=1e-7)
    twins = np.ones((3, 3)) * 0.04  # no critical line
    assert critical_line.portfolio("max_sharpe", np.array([-0.1, -0.3, -0.2]), twins, np.zeros(3), np.full(3, 0.6)).weights == pytest.approx([0.6, 0.0, 0.4], abs=1e-9)


def test_critical_line_of_ties_and_singular_covariances():
    mu, cov, low, high = problem(8, 5)
    line = critical_line.corners(np.full(5, 0.1), cov, low, high)  # equal means: only the least variance counts
    assert line[-1].weights == pytest.approx(solver.min_variance(cov, low, high), abs=1e-7)
    twins = np.array([[0.04, 0.04, 0.0], [0.04, 0.04, 0.0], [0.0, 0.0, 0.09]])
    for objective in ("min_variance", "max_sharpe"):  # falls back where twins are free together
        w = critical_line.portfolio(objective, np.array([0.1, 0.1, 0.2]), twins, np.zeros(3), np.full(3, 0.6)).weights
        assert w.sum() == pytest.approx(1) and (w >= -1e-12).all() and (w <= 0.6 + 1e-12).all()
    two = critical_line.corners(np.array([0.1, 0.2]), np.eye(2), np.zeros(2), np.full(2, 0.5))  # the caps leave one portfolio
    assert [c.weights.tolist() for c in two] == [[0.5, 0.5]]


def tables(spark, mu, cov):
    from quantloom.operators.optimizer import moment_tables

    return moment_tables(spark, [f"T{i:02}" for i in range(len(mu))], mu, cov)


def test_certificates_prove_and_refute(spark):
    mu, cov, low, high = problem(3, 6)
    line = critical_line.corners(mu, cov, low, high)
    best = [line[-1], critical_line.best_ratio(line, mu, cov), critical_line.at_return(line, mu, float(mu @ (line[0].weights + line[-1].weights) / 2))]
    wrong = critical_line.Corner(0.0, np.full(6, 1 / 6))
    rows = [(k, f"T{i:02}", float(w), c.multiplier) for k, c in enumerate([*best, wrong]) for i, w in enumerate(c.weights)]
    got = critical_line.certify(spark.createDataFrame(rows, "point int, ticker string, w double, return_price double"), *tables(spark, mu, cov), 0.0, float(high[0])).collect()
    errors = {r.point: r.kkt_error for r in got}
    assert max(errors[k] for k in range(3)) < 1e-9 < 1e-3 < errors[3]
    for r in got:
        assert r.lower_price >= 0 and r.upper_price >= 0 and (r.lower_price == 0 or r.w < 1e-9)
        assert r.vol == pytest.approx(float(np.sqrt([*best, wrong][r.point].weights @ cov @ [*best, wrong][r.point].weights)))


def test_frontier_as_blends_of_corners(spark):
    from quantloom.operators import optimizer

    rng = np.random.default_rng(5)
    x = rng.normal([0.001, 0.0003, 0.0004, 0.0007], 0.01, (300, 4))
    days = [f"2020-{1 + k // 28:02}-{1 + k % 28:02}" for k in range(300)]
    returns = spark.createDataFrame([(f"T{i}", d, float(v)) for d, row in zip(days, x, strict=True) for i, v in enumerate(row)], "ticker string, date string, ret double")
    mu, cov = solver.annualised(x)
    low, high = solver.limits(4)
    got = optimizer.efficient_frontier(returns, 12).collect()
    for r, target in zip(got, solver.frontier_targets(mu, cov, low, high, 12), strict=True):
        other = solver.for_return(mu, cov, low, high, target)
        assert r.target == pytest.approx(target, abs=1e-9) and r.ret == pytest.approx(target, abs=1e-8) and r.vol == pytest.approx(float(np.sqrt(other @ cov @ other)), abs=1e-8)
    assert optimizer.certified_frontier(returns, 12).selectExpr("max(kkt_error)").first()[0] < 1e-9
    twin = returns.where("ticker <> 'T3'").union(returns.where("ticker = 'T0'").selectExpr("'T3'", "date", "ret"))
    assert all(r.status == "ok" for r in optimizer.efficient_frontier(twin, 5).collect())  # no critical line or a degenerate one, but rows
