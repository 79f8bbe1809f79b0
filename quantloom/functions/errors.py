"""Errors of the engine. Each has a stable code and is also one of Python's own kinds, so callers that handle
LookupError, ValueError or RuntimeError keep working."""

from __future__ import annotations


class EngineError(Exception):
    code = "INTERNAL_ERROR"
    status = 422

    def __init__(self, message: str, **details) -> None:
        super().__init__(message)
        self.message, self.details = message, details

    def as_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "details": self.details}


class UnknownTicker(EngineError, LookupError):
    code = "UNKNOWN_TICKER"


class InsufficientCoverage(EngineError, ValueError):
    code = "INSUFFICIENT_COVERAGE"


class InsufficientLookback(EngineError, ValueError):
    code = "INSUFFICIENT_LOOKBACK"


class InfeasibleConstraints(EngineError, ValueError):
    code = "INFEASIBLE_CONSTRAINTS"


class OptimizationFailed(EngineError, RuntimeError):
    code = "OPTIMIZATION_FAILED"


class StrategyContractViolation(EngineError, ValueError):
    code = "STRATEGY_CONTRACT_VIOLATION"


class InvalidWeights(EngineError, ValueError):
    code = "INVALID_WEIGHTS"


class InvalidParameter(EngineError, ValueError):
    code = "INVALID_PARAMETER"


class RequestLimitExceeded(EngineError, ValueError):
    code = "REQUEST_LIMIT_EXCEEDED"


# The largest request the engine takes.
LIMITS = {
    "n_simulations": 200_000,
    "horizon_days": 252,
    "tickers": 50,
    "lookback_days": 2520,
    "frontier_points": 200,
    "backtest_years": 30,
    "resamples": 1000,
    "block_walk_forward_resamples": 100,
    "window_years": 20,
    "histogram_bins": 250,
}


def enforce_max(parameter: str, value: float) -> None:
    limit = LIMITS[parameter]
    if value > limit:
        raise RequestLimitExceeded(f"{parameter} is {value}; the limit is {limit}", parameter=parameter, value=value, limit=limit)
