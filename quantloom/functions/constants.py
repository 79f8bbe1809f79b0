"""Constants that define results."""

# Fixed values.
TRADING_DAYS = 252
DAYS_PER_YEAR = 365.25
RISK_FREE = 0.065
MAX_WEIGHT = 0.35
FRONTIER_POINTS = 30
LOOKBACK_DAYS = 504
COST_BPS = 15.0
LARGE_MOVE = 0.25
EXPECTED_BLOCK = 21
SHORT_HISTORY = 0.95
TAIL_ROWS = 1000
HISTOGRAM_BINS = 50
WEIGHT_SUM_TOLERANCE = 1e-6
ENGINE_WEIGHT_TOLERANCE = 1e-4
BENCHMARK = "^INDEX"
EXCHANGE_SUFFIX = ".NS"
