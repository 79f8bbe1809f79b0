"""Portfolio risk analytics and backtesting over daily bars, on Spark DataFrames."""
