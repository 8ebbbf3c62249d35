"""Analytics over time-ordered market data, expressed with PySpark DataFrames."""
