"""Jobs made of several operators: backtests, forecasts, similarity, reports."""
