"""Retail-sales analytics, forecasting and product similarity as Spark jobs."""
