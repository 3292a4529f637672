"""A DataFrame library for mining labelled tables and time series with Spark."""
