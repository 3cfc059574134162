"""Operators: functions from DataFrames to a DataFrame. A point in time is always an argument."""
