"""Operators: functions from DataFrames to DataFrames that the builder chains."""
