"""Operators: functions from DataFrames to DataFrames, with explicit settings."""
