"""Operators: functions from DataFrames to a DataFrame, for all entities in one job."""
