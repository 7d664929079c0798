"""Relational and data-quality operators: functions from DataFrames to DataFrames."""
