"""Trajectory operators: every function maps DataFrames and parameters to DataFrames."""
