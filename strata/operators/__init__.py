"""Operators over DataFrames: diff, blame, graph, planner and validation."""
