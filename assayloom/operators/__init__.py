"""Operators over DataFrames: facts, cells, statistics, missingness and the operations that change data."""
