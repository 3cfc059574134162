"""Operators that prepare training data: one module for each problem, their queries and their SQL.

Nothing outside this subpackage imports it.
"""
