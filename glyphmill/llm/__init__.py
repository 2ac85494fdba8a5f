"""Operators for preparing large text collections for model training.

Nothing outside this subpackage imports it; ``queries`` holds the thin
registered queries and their SQL.
"""
