"""Operators for preparing training data at scale.

One module per operator, ``queries`` registers them over the given tables. Nothing
outside this package imports it.
"""
