"""Operators of a training-data pipeline over text, pages and vectors.

Each operator module holds the general interface; ``queries`` registers one
thin query per operator over the driver's tables. Nothing outside this
subpackage imports it.
"""
