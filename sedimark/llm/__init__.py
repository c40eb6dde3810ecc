"""Operators of a training-data pipeline: one module each, over plain DataFrames.

Every operator takes DataFrames and returns DataFrames; nothing outside this
subpackage imports it.  ``queries`` registers the thin ``opN_*`` queries.
"""
