"""Operators for training-data preparation.

Nothing else in the package imports this subpackage; its queries are
registered by :func:`queries`/:func:`oracles` in :mod:`pagelake.llm.catalog`.
"""
