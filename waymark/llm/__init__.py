"""Operators for preparing large training corpora.

Nothing outside this package imports it.  ``queries.QUERIES`` and
``queries.ORACLES`` list what the entry module registers.
"""
