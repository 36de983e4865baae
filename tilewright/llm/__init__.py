"""Operators for preparing text corpora.

Nothing else in the library imports this subpackage; ``queries`` and
``oracle`` hold what the driver's entry module registers.
"""
