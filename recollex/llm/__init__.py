"""Operators for preparing training data: token ids, dedup, decontamination, filters.

Nothing else in the library imports this subpackage.
"""
