"""Operators of a training-data pipeline: cleaning, de-duplication, packing, scoring.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
