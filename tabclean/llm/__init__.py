"""Operators of a training-data pipeline: dedup, scoring, packing and the like.

Nothing outside this subpackage imports it. Registered queries and their
oracle SQL are in ``queries``.
"""
