"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``queries`` derives the registered digests.
"""
