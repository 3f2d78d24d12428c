"""Operators that turn a raw corpus into training data, and their queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds ``QUERIES`` and ``ORACLES`` if it is there.
"""
