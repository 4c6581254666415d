"""Operators of a training-data pipeline: one module each, with queries in ``queries`` and SQL in ``oracle``."""
