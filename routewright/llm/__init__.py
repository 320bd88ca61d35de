"""Operators of a training-data pipeline; each is one module, ``queries`` registers one query for each of them."""
