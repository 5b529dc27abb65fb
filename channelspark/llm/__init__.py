"""Operators of a training-data pipeline over document and embedding tables.

Nothing outside this folder imports it; ``queries`` registers one query per operator.
"""
