"""Operators for training-data pipelines: each module holds one operator and its general interface.

``llm.queries`` registers one query per operator; nothing outside this package imports it.
"""
