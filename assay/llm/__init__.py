"""Operators of a training-data pipeline: one module per operator.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. ``catalog``
holds the registered queries and their SQL.
"""
