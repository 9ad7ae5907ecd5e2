"""Operators for preparing training text at scale.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
