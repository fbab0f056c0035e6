"""Operators for preparing language-model training text.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
