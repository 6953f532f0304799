"""Operators for preparing language-model training data.

Nothing outside this subpackage (and the top-level ``corpus_pipeline.py``)
imports it, so it can be removed without touching the rest of the library.
"""
