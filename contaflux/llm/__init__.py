"""Operators that prepare text corpora for training language models.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
