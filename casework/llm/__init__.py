"""Operators for preparing large text corpora, and the queries that apply them.

Nothing outside this folder (but the guarded import in ``__spark_entry__`` and
``corpus_pipeline``) imports it.
"""
