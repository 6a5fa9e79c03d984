"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and the
optional part of ``__spark_entry__.py`` are its only users.
"""
