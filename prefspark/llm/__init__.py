"""Operators of a training-data pipeline over ``documents``-like tables.

One module per operator; :mod:`prefspark.llm.queries` registers the thin
queries. Nothing outside this folder, ``corpus_pipeline.py`` and the guarded
import in ``__spark_entry__.py`` refers to it.
"""
