"""Operators for building training corpora on Spark.

Nothing outside this folder imports it.  Every operator takes DataFrames and returns DataFrames; the thin
``opN_*`` queries that apply them to whole tables are in :mod:`tidewake.llm.queries`.
"""
