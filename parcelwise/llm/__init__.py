"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it. The registered queries and their SQL
are in :mod:`parcelwise.llm.queries`.
"""
