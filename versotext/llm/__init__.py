"""Operators for preparing large text corpora: deduplication, filtering, tokenization, search and archives.

Nothing outside this subpackage imports it. Operators take and return DataFrames;
``queries`` holds the thin registered queries over the test tables.
"""
