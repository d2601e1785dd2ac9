"""Operators that prepare text corpora for language-model training.

Each module holds one operator with a general interface; ``queries`` holds the thin
registered queries.  Nothing outside this folder imports it.
"""
