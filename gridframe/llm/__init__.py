"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` holds the thin
queries that apply them to the shared test tables.  Nothing outside this subpackage
imports it.
"""
