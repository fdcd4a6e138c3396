"""Operators for preparing language-model training data.

Thirteen operators over tables of documents or vectors, each in a module of its own
with a general interface; ``queries`` holds the thin registered queries.
Nothing outside this subpackage imports it.
"""
