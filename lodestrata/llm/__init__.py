"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it. ``queries`` registers one query
per operator; the operators themselves live in one module each.
"""
