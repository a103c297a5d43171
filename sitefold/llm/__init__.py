"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each operator lives in a
module of its own; :mod:`sitefold.llm.registry` names the queries that apply
them to whole tables.
"""
