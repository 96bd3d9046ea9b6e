"""Operators for cleaning and assembling language-model training data.

Nothing outside this subpackage imports it; ``serat.llm.queries`` registers its
queries and their SQL.
"""
