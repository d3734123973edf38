"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries.py`` registers one
query per operator and ``corpus_pipeline.py`` at the repository top chains
five of them.
"""
