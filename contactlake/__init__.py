"""Spark-native contact enrichment engine.

Contact files and stored pages become DataFrames; headers are mapped to a
standard schema, values cleaned, duplicates removed, people and companies
enriched by joins or batched provider calls, and the result merged into a
wide truth table by a fill-empty upsert. Search, statistics, quality
profiles, masking and export run on that table.
"""

__version__ = "0.1.0"
