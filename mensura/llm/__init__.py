"""Operators for training-data pipelines: cleaning, deduplication, tokenization and audit.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
