"""Operators for language-model training data (problems 1 to 8).

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only if it can be imported.
"""
