"""Operators for preparing language-model training text.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries only when the folder is there.
"""
