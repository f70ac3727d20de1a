"""Operators for preparing training corpora.

Every operator takes and returns DataFrames and lives in its own module; ``queries``
holds the registered ``opN_*`` queries and their SQL twins.
"""
