"""Operators for preparing large text corpora, each a DataFrame -> DataFrame function.

Nothing outside this folder (and ``corpus_pipeline.py`` at the repository top) imports
it.  ``queries.py`` holds the catalogue entries and their SQL twins.
"""
