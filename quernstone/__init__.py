"""Corpus search and statistics on Spark: tokens, phrases, sub-corpora, frequencies and keyness."""
