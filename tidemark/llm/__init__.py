"""Corpus preparation at training-data scale. Nothing else in tidemark imports this subpackage."""
