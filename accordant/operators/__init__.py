"""Relational operators over facts, documents, sections and reviews: DataFrames in, DataFrame out."""
