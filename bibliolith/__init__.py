"""Bibliographic, citation-graph and corpus analytics expressed on Spark DataFrames."""
