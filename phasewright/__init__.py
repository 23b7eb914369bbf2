"""Haplotype-graph analytics and data-pipeline operators on Spark DataFrames."""
