"""Catalogue assembly, matching and auditing on Spark DataFrames."""
