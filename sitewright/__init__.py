"""Calling of single-nucleotide variants over target intervals, as Spark DataFrames."""
