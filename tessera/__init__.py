"""Tessera: matrices, categorical data and multivariate statistics on Spark DataFrames."""
