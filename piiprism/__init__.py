"""Sensitive-data analytics over large tables, written for Spark DataFrames."""
