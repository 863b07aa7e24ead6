"""Bilingual-corpus processing and text-quality analytics on Spark DataFrames."""
