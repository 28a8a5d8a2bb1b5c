"""Lodestone: evidence analytics over document collections, expressed as Spark DataFrames."""
