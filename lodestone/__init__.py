"""Lodestone: dependency-graph analytics and corpus operators on Spark DataFrames."""
