"""Behavioural-data analytics on Spark DataFrames: transition, count, trace, graph, label and evaluation operators."""
