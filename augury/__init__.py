"""Augury: event-contract analytics and training-data operations on Spark DataFrames."""
