"""Ledgerloom: agent-spend analytics on Spark DataFrames."""
