"""Batch and streaming operators over the event logs and memory tables of agent teams, on Spark DataFrames."""
