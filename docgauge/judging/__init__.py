"""Judges: clients that answer prompts, and their use on DataFrames."""
