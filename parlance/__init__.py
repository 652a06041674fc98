"""Spoken-text and voice-corpus analytics on Spark DataFrames."""
