"""Rebuilding, checking and assembling structured question papers on Spark."""
