"""Streams of files: forecasts logged over time, joined with what happened."""
