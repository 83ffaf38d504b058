"""Readers that produce a panel and writers that keep the results of a run."""
