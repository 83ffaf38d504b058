"""DataFrame-to-DataFrame operators on a panel."""
