"""The same results written as plain SQL for an independent engine."""
