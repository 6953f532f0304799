"""Composed pipelines, the query catalogue and the command line."""
