"""Shared plan shapes: the table view, loops, ranks, and the query list."""
