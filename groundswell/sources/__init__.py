"""Staged-file loaders, table reads and writes, the run log."""
