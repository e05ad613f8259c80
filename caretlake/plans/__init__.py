"""Whole jobs over the test tables: the session log, the registered queries, their SQL."""
