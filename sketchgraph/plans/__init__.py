"""The operators over the test tables, and their SQL."""
