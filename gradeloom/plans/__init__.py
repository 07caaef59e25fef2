"""The registered queries, the tables they derive from the given ones, and their SQL."""
