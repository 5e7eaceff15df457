"""The queries that the driver runs, with their SQL."""
