"""Named queries with their SQL oracles, and configured pipelines."""
