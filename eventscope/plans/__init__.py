"""Named queries, their SQL oracles, and the dashboard plan."""
