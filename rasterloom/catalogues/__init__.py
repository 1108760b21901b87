"""Named queries and their SQL oracles, by subject."""
