"""Where pages, URLs and responses come from, and where records go."""
